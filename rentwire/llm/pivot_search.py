"""Exact top-k search by inner product with a pivot-distance index (operator 4).

Vectors are integers floor(scale * x). One more component, sqrt(M - |x|^2) with M the largest squared norm (0 for a
query), turns the largest inner product into the smallest distance. The index keys every vector by its nearest pivot and
its distance to it, and stores it in blocks of neighbouring distances: sorted annuli around each pivot. A query first
reads the annuli that it lies in; its k-th score then bounds, by the triangle inequality, which annuli it must still read.

The index holds every row; only the choice of the pivots looks at a few rows. Blocks also keep their largest norm: no row of
a block scores more than |query| times that (Cauchy and Schwarz), which stops where norms differ and distances don't. Queries
are taken in groups of bounded size, each a pass over the index; nothing but a group's queries, pivots and bounds is
broadcast. How much the bounds spare depends on the vectors: on clustered ones most blocks are out of reach, on directions
drawn evenly from 64 dimensions none is (all distances are alike there), and every bound of this kind reads them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ._common import cut, partitions

PIVOTS = 64
#: Vectors in a block and queries in a group.
BLOCK, GROUP = 256, 8192
#: Pivots whose annuli a query reads first.
NEAR = 2
#: Rounding of distances, as a share of the largest norm.
SLACK = 1e-6


def integers(vectors: DataFrame, scale: int, asks: Column | None = None) -> DataFrame:
    """row (a number of its own, once written), vec_id and v (array of floor(scale * x)) of the rows that take part: no null or non-finite component, no null id; and asks (whether a row is a query) if given, from any columns."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: F.coalesce(c.cast("double").between(-1.7e308, 1.7e308), F.lit(False)))
    more = [] if asks is None else [F.coalesce(asks, F.lit(False)).alias("asks")]
    return vectors.filter(whole).select(*more, F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    """float64 rows; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


class Space:
    """Pivots and the largest squared norm."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most, self.width = most, pivots.shape[1]
        self.exact = most < 2.0**53  # sums of products of whole numbers below this are exact in doubles
        self.pivots = self.lifted(pivots)
        self.slack = SLACK * np.sqrt(most) + 1e-9

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))
        return np.column_stack([x, extra])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of lifted rows to the pivots."""
        square = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact:
            return (q @ x.T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T


def space(vectors: DataFrame, pivots: int) -> Space:
    size = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))).alias("most"), F.max(F.size("v")).alias("width")).first()
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # `pivots` rows
    return Space(matrix([r.v for r in picked], int(size.width or 1)), float(size.most or 0))


def build_index(vectors: DataFrame, s: Space) -> DataFrame:
    """pivot, low, high (distances), norm (the largest), ids (row and vec_id pairs), vectors: blocks of the annuli, as a table in the shared folder."""
    sent = vectors.sparkSession.sparkContext.broadcast(s)

    def key(batches):
        s = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column("v").to_pylist(), s.width)
                d = s.distances(s.lifted(x))
                own = d.argmin(axis=1)
                whole = [r.tobytes() for r in x.astype(np.int64)]
                norm = np.sqrt((x * x).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own]), pa.array(norm), part.column("vec_id"), part.column("row"), pa.array(whole, pa.binary())], ["pivot", "r", "norm", "vec_id", "row", "v"])

    def block(batches):
        kept: list[pa.RecordBatch] = []

        def put(table: pa.Table):
            r = table.column("r").to_numpy()
            ids = np.column_stack([table.column(c).to_numpy().astype(np.int64) for c in ("row", "vec_id")]).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([table.column("pivot")[0].as_py()], pa.int32()), pa.array([r[0]]), pa.array([r[-1]]), pa.array([table.column("norm").to_numpy().max()]), pa.array([ids], pa.binary()), pa.array([b"".join(table.column("v").to_pylist())], pa.binary())],
                ["pivot", "low", "high", "norm", "ids", "vectors"],
            )

        def runs(table: pa.Table, last: bool):
            """Blocks of one pivot; what may still grow is given back."""
            pivot = table.column("pivot").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
            for a, b in zip(edges, edges[1:]):
                while b - a > 0 and (b - a >= BLOCK or b < len(pivot) or last):
                    n = min(BLOCK, b - a)
                    yield put(table.slice(a, n))
                    a += n
                if b == len(pivot):
                    kept[:] = table.slice(a).to_batches()

        for batch in batches:
            if batch.num_rows:
                yield from runs(pa.Table.from_batches([*kept, batch]), False)
        if kept and sum(b.num_rows for b in kept):
            yield from runs(pa.Table.from_batches(kept), True)

    keyed = vectors.mapInArrow(key, "pivot int, r double, norm double, vec_id long, row long, v binary")
    order = ["pivot", "r", "vec_id", "row"]
    ranged = keyed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return cut(ranged.mapInArrow(block, "pivot int, low double, high double, norm double, ids binary, vectors binary"))


class Best:
    """The k best (score, then smaller id, then row) of each query so far, and the score that a candidate needs."""

    def __init__(self, needed: np.ndarray, k: int):
        self.needed, self.k = needed.copy(), k
        self.held = [np.empty(0, np.int64)] * 4
        self.more: list[tuple] = []
        self.n = 0

    def add(self, *found: np.ndarray) -> None:
        """found: query, ids, rows, score."""
        self.more.append(found)
        self.n += len(found[0])
        if self.n > 200_000:
            self.settle()

    def settle(self) -> None:
        query, ids, rows, score = (np.concatenate([h, *(m[i] for m in self.more)]) for i, h in enumerate(self.held))
        order = np.lexsort((rows, ids, -score, query))
        query, ids, rows, score = query[order], ids[order], rows[order], score[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.needed[query[last]] = np.maximum(self.needed[query[last]], score[last])
        self.held, self.more, self.n = [x[rank < self.k] for x in (query, ids, rows, score)], [], 0


def visit(index: DataFrame, s: Space, rows: np.ndarray, q: np.ndarray, k: int, needed: np.ndarray | None) -> DataFrame:
    """query (its row), vec_id, row, score: the k best of each query in each task, over the annuli in reach.

    needed: a score that each query's k-th best reaches at least; None reads only the annuli that a query lies in around its nearest pivots.
    """
    sent = index.sparkSession.sparkContext.broadcast((s, rows, q, needed))

    def run(batches):
        s, rows, q, needed = sent.value
        lifted = s.lifted(q, query=True)
        d = s.distances(lifted)
        square = (q * q).sum(axis=1)
        near = np.argsort(d, axis=1, kind="stable")[:, :NEAR]
        best = Best(np.full(len(rows), np.iinfo(np.int64).min) if needed is None else needed, k)
        for batch in batches:
            for pivot, low, high, norm, own_ids, own in zip(*(batch.column(c).to_pylist() for c in ("pivot", "low", "high", "norm", "ids", "vectors"))):
                to = d[:, pivot]
                if needed is None:
                    on = (near == pivot).any(axis=1) & (to >= low - s.slack) & (to <= high + s.slack)
                else:  # |q - x| >= | |q - p| - |x - p| |, so an annulus further away than the k-th best is out of reach
                    reach = np.sqrt(np.maximum(0, square + s.most - 2 * best.needed.astype(float)))
                    on = (np.maximum(to - high, low - to) <= reach + s.slack) & (np.sqrt(square) * norm * (1 + SLACK) + 1 >= best.needed)
                if not on.any():
                    continue
                asks = np.flatnonzero(on)
                x_rows, x_ids = np.frombuffer(own_ids, np.int64).reshape(-1, 2).T
                x = np.frombuffer(own, np.int64).reshape(len(x_ids), -1).astype(float)
                score = s.scores(q[asks], x)
                good = (score >= best.needed[asks][:, None]) & (x_rows[None, :] != rows[asks][:, None])
                a, b = np.nonzero(good)
                best.add(asks[a], x_ids[b], x_rows[b], score[a, b])
                if needed is None or len(a):
                    best.settle()
        best.settle()
        query, found, own, score = best.held
        yield pa.RecordBatch.from_arrays([pa.array(rows[query]), pa.array(found), pa.array(own), pa.array(score)], ["query", "vec_id", "row", "score"])

    return index.mapInArrow(run, "query long, vec_id long, row long, score long")


def top_k(vectors: DataFrame, asks: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``asks`` (of any columns of ``vectors``) holds, the k rows of the highest inner product.

    ``vectors`` needs vec_id and embedding. Ties go to the smaller vec_id; fewer than k other rows give all of them. Rows
    whose id or vector is null, or whose vector holds a null or non-finite component, take no part. A shorter vector
    counts as ending in zeros, an empty one as zero. An empty table gives no rows. Rows that repeat a vec_id
    are queries and candidates each: only the query's own row is no candidate.
    """
    spark = vectors.sparkSession
    whole = cut(integers(vectors, scale, asks))
    queries, taking = cut(whole.filter("asks").drop("asks")), whole.drop("asks")
    total = queries.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    s = space(taking, pivots)
    index = build_index(taking, s)
    groups = -(-total // group)
    order = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    out = None
    for g in range(groups):
        own: pd.DataFrame = queries.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toPandas()  # about `group` rows
        rows, q = own.row.to_numpy(np.int64), matrix(own.v.tolist(), s.width)
        first = visit(index, s, rows, q, k, None).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
        bound = {r.query: r.score for r in first.select("query", "score").collect()}
        needed = np.array([bound.get(i, np.iinfo(np.int64).min) for i in rows.tolist()], np.int64)
        found = visit(index, s, rows, q, k, needed).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        found = cut(found) if groups > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
