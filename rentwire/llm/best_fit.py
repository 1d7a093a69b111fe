"""Best-fit packing of token sequences (operator 9).

Method, bulk-synchronous best-fit: pieces are range-sorted by length over all tasks, each task counts its runs of equal
length, and every piece knows its rank among those of its length. Rounds go from the longest length down: the pieces of one
length are matched with the open gaps by a successor sweep (the smallest gap that holds them), those that want gaps of one
size are dealt to them by rank, the gaps shrink, and the round repeats on what shrank and still fits; pieces without a gap
open sequences. At the end every piece finds its place by its rank, in a join that all tasks share.

What is distributed and what is not: pieces are sorted, ranked and placed in all tasks. The sweep itself sees no pieces but
the runs (length, how many), at most ``capacity`` of them whatever the input holds, as pieces of one length are
interchangeable and so are gaps of one size. That histogram is swept in one task; dealing 2,048 rows over tasks would only
add a shuffle to each round.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from ._common import cut, partitions, slices
from .tokenize import SLICE, encoder, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, n long, first_sequence long, offset long"


def cut_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int, drops_space: bool) -> DataFrame:
    """Per piece of each document (its ids and ``end_id``): a document over ``capacity`` is cut so that only its first piece is shorter."""

    def run(batches):
        encode = encoder(vocabulary, drops_space).encode
        for part in slices(batches, "text", most_bytes=SLICE):
            ids, counts = encode(part.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (counts - (pieces - 1) * capacity)[row]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            whole = memoryview(ids.tobytes())
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The plan (PLAN's columns) for so many pieces of each length. Deterministic."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences (first, how many) that have it
    sizes: list[int] = []
    plan, opened = [], 0

    def leave(size: int, first: int, n: int) -> None:
        if size:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            if (at := bisect_left(sizes, length)) < len(sizes):
                size = sizes[at]
                first, n = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            took = min(left, n)
            plan.append((length, rank, took, first, capacity - size))
            if took < n:
                leave(size, first + took, n - took)
            leave(size - length, first, took)
            left, rank = left - took, rank + took
    return plan


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0, drops_space: bool = False) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    A null or empty text is the end id alone. Rows that repeat are packed as often as they occur; a null doc_id stays
    null. An empty table gives no rows. Other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, capacity, vocabulary or vocabulary_path("byte_bpe_50k.json"), end_id, drops_space))
    ranged = cut(
        pieces.repartitionByRange(partitions(spark), F.desc("length"), "doc_id", "piece", "ids_crc32")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
    )
    runs = ranged.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(sweep(dict(zip(pdf.length.tolist(), pdf.n.tolist())), capacity), columns=["length", "first_rank", "n", "first_sequence", "offset"])

    by_length = ranged.groupBy("length").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))  # at most `capacity` rows
    planned = cut(by_length.groupBy("one").applyInPandas(plan, PLAN)).withColumnRenamed("length", "of").withColumnRenamed("n", "many")
    ranked = ranged.join(runs.select("part", "length", "before", "first_at"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("at") - F.col("first_at"))
    # The plan is a table of known size, so that Spark broadcasts it only under its own threshold.
    fits = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("many"))
    return ranked.join(planned, fits).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
