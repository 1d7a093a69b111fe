"""MinHash near-duplicates by SetSketch registers (operator 1).

A text's word shingles are a set. Each of its registers holds floor(1 - log_b(x)) for the smallest x among exponential
hashes of the shingles, cut to 16 bits: exponentially spaced, truncated minima, so that the sketch of a union is the
maximum of the sketches, and registers agree the more often the more two sets share. Bands of registers propose pairs,
the likelihood of a pair's registers (with both set sizes known) estimates its similarity, and whole sets confirm it.

Texts with equal sets are one node (by a 64-bit hash: among 10**9 different sets one false merge has a chance of 3 %). In a
band's bucket every member is compared with one hub first, then with the members that are still in another component: pair
by pair in small buckets, and in large ones by what distinguishes them from a hub. No link that would join two components
is lost. Rows that meet at one hub are dealt over as many tasks as their number asks for.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import SPACES, U, Words, cut, discard, keys, mix, separators, slices, text_bytes
from rentwire.operators.components import roots

BASE, RATE = 1.001, 20.0
#: A pair at 0.8 shares no band with probability (1 - 0.8**5)**36, under one in a million.
BANDS, ROWS = 36, 5
REGISTERS = BANDS * ROWS
#: Rows of one hub in a task, about.
DEALT = 2048
#: Words of 64 bits in the parity map of a member's edits.
MAPS = 4
#: Buckets of more members are searched through edits and not pair by pair.
PAIRWISE = 32
#: Pairs whose estimate lies so many standard errors under the bound are not confirmed.
ERRORS = 6.0

SEPARATOR = separators(SPACES)
SEEDS, FACTORS = keys(REGISTERS, 11), keys(REGISTERS, 13)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words; a text of fewer words is one shingle, one of none has none."""
    words = Words(*text_bytes(texts), SEPARATOR)
    n = len(words.hash)
    run = np.zeros(n, U)
    for j in range(width):
        run[: n - j] = run[: n - j] * U(0x9E3779B97F4A7C15) + words.hash[j:] if n > j else run[: n - j]
    run = mix(run)
    out = []
    for a, b in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], U)
            for h in words.hash[a:b]:
                whole = mix(whole * U(0xC2B2AE3D27D4EB4F) + h)
            out.append(whole)
        else:
            out.append(np.empty(0, U))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, REGISTERS) uint16. Empty sets have registers 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    with np.errstate(over="ignore"):
        for i in range(0, len(full), 32):
            some = full[i : i + 32]
            flat = np.concatenate([sets[k] for k in some])
            starts = np.cumsum([0, *(len(sets[k]) for k in some[:-1])])
            least = np.empty((len(some), REGISTERS), U)
            for j in range(REGISTERS):
                least[:, j] = np.minimum.reduceat((flat ^ SEEDS[j]) * FACTORS[j], starts)
            x = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64) / RATE
            out[some] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes (rows are pairs)."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        more, less = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        left, right = low + (high - low) * 0.382, low + (high - low) * 0.618
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, node (a hash of the whole set; null for an empty one), n (set size), registers."""

    def run(batches):
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), width)
            node = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in sets]
            regs = registers(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())], ["doc_id", "text_hash", "node", "n", "registers"])

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, node long, n long, registers binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """key, node, n: a row for each band of each node."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                regs = np.stack([np.frombuffer(x, np.uint16) for x in part.column("registers").to_pylist()]).astype(U).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), regs.shape[:2])
                for j in range(ROWS):
                    key = mix(key * U(0x9E3779B97F4A7C15) + regs[:, :, j])
                each = [pa.array(np.repeat(part.column(c).to_numpy(), BANDS)) for c in ("node", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *each], ["key", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(run, "key long, node long, n long")


def confirm(pairs: DataFrame, members: DataFrame, width: int, percent: int, made: list[str]) -> DataFrame:
    """The pairs (x, y) that are links: estimated from registers, then confirmed on whole sets."""

    def run(batches):
        known: tuple[int | None, np.ndarray | None] = (None, None)
        bound = percent / 100
        slack = ERRORS * np.sqrt(bound * (1 - bound) / REGISTERS)
        for part in slices(batches, "text_y", most_rows=1000):
            a, b = (np.stack([np.frombuffer(x, np.uint16) for x in part.column(c).to_pylist()]) for c in ("registers_x", "registers_y"))
            likely = estimate(a, b, part.column("n_x").to_numpy().astype(float), part.column("n_y").to_numpy().astype(float)) >= bound - slack
            part = part.filter(pa.array(likely))
            if not part.num_rows:
                continue
            xs, good = part.column("x").to_pylist(), []
            for x, text, own in zip(xs, part.column("text_x"), shingle_sets(part.column("text_y"), width)):
                if known[0] != x:
                    known = x, shingle_sets(pa.array([text.as_py()], pa.string()), width)[0]
                both = len(np.intersect1d(known[1], own, assume_unique=True))
                good.append(100 * both >= percent * (len(known[1]) + len(own) - both))
            yield part.select(["x", "y"]).filter(pa.array(good))

    sides = [members.select(F.col("node").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("n", "registers", "text"))) for c in "xy"]
    return beside(pairs.select("x", "y").join(sides[1], "y"), sides[0], "x", "y", pairs, made).mapInArrow(run, "x long, y long")


def beside(rows: DataFrame, hubs: DataFrame, hub: str, spread: str, counted: DataFrame, made: list[str]) -> DataFrame:
    """``rows`` with the columns of ``hubs`` (one row for each value of ``hub``). Where ``counted`` has many rows of one hub, they
    are dealt by ``spread`` over as many tasks as their number asks for, each with its own copy of the hub's row."""
    heavy = counted.groupBy(hub).count().filter(F.col("count") > DEALT).select(hub, F.ceil(F.col("count") / DEALT).cast("int").alias("shares"))
    heavy = cut(heavy, made)  # few rows, so that Spark knows that they are few
    dealt = rows.join(heavy, hub, "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64(spread), F.col("shares")).cast("int"), F.lit(0))).drop("shares")
    many = hubs.join(heavy, hub, "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    return dealt.join(many, [hub, "share"])


def edited(part: pa.RecordBatch, width: int, known: dict):
    """For each row (h, text_h, text_node): the hub's shingles that the node lacks, and the node's that the hub lacks. known: the last hub's set."""
    for h, text, own in zip(part.column("h").to_pylist(), part.column("text_h"), shingle_sets(part.column("text_node"), width)):
        if h not in known:
            known.clear()
            known[h] = shingle_sets(pa.array([text.as_py()], pa.string()), width)[0]
        yield np.setdiff1d(known[h], own, assume_unique=True), np.setdiff1d(own, known[h], assume_unique=True)


def common_shingles(members: DataFrame, width: int, sample: int = 2000, most: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that are most frequent in about ``sample`` members, ``most`` of them.

    They only make the order of a hub's edits begin with rare ones (shingles that few add, or few lack); any order finds
    the same links, so a sample will do.
    """
    share = min(1.0, sample / max(1, members.count()))

    def run(batches):
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(part.column("text"), width)).view(np.int64))], ["e"])

    some = members.filter(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < share * (1 << 30)).select("text")
    rows = some.mapInArrow(run, "e long").groupBy("e").count().filter("count > 1").orderBy(F.desc("count"), "e").limit(most).toPandas().sort_values("e")
    return rows["e"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)


def first_edits(paired: DataFrame, width: int, c: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, node, root, n, size, linked, map, edits: each member with its first edits from the hub (rare ones first), as pairs_by_edits needs them.

    edits: of (e, rank, to_linked, to_far). map: bit k is the parity of the edits that fall on it.
    """

    sent = paired.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        known: dict = {}
        usual: dict = {}
        hashes, counts = sent.value

        def frequency(e: np.ndarray) -> np.ndarray:
            if not len(hashes):
                return np.zeros(len(e))
            place = np.minimum(np.searchsorted(hashes, e), len(hashes) - 1)
            return np.where(hashes[place] == e, counts[place], 0).astype(float)

        for part in slices(batches, "text_node", most_rows=500):
            n, m, hubs = (part.column(k).to_numpy() for k in ("n", "m", "h"))
            rows: list[list] = [[] for _ in range(4)]
            for k, (missed, added) in enumerate(edited(part, width, known)):
                size = len(missed) + len(added)
                over = size - c * (n[k] + m[k])
                near = math.floor((size - c * (n[k] - m[k])) / 2 - 1e-9) + 1
                far = math.ceil(over / (1 + c) - 1e-9)
                linked = over <= 1e-9
                to_linked, to_far = (0, size + 1 - near) if linked else (size + 1 - far, size + 1 - max(near, far))
                if hubs[k] not in usual:  # the hub's shingles that most of its like have are seldom lacked
                    usual.clear()
                    usual[hubs[k]] = np.quantile(frequency(next(iter(known.values())).view(np.int64)), 0.75)
                e = np.concatenate([missed, added]).view(np.int64)
                often = frequency(e)
                often[: len(missed)] = np.maximum(0, next(iter(usual.values())) - often[: len(missed)])
                ordered = e[np.lexsort((e, often))]
                bit = (mix(e.view(U)) >> U(32)) % U(64 * MAPS)
                odd = np.bincount(bit.astype(np.int64), minlength=64 * MAPS).astype(np.uint8) & 1
                first = ordered[: max(to_linked, to_far, 0)].tolist()
                for column, x in zip(rows, (size, linked, np.packbits(odd, bitorder="little").view(np.int64).tolist(), [{"e": x, "rank": rank, "to_linked": rank <= to_linked, "to_far": rank <= to_far} for rank, x in enumerate(first, 1)])):
                    column.append(x)
            held = [part.column(x) for x in ("h", "node", "root", "n")]
            kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("e", pa.int64()), ("rank", pa.int64()), ("to_linked", pa.bool_()), ("to_far", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(x, t) for x, t in zip(rows, kinds))], ["h", "node", "root", "n", "size", "linked", "map", "edits"])

    return paired.mapInArrow(run, "h long, node long, root long, n long, size long, linked boolean, map array<bigint>, edits array<struct<e:bigint,rank:bigint,to_linked:boolean,to_far:boolean>>")


def pairs_by_edits(live: DataFrame, members: DataFrame, width: int, percent: int, made: list[str]) -> DataFrame:
    """x, y: pairs of large buckets that can be links, all but those that join no two components.

    A bucket's members are described by their edits from one set h: the hub of the bucket, or a hub of more degree that
    stands in a bucket with it, so that few hubs serve many buckets. For sets x and y, |x ^ y| = |edits of x| + |edits of y| -
    2 * shared edits, and they are linked if that is at most c * (n + m) with c = (1 - t) / (1 + t). Two that are both linked to
    h meet there: each is a pair with h, unless its component is h's. Else say x is not linked to h: with a = edits - c * (n +
    hub) > 0, links of x share at least a / (1 + c) edits, and links to such an x share more than (edits - c * (m - hub)) / 2.
    Sets that share s elements share one among the first size - s + 1 of each in any one order (rare ones first), so members
    meet there, and only where enough edits follow and the parity maps of their edits differ in few enough bits.
    """
    hub = live.groupBy("key").agg(F.max_by(F.struct("degree", "node", "n", "root"), F.struct("degree", "node")).alias("hub"), F.count("*").alias("held"))
    hub = cut(hub, made)
    of_hubs = live.join(hub.select(F.col("hub.node").alias("node")).distinct(), "node", "left_semi").select("key", F.col("node").alias("low"))
    above = of_hubs.join(hub, "key").groupBy("low").agg(F.max("hub").alias("up"))
    hub = hub.select("key", F.col("hub.node").alias("low")).join(above, "low").select("key", "up")
    relative = live.join(hub, "key").select(F.col("up.node").alias("h"), "node", "root", "n", F.col("up.n").alias("m"), F.col("up.root").alias("hub_root")).filter("h <> node").distinct()
    relative = cut(relative, made)
    texts = members.select("node", F.col("text").alias("text_node"))
    hubs = members.select(F.col("node").alias("h"), F.col("text").alias("text_h"))
    paired = beside(relative.join(texts, "node"), hubs, "h", "node", relative, made)
    c = (100 - percent) / (100 + percent)
    ranked = cut(first_edits(paired.select("h", "node", "root", "n", "m", "text_node", "text_h"), width, c, common_shingles(members, width)), made)
    to_hub = ranked.filter("linked").join(relative.select("h", "node", "hub_root"), ["h", "node"]).filter("root <> hub_root").select(F.col("h").alias("x"), F.col("node").alias("y"))
    # At the first edit that two members share, all others that they share come later in both.
    need = (F.col("size") + F.col("other_size") - c * (F.col("n") + F.col("other_n"))) / 2
    later = F.least(F.col("size") - F.col("rank"), F.col("other_size") - F.col("other_rank"))
    apart = sum((F.bit_count(F.col("map")[k].bitwiseXOR(F.col("other_map")[k])) for k in range(MAPS)), F.lit(0))
    like = (F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent) & (F.ceil(need - 1e-9) <= later + 1)
    like = like & (apart <= c * (F.col("n") + F.col("other_n")) + 1e-9) & (F.col("root") != F.col("other"))
    columns = ["h", "node", "root", "n", "size", "map"]
    spread = lambda rows, kind: rows.select(*columns, F.inline(F.filter("edits", lambda x: x[kind]))).select("e", "rank", *columns)
    far = ranked.filter("not linked")
    other = [spread(far, kind).select("h", "e", F.col("node").alias("y"), F.col("root").alias("other"), F.col("n").alias("other_n"), F.col("size").alias("other_size"), F.col("rank").alias("other_rank"), F.col("map").alias("other_map")) for kind in ("to_linked", "to_far")]
    mixed = spread(ranked.filter("linked"), "to_far").join(other[0], ["h", "e"]).filter(like)
    both = spread(far, "to_far").join(other[1], ["h", "e"]).filter(like & (F.col("node") < F.col("y")))
    pairs = mixed.select(F.col("node").alias("x"), "y").unionByName(both.select(F.col("node").alias("x"), "y")).unionByName(to_hub)
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Columns doc_id, text_hash, n_shingles, component_id, kept: a row for each row of ``docs`` (doc_id, text; other columns play no part).

    Links join texts with 100 * shared shingles >= percent * all shingles; component_id is the smallest doc_id that links
    reach (null if none is known); kept says that the row is the first of its component by doc_id, nulls last, then by
    text_hash. A null, empty or blank text has no shingles, is linked with nothing and is its own component. Rows that
    repeat a doc_id (or have none) with different texts are different texts; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made: list[str] = []
    sketched = cut(sketches(docs, width))
    nodes = cut(sketched.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("head"), F.first("n").alias("n"), F.first("registers").alias("registers")), made)
    bands = band_keys(nodes)
    full = bands.groupBy("key").count().filter("count > 1")
    buckets = cut(bands.join(full, "key"), made)

    # Texts of the nodes that share a bucket: one text of each, by the doc_id and text_hash of the row that gave the node.
    inside = buckets.select("node").distinct().join(nodes, "node")
    texts = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = texts.dropDuplicates(["doc_id", "text_hash"]) if repeats_ids(docs) else texts
    same = F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.text_hash") == F.col("text_hash"))
    members = cut(inside.join(texts, same).select("node", "n", "registers", "text"), made)

    degree = buckets.groupBy("node").agg(F.sum("count").alias("degree"))
    live = cut(buckets.join(degree, "node").withColumn("root", F.col("node")), made)
    similar = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    links, label = None, None
    for to_hubs in (True, False):
        if label is not None:
            live = live.drop("root").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = live.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("key")
            live = cut(live.join(mixed, "key"), made)
            if live.isEmpty():
                break
        if to_hubs:  # every member with its bucket's hub, the node of the highest degree
            hub = live.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("hub"), F.max("count").alias("held"))
            hub = hub.select("key", F.col("hub.node").alias("x"), F.col("hub.n").alias("m"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("held") / DEALT).cast("int") - 1)).alias("share"))
            dealt = live.withColumn("share", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / DEALT)).cast("int"))
            pairs = dealt.join(hub, ["key", "share"]).filter((F.col("x") != F.col("node")) & similar).select("x", F.col("node").alias("y")).distinct()
        else:  # what is still apart
            few = live.filter(F.col("count") <= PAIRWISE)
            other = few.select("key", F.col("node").alias("x"), F.col("n").alias("m"), F.col("root").alias("other"))
            pairs = few.join(other, "key").filter(similar & (F.col("root") != F.col("other")) & (F.col("node") < F.col("x"))).select("x", F.col("node").alias("y")).distinct()
            many = live.filter(F.col("count") > PAIRWISE)
            if not many.isEmpty():
                pairs = pairs.unionByName(pairs_by_edits(many, members, width, percent, made)).distinct()
        found = cut(confirm(cut(pairs, made), members, width, percent, made), made)
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            label = roots(links, made)
    first = nodes.select("node", "head")
    if label is not None:
        least = label.join(first, "node").groupBy("root").agg(F.min("head").alias("least"))
        first = first.join(label.join(least, "root").select("node", "least"), "node", "left").select("node", F.coalesce("least", "head").alias("head"))
    first = cut(first)
    discard(docs.sparkSession, made)
    out = sketched.drop("registers").join(first, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    own = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("node").isNull() | own).alias("kept"))


def repeats_ids(docs: DataFrame) -> bool:
    """Whether any doc_id occurs twice; reads that column alone."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
