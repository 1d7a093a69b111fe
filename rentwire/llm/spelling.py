"""Spelling variants: words one edit apart, by an index of grams of variable length (operator 11).

A dictionary of grams is grown from the shortest on: a gram that is frequent among the words is replaced by its extensions, so
that few lists of the index are long. A word, with marks at both ends, has at each place the shortest gram that the dictionary
does not extend. One edit changes only the grams that cover its place, so a word's bound is the most grams that cover any one
place: of its N grams all but that bound occur in every near word, at most one place off. Lists are merged by that bound:
a near pair shares a gram among the bound + 1 rarest of each word, so the other, longer lists are left out. Pairs that
meet are verified by their edit distance.

The dictionary is fitted on a bounded sample of the words (it decides list lengths alone, never which pairs are found, as any
dictionary that is the same for all words finds all); every word is indexed.

Tables of words are joined by sorting, as their files are a small part of what they take in memory: Spark would broadcast
them, and the index of grams too, whose size it tells by that of the words.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import cut, discard

#: Letters of the shortest gram.
SHORT = 3
#: Words in the sample that the dictionary is fitted on, at most; words of more letters than LONG are not taken into it.
SAMPLE, LONG = 200_000, 48
#: A gram is extended while more than so many places of the indexed words hold it.
MOST = 48
#: (shortest word, longest word, longest gram): a near pair has a band that holds both its words, and a gram can't cover all of a word's places.
BANDS = ((5, 7, 4), (7, 10, 6), (10, 1 << 30, 9))
FIRST, LAST = "^", "$"


def runs(text: Column) -> Column:
    """Maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(low, "[^a-z\\u00C0-\\u00FF]+")


def words(docs: DataFrame, dropped: int = 97, least: int = 5, often: int = 3) -> DataFrame:
    """word, n: of ``docs`` (doc_id, text). A run loses one letter where ``dropped`` divides its checksum with its document's number (none: an empty one)."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs(F.col("text"))).alias("run")).filter(F.length("run") >= least)
    coded = each.select("run", F.crc32(F.concat_ws(":", "doc", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_out = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return coded.select(F.when(F.col("h") % dropped == 0, cut_out).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def bands(size: Column) -> Column:
    """Numbers of the bands of words of a size."""
    return F.filter(F.array(*(F.when((size >= low) & (size <= high), F.lit(k)) for k, (low, high, _) in enumerate(BANDS))), lambda x: x.isNotNull())


def dictionary(vocabulary: DataFrame) -> dict[str, int]:
    """{band and gram: places that hold it} of the grams that are extended; at most sample x LONG x lengths / MOST of them.

    Counted on the sample, in proportion to its share of the words.
    """
    total = vocabulary.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = vocabulary.filter((F.length("word") <= LONG) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))))
    marked = sample.select(F.concat(F.lit(FIRST), "word", F.lit(LAST)).alias("word"), F.explode(bands(F.length("word"))).alias("band"))
    longest = F.element_at(F.array(*(F.lit(q) for _, _, q in BANDS)), F.col("band") + 1)
    places = marked.select("band", longest.alias("longest"), F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - SHORT + 1), lambda p: F.substring(F.col("word"), p, F.lit(BANDS[-1][2])))).alias("stem"))
    sizes = F.sequence(F.lit(SHORT), F.least(F.length("stem"), F.col("longest")))
    grams = places.select("band", F.explode(F.transform(sizes, lambda q: F.substring(F.col("stem"), F.lit(1), q))).alias("gram"))
    frequent = grams.groupBy("band", "gram").agg(F.count("*").alias("n")).filter(F.col("n") > max(2, MOST * share))
    return {f"{r.band}{r.gram}": int(r.n / share) for r in frequent.toLocalIterator()}


def decomposed(word: str, band: int, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram at each place of the marked word, and the bound: the most grams that cover one place behind the first mark."""
    marked, longest = FIRST + word + LAST, BANDS[band][2]
    grams, cover = [], [0] * (len(marked) + 1)
    for p in range(len(marked) - SHORT + 1):
        end = p + SHORT
        while end - p < longest and end < len(marked) and f"{band}{marked[p:end]}" in frequent:
            end += 1
        grams.append(marked[p:end])
        cover[max(p, 1)] += 1
        cover[end] -= 1
    most = now = 0
    for c in cover:
        now += c
        most = max(most, now)
    return grams, most


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """x, n_x, y, n_y: pairs of words of ``vocabulary`` (word, n; distinct words of five letters or more) one edit apart, each once with x < y."""
    frequent = vocabulary.sparkSession.sparkContext.broadcast(dictionary(vocabulary))

    def run(batches):
        known = frequent.value
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for band, (low, high, _) in enumerate(BANDS):
                    if low <= len(word) <= high:
                        grams, bound = decomposed(word, band, known)
                        order = sorted((known.get(f"{band}{g}", 0), -len(g), zlib.crc32(g.encode()), g, p) for p, g in enumerate(grams))
                        rows += [(f"{band}{g}", p, len(word), word, n) for _, _, _, g, p in order[: bound + 1]]
            yield pa.RecordBatch.from_pydict(dict(zip(("gram", "place", "size", "word", "n"), map(list, zip(*rows)))) if rows else {c: [] for c in ("gram", "place", "size", "word", "n")}, pa.schema([("gram", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("word", pa.string()), ("n", pa.int64())]))

    index = vocabulary.mapInArrow(run, "gram string, place int, size int, word string, n long")
    a, b = (index.select(F.xxhash64("gram").alias("gram"), *(F.col(c).alias(f"{c}_{side}") for c in ("place", "size", "word", "n"))) for side in "xy")
    close = (F.abs(F.col("place_x") - F.col("place_y")) <= 1) & (F.abs(F.col("size_x") - F.col("size_y")) <= 1)
    met = a.join(b.hint("merge"), "gram").filter((F.col("word_x") < F.col("word_y")) & close)
    near = met.filter(F.levenshtein("word_x", "word_y", 1) == 1)
    return near.select(F.col("word_x").alias("x"), F.col("n_x"), F.col("word_y").alias("y"), F.col("n_y")).distinct()


def variants(vocabulary: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of ``vocabulary`` (word, n).

    form: the near word of largest n (ties: the first in code-point order) if that is at least twice the word's, else null. root: where
    following forms ends. Each step at least doubles n, so no chain is longer than the number of bits of the largest; chains
    are shortened by doubling. An empty vocabulary gives no rows.
    """
    spark, made = vocabulary.sparkSession, []
    known = cut(vocabulary.select("word", "n"), made)
    pairs = near_pairs(known)
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("m")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("n_x").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(F.negative("m").alias("m"), "other")).alias("best"))
    judged = known.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= 2 * F.col("n"), F.struct(F.col("best.other").alias("form"), F.negative("best.m").alias("form_n"))).alias("f"))
    own = cut(judged.select("word", "n", "n_near", "f.form", "f.form_n"), scratch)
    links = own.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        higher = cut(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("above")).hint("merge"), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), made)
        links = higher.select("word", "root")
        if higher.filter("moved").isEmpty():
            break
    ends = cut(links, scratch)
    discard(spark, made)
    return own.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
