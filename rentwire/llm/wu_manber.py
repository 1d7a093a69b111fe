"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 6).

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one window) and symbols are words.
Windows of one length make one search: a block of two words gives, through a shift table, how far the search may jump;
at shift 0 the block's hash selects a bucket of windows, and a direct comparison of all words confirms an occurrence.
Stretches of many texts advance together, as one numpy step each.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._common import U, Words, cut, gathered, mix, separators, slices, text_bytes, with_fields

SEPARATOR = separators([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])  # of lower-cased bytes: all ASCII but 0-9, a-z
#: Bytes of benchmark text in one search; a larger benchmark is searched in several.
MOST_BYTES = 16_000_000
STRETCH = 256


def words_of(texts: pa.Array) -> Words:
    return Words(*text_bytes(texts), SEPARATOR)


def blocks_of(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that begins at each word."""
    return words if size == 1 else np.append(mix(words[:-1] * U(3) + words[1:]), U(0))


class Search:
    """Shift table and buckets of the windows of one length. words: of the benchmark; starts: first words of the windows, each window once."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, length: int):
        self.m, self.words = length, words
        self.block = min(2, length)
        far = length - self.block + 1
        self.bits = max(12, int(len(starts) * 16).bit_length())  # nearly all blocks end some window, so there are about as many as windows
        self.shift = np.full(1 << self.bits, far, np.uint8)
        block = blocks_of(words, self.block)
        for j in range(far):  # the block that begins at j may end a window after far - 1 - j more words
            slot = self.slot(block[starts + j])
            self.shift[slot] = np.minimum(self.shift[slot], far - 1 - j)
        last = block[starts + far - 1]
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.starts = starts[self.order]
        self.suffix, first = np.unique(last[self.order], return_index=True)
        self.first = np.append(first, len(starts)).astype(np.int32)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return (block >> U(64 - self.bits)).astype(np.int64)

    def find(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose words have the hashes of a window (place of the first word, window number), within the stretches [begin, end)."""
        if not len(words) or not len(begin):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        block = blocks_of(words, self.block)
        shift = self.shift[self.slot(block)]
        lead = self.m - self.block
        at, stop = begin + lead, end - self.block  # places of the search: first words of a window's last block
        found = []
        while True:
            on = at <= stop
            at, stop = at[on], stop[on]
            if not len(at):
                break
            step = shift[at].astype(np.int64)
            zero = step == 0
            found.append(at[zero])
            at = at + np.where(zero, 1, step)
        place = np.concatenate(found)
        bucket = np.minimum(np.searchsorted(self.suffix, block[place]), len(self.suffix) - 1)
        hit = self.suffix[bucket] == block[place]
        place, bucket = place[hit] - lead, bucket[hit]
        n = self.first[bucket + 1] - self.first[bucket]
        row, place = gathered(self.first[bucket], n), np.repeat(place, n)
        for j in range(self.m):
            same = self.words[self.starts[row] + j] == words[place + j]
            place, row = place[same], row[same]
        return place, self.order[row]


class Patterns:
    """Searches by window length, with the items of each window. All of it is flat arrays: about twelve times the benchmark's bytes."""

    def __init__(self, items: pd.DataFrame, width: int):
        self.words = words_of(pa.array(items.text.fillna("").tolist(), pa.string()))
        self.items = [str(x) for x in items.item_id]
        counts = self.words.counts
        length = np.minimum(counts, width)
        self.searches = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            n = counts[own] - m + 1
            starts, item = gathered(self.words.bounds[:-1][own], n).astype(np.int32), np.repeat(own, n)
            starts, group = self.distinct(starts, m)
            pairs = np.unique(group * len(self.items) + item)
            first = np.searchsorted(pairs, np.arange(len(starts) + 1) * len(self.items))
            self.searches.append((Search(self.words.hash, starts, m), starts, (pairs % len(self.items)).astype(np.int32), first.astype(np.int32)))
        self.words.start, self.words.end = self.words.start.astype(np.int32), self.words.end.astype(np.int32)

    def distinct(self, starts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The first of each set of windows with equal words, and the number of each window's set."""
        key = np.zeros(len(starts), U)
        for j in range(m):
            key = mix(key * U(0x9E3779B97F4A7C15) + self.words.hash[starts + j])
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(order), bool)
        for k in range(m):  # neighbours in the order are one set if all their words are equal
            same = self.words.hash[starts[order[1:]] + k] == self.words.hash[starts[order[:-1]] + k]
            fresh[1:] = ~same if k == 0 else fresh[1:] | ~same
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        return starts[order[fresh]], group

    def same_words(self, words: Words, place: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
        """Direct comparison: whether the m words from each place on are, letter by letter, those of the benchmark from start on."""
        good = np.ones(len(place), bool)
        for j in range(m):
            a, b, n = words.start[place + j], self.words.start[start + j], words.end[place + j] - words.start[place + j]
            good &= n == self.words.end[start + j] - b
            on = np.flatnonzero(good)
            if len(on):
                equal = words.low[gathered(a[on], n[on])] == self.words.low[gathered(b[on], n[on])]
                good[on] = np.logical_and.reduceat(equal, np.cumsum(n[on]) - n[on])
        return good

    def scan(self, texts: pa.Array, earlier: list[list[int]] | None = None) -> tuple[np.ndarray, list[list[int]], list[set[str]]]:
        """Per text: words, word ranges hit (first, end, first, end, ...; merged, with those found earlier), and the items that occur."""
        words = words_of(texts)
        counts = words.counts
        step = np.zeros(len(words.hash) + 1, np.int64)
        items: list[set[str]] = [set() for _ in counts]
        for search, starts, owners, first in self.searches:
            pieces = -(-counts // STRETCH)
            begin = np.repeat(words.bounds[:-1] - STRETCH * (np.cumsum(pieces) - pieces), pieces) + STRETCH * np.arange(int(pieces.sum()))
            end = np.minimum(begin + STRETCH + search.m - 1, np.repeat(words.bounds[1:], pieces))
            place, window = search.find(words.hash, begin, end)
            good = self.same_words(words, place, starts[window], search.m)
            place, window = place[good], window[good]
            np.add.at(step, place, 1)
            np.add.at(step, place + search.m, -1)
            text = np.searchsorted(words.bounds, place, "right") - 1
            found = np.unique(text * np.int64(len(starts)) + window)  # each window of a text once
            text, window = found // len(starts), found % len(starts)
            n = first[window + 1] - first[window]
            for t, k in zip(np.repeat(text, n).tolist(), owners[gathered(first[window], n)].tolist()):
                items[t].add(self.items[k])
        for t, known in enumerate(earlier or []):
            for a, b in zip(known[::2], known[1::2]):
                step[words.bounds[t] + a] += 1
                step[words.bounds[t] + b] -= 1
        hit = np.cumsum(step[:-1]) > 0
        edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
        ranges: list[list[int]] = [[] for _ in counts]
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            while a < b:  # a range that goes on over the border of two texts is two
                t = int(np.searchsorted(words.bounds, a, "right")) - 1
                cut_at = min(b, int(words.bounds[t + 1]))
                ranges[t] += [a - int(words.bounds[t]), cut_at - int(words.bounds[t])]
                a = cut_at
        return counts, ranges, items


#: The last block's searches, by the block's name: a worker builds them once and not in each task.
_BUILT: dict[str, Patterns] = {}


def built(name: str, items: pd.DataFrame, width: int) -> Patterns:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Patterns(items, width)
    return _BUILT[name]


def search_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside occurrences), hits (their word ranges: first, end, first, end, ...) and items (sorted array of the item_ids that occur, as strings).

    ``docs`` needs a text column; its other columns are kept, but for those four names. A null or empty text has no words
    and no hits; an empty benchmark hits nothing; items without words are left out. An item_id that repeats is one item.
    The benchmark's size is checked first: over ``most_bytes`` it is dealt by hash into blocks of about that size, which
    are searched one after another, each pass adding to the hits and items of those before.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = int(items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0)
    blocks = max(1, -(-size // most_bytes))
    extra = {"n_words": "long", "n_hit": "long", "hits": "array<long>", "items": "array<string>"}
    out = docs.select(*(c for c in docs.columns if c not in extra))
    schema = with_fields(out.schema, extra)
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toPandas()  # bounded by most_bytes
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent, again=k > 0, name=uuid.uuid4().hex):
            patterns = built(name, sent.value, width)
            for part in slices(batches, "text"):
                own = [c for c in part.schema.names if c not in extra]
                counts, ranges, found = patterns.scan(part.column("text").cast(pa.string()), part.column("hits").to_pylist() if again else None)
                if again:
                    found = [x.union(y) for x, y in zip(found, part.column("items").to_pylist())]
                n_hit = [sum(x[1::2]) - sum(x[::2]) for x in ranges]
                columns = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *columns], [*own, *extra])

        out = out.mapInArrow(run, schema)
        if blocks > 1:
            out = cut(out)
    return out


def contaminated() -> Column:
    """Over search_benchmark's columns: at least one word of twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
