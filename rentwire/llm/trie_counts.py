"""Token counts under a unigram model, by dynamic programming over a shared trie (operator 8).

Pre-tokens are white-space-separated words with a mark in front. The distinct pre-tokens of a slice of texts that a worker
has not met yet form a trie; the best score of every prefix is computed once, from the scores of its shorter prefixes and of
the piece that ends it, depth by depth in numpy, and each terminal node keeps the number of pieces on its best path. Behind
LONG characters few words share a prefix, so a longer word goes on alone from the scores of its node there. Texts add up
their words' counts.

The vocabulary is a merge vocabulary: its stored scores are the negated ranks of merges (-2 for the first, -31,740 for the
last), no log-probabilities, and single letters, which merges begin with, rank last. Sums of them would shun every letter and
mean nothing. So a piece's log-probability is taken from its rank by Zipf's law, in whole thousandths of a nat. Ties are
exact that way: the higher score wins, then fewer pieces.
"""

from __future__ import annotations

import functools
import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import U, keys, mix, slices, with_fields
from .tokenize import vocabulary_path

MARK = "▁"
#: Depth of the trie; the rest of a longer word is scored alone.
LONG = 48
#: Distinct words whose counts a worker remembers before it starts afresh; it bounds memory and changes no result.
MEMO = 800_000
#: Stands behind the end of shorter words; no character.
PAD = 0x110000
#: Score of a byte of a character that no piece holds.
BYTE = -20_000


@functools.lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece vocabulary with Zipf scores of their ranks, in thousandths of a nat."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return {x: -round(1000 * math.log((k + 2) * math.log(len(own) + 2))) for k, x in enumerate(own)}


class Lookup:
    """Scores of pieces by the hash of their characters, read from the right."""

    def __init__(self, path: str):
        self.scores = pieces(path)
        self.longest = max(map(len, self.scores))
        self.factor = keys(max(LONG, self.longest) + 2, 21)
        names, values = list(self.scores), np.array(list(self.scores.values()), np.int64)
        size = np.array([len(x) for x in names])
        hashes = np.empty(len(names), U)
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            points = np.frombuffer("".join(names[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, n)[:, ::-1]
            hashes[own] = mix(((points.astype(U) + U(1)) * self.factor[:n]).sum(axis=1, dtype=U))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.start()

    def start(self) -> None:
        self.known, self.counts = {"": 0}, np.zeros(1, np.int64)

    def counted(self, words: pa.Array) -> np.ndarray:
        """Pieces of each of these distinct words; "" has none."""
        if len(self.known) > MEMO:
            self.start()
        words = words.to_pylist()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [words[k] for k in new.tolist()]
            at[new] = np.arange(len(self.counts), len(self.counts) + len(fresh))
            self.known.update(zip(fresh, at[new].tolist()))
            self.counts = np.concatenate([self.counts, count_words([MARK + x for x in fresh], self)])
        return self.counts[at]

    def find(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(sums)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, self.values[at]


@functools.lru_cache(2)
def lookup(path: str) -> Lookup:
    return Lookup(path)


def go_on(word: str, best: list[tuple[int, int]], own: Lookup) -> int:
    """Pieces of a word whose prefixes up to len(best) - 1 characters have the given best (score, - pieces)."""
    for end in range(len(best), len(word) + 1):
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        options = [(best[end - 1][0] + BYTE * n, best[end - 1][1] - n)]
        for size in range(1, min(own.longest, end) + 1):
            if (score := own.scores.get(word[end - size : end])) is not None:
                options.append((best[end - size][0] + score, best[end - size][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def count_words(words: list[str], own: Lookup) -> np.ndarray:
    """Pieces of each of the distinct words."""
    out = np.zeros(len(words), np.int64)
    if not words:
        return out
    short = sorted((w[:LONG], k) for k, w in enumerate(words))
    size = np.array([len(w) for w, _ in short])
    depth = int(size.max())
    points = np.full((len(short), depth), PAD, np.uint32)
    points[np.arange(depth) < size[:, None]] = np.frombuffer("".join(w for w, _ in short).encode("utf-32-le", "surrogatepass"), np.uint32)
    fresh = np.ones(points.shape, bool)  # whether a row's prefix differs from the row's before
    fresh[1:] = np.logical_or.accumulate(points[1:] != points[:-1], axis=1)
    fresh &= np.arange(depth) < size[:, None]
    node = np.cumsum(fresh, axis=0) - 1  # of each row's prefix at each depth
    score, count = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]  # by depth; depth 0 is the root
    for d in range(1, depth + 1):
        row = np.flatnonzero(fresh[:, d - 1])
        last = points[row, d - 1]
        n = 1 + (last >= 0x80).astype(np.int64) + (last >= 0x800) + (last >= 0x10000)

        def above(length: int, row=row, d=d):
            at = node[row, d - length - 1] if d > length else np.zeros(len(row), np.int64)
            return score[d - length][at], count[d - length][at]

        s, c = above(1)
        best, fewest = s + BYTE * n, c + n
        sums = np.zeros(len(row), U)
        for length in range(1, min(own.longest, d) + 1):
            sums = sums + (points[row, d - length].astype(U) + U(1)) * own.factor[length - 1]
            known, value = own.find(sums)
            if known.any():
                s, c = above(length)
                s, c = s + value, c + 1
                better = known & ((s > best) | ((s == best) & (c < fewest)))
                best, fewest = np.where(better, s, best), np.where(better, c, fewest)
        score.append(best)
        count.append(fewest)
    for d in range(1, depth + 1):
        ends = np.flatnonzero(size == d)
        out[[short[k][1] for k in ends]] = count[d][node[ends, d - 1]]
    for k in np.flatnonzero(size == LONG):
        if len(words[short[k][1]]) > LONG:
            at = [0, *node[k].tolist()]
            out[short[k][1]] = go_on(words[short[k][1]], [(int(score[d][at[d]]), -int(count[d][at[d]])) for d in range(LONG + 1)], own)
    return out


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` (which needs text) with n_pretokens and n_tokens.

    A null, empty or blank text has none. Rows are independent: repeated rows have equal counts, and an empty table gives
    no rows. Columns of those names are replaced; all others stay.
    """
    vocabulary = vocabulary or vocabulary_path("piece_bpe_32k.model")
    extra = {"n_pretokens": "long", "n_tokens": "long"}
    source = docs.select(*(c for c in docs.columns if c not in extra))

    def run(batches):
        own = lookup(vocabulary)
        for part in slices(batches, "text"):
            plain = pc.replace_substring_regex(pc.fill_null(part.column("text").cast(pa.string()), ""), r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " ")
            parts = pc.split_pattern(plain, " ")
            text = np.repeat(np.arange(len(plain)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            coded = parts.flatten().dictionary_encode()
            each = own.counted(coded.dictionary)
            real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
            at = coded.indices.to_numpy()
            n = np.bincount(text, real[at], len(plain)).astype(np.int64)
            tokens = np.bincount(text, each[at], len(plain)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(tokens)], [*part.schema.names, *extra])

    return source.mapInArrow(run, with_fields(source.schema, extra))
