"""Token ids of whole texts by the tokenizers library, with each distinct chunk of a worker's texts encoded once.

A chunk is a stretch of text at whose ends the tokenizer always splits, so its ids do not depend on its neighbours:
white-space-separated words for the vocabulary that drops white space, words with their leading space and single line
breaks for the byte-level one. Texts with other white space, and texts that hold a token that was added to the vocabulary
(as its end mark), go through the library whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import gathered

#: Chunks that a worker remembers before it forgets those that came once; it bounds memory and changes no result.
MEMO = 600_000
#: Bytes of text that are looked up together.
SLICE = 2_500_000
#: A text of this kind has a run of white space, or white space other than a space and a line feed, or some at an end, or U+0000.
ODD = "^\\s|\\s$|\\s\\s|[^\\S \\n]|[\\x00\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_MADE: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """drops_space: the vocabulary's own rule drops all white space. plain: added tokens inside a text are ordinary text."""

    lead = ""  # goes before every text
    memo = MEMO

    def __init__(self, path: str, drops_space: bool, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.drops_space = drops_space
        added = [] if plain else [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([*added, *([] if drops_space else [ODD])])
        self.mark = "|" if drops_space else "\n"
        (self.mark_id,) = self.whole([self.mark])[0]
        self.size = self.tokenizer.get_vocab_size()
        self.start()

    def start(self) -> None:
        self.known, self.names = {"": 0}, [""]  # slot of each chunk, and the chunk of each slot
        self.pool, self.pool_n = np.empty(1 << 16, np.uint32), 0
        self.at, self.n, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keeps the chunks that came more than once; of those the most frequent, if they are too many."""
        kept = np.flatnonzero(self.used > 1)
        kept = kept[kept > 0]  # slot 0 is the empty chunk
        if len(kept) > self.memo // 2:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: self.memo // 2]])
        names, n, ids = [self.names[k] for k in kept.tolist()], self.n[kept], self.pool[gathered(self.at[kept], self.n[kept])]
        self.start()
        self.keep(names, ids, n)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, chunks: list[str]) -> np.ndarray:
        """Ids of chunks with a mark after each."""
        gap = f" {self.mark} " if self.drops_space else self.mark
        return np.array(self.whole([gap.join(chunks) + gap.rstrip(" ")])[0], np.uint32)

    def marked(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that hold the mark."""
        return self.whole(chunks)

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not known yet; those without the mark go through the library many at a time, with marks between."""
        plain, rest = [c for c in chunks if self.mark not in c], [c for c in chunks if self.mark in c]
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(plain), 400):
            own = self.joined(plain[i : i + 400])
            ends = np.flatnonzero(own == self.mark_id)
            if len(ends) != len(plain[i : i + 400]):
                raise ValueError("a chunk changed beside its neighbours")
            ids.append(own[own != self.mark_id])
            counts.append(np.diff(np.concatenate([[-1], ends])) - 1)
        for own in self.marked(rest):
            ids.append(np.array(own, np.uint32))
            counts.append(np.array([len(own)]))
        self.keep(plain + rest, np.concatenate(ids), np.concatenate(counts).astype(np.int64))

    def keep(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.pool_n + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.pool_n : self.pool_n + len(ids)] = ids
        self.at = np.concatenate([self.at, self.pool_n + np.cumsum(counts) - counts])
        self.n = np.concatenate([self.n, counts])
        self.used = np.concatenate([self.used, np.zeros(len(counts), np.int64)])
        self.pool_n += len(ids)
        self.known.update(zip(chunks, range(len(self.names), len(self.names) + len(chunks))))
        self.names += chunks

    def slots(self, chunks: list[str]) -> np.ndarray:
        """The slots of distinct chunks, learnt where they are new."""
        if len(self.names) > self.memo:
            self.forget()
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        if len(new := np.flatnonzero(found < 0)):
            self.learn([chunks[k] for k in new.tolist()])
            found[new] = [self.known[chunks[k]] for k in new.tolist()]
        return found

    def chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slots of the texts' chunks, the number of chunks of each text, and which texts are odd (they have none)."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.odd else np.zeros(len(texts), bool)
        even = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
        if self.lead:
            even = pc.if_else(pc.equal(even, ""), "", pc.binary_join_element_wise(self.lead, even, ""))
        if self.drops_space:
            parts = pc.split_pattern(pc.replace_substring_regex(even, "[\\t\\n\\r]", " "), " ")
        else:
            parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(even, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
        sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        slots = self.slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self.used += np.bincount(slots, minlength=len(self.used))
        return slots, sizes, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of each text. A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        return self.ids_of(texts, *self.chunks(texts))

    def ids_of(self, texts: pa.Array, slots: np.ndarray, sizes: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` from the texts' chunks."""
        each = self.n[slots]
        ends = np.cumsum(each)
        ids = self.pool[gathered(self.at[slots], each)]
        text_ends = np.concatenate([[0], ends])[np.cumsum(sizes)]
        counts = np.diff(np.concatenate([[0], text_ends]))
        if odd.any():
            whole = self.whole([self.lead + x for x in texts.filter(pa.array(odd)).to_pylist()])
            own = dict(zip(np.flatnonzero(odd).tolist(), whole))
            starts = text_ends - counts
            ids = np.concatenate([np.array(own[i], np.uint32) if i in own else ids[starts[i] : text_ends[i]] for i in range(len(counts))] or [ids])
            for i, x in own.items():
                counts[i] = len(x)
        return ids, counts


def encoder(path: str, drops_space: bool) -> Encoder:
    """One for each worker process and vocabulary."""
    if (path, drops_space) not in _MADE:
        _MADE[path, drops_space] = Encoder(path, drops_space)
    return _MADE[path, drops_space]
