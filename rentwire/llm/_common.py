"""What the operators share: shared-folder tables, slicing of Arrow batches and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from rentwire.operators.tables import cut, discard, partitions, shared_folder  # noqa: F401

U = np.uint64
#: ASCII white space, the word separator of the near-duplicate contract.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: StructType, kinds: dict[str, str]) -> StructType:
    """A schema with more columns, given as {name: SQL type}."""
    return StructType([*schema.fields, *(StructField(n, StructType.fromDDL(f"x {k}")["x"].dataType) for n, k in kinds.items())])


def slices(batches, column: str, most_bytes: int = 1_500_000, most_rows: int = 4096):
    """Record batches in slices of bounded text, so that a task's memory follows its longest text and not its batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1
            stop = min(max(at + 1, stop), at + most_rows, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, and the offsets of its rows (a null row is empty)."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gathered(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] places), then those from first[1] on, and so on."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def keys(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_POSITION = keys(256, 7)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


LOWER = lower_table()


def separators(values) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(values)] = True
    return t


class Words:
    """Words of many texts: byte range, text number and a 64-bit hash of the A-Z lower-cased bytes of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray):
        global _POSITION
        self.low = LOWER[raw]
        inside = ~separator[self.low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        borders = offsets[1:-1]
        borders = borders[borders < len(raw)]
        first[borders] = inside[borders]
        where = np.flatnonzero(inside)
        self.start = np.flatnonzero(first)
        heads = np.searchsorted(where, self.start)
        length = np.diff(np.append(heads, len(where)))
        self.end = self.start + length
        self.bounds = np.searchsorted(self.start, offsets)  # first word of each text, and the end
        if len(self.start):
            if (longest := int(length.max())) > len(_POSITION):
                _POSITION = keys(longest * 2, 7)
            position = where - np.repeat(self.start, length)
            term = (self.low[where].astype(U) + U(1)) * _POSITION[position]
            self.hash = mix(np.add.reduceat(term, heads) + length.astype(U))
        else:
            self.hash = np.empty(0, U)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)
