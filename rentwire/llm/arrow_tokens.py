"""Token ids in Arrow's file format (operator 7).

The ids of all documents, in ascending doc_id order, are one stream, cut into sequences of equal length. Each partition
of the range-sorted documents writes its stretch of the stream as one IPC file of record batches that hold fixed-size
lists (ids and a mask), so any sequence is read from a memory map without a copy, and beside it an IPC file with the
documents' places. Only the last sequence of a file is padded; the mask says where.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import partitions, shared_folder, slices
from .tokenize import SLICE, encoder, vocabulary_path

#: Sequences in a record batch.
IN_BATCH = 64
PLACES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def token_schema(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(id_type, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


class Sink:
    """Writes one IPC file under a name of its own and renames it at the end, so that a task that runs twice leaves one whole file."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.stream, schema)

    def close(self) -> None:
        self.writer.close()
        self.stream.close()
        self.fs.move(self.own, self.path)


def mapped(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A reader over a memory map where the folder is mounted, else over the store's random-access file."""
    store, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (no copy) and mask of sequence k of a file."""
    row = reader.get_batch(k // IN_BATCH).slice(k % IN_BATCH, 1)
    return row.column("ids").flatten().to_numpy(), row.column("mask").flatten().to_numpy(zero_copy_only=False)


def write_tokens(docs: DataFrame, folder: str, length: int = 2048, vocabulary: str | None = None, end_id: int = 2, drops_space: bool = True) -> DataFrame:
    """Writes the files and returns a row for each: part, n_docs, n_tokens, in the order of the stream.

    The sort puts a null doc_id first and repeated doc_ids in the order of their texts' hashes. A null or empty text
    is the end id alone. ``folder`` is a URI that every executor reaches.
    """
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")

    def run(batches):
        part, encode = TaskContext.get().partitionId(), encoder(vocabulary, drops_space)
        small = encode.size <= 65536
        dtype, arrow = (np.uint16, pa.uint16()) if small else (np.uint32, pa.uint32())
        schema = token_schema(length, arrow)
        sinks, rest, n_docs, n_tokens = [], np.empty(0, dtype), 0, 0

        def put(ids: np.ndarray, n: int) -> None:
            mask = np.arange(len(ids)) < n
            sinks[0].writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

        for some in slices(batches, "text", most_bytes=SLICE):
            if not sinks:
                sinks = [Sink(f"{folder}/tokens-{part:06d}.arrow", schema), Sink(f"{folder}/places-{part:06d}.arrow", PLACES)]
            ids, counts = encode.encode(some.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id).astype(dtype)
            n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
            sinks[1].writer.write_batch(pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts + 1, pa.int64())], schema=PLACES))
            rest = np.concatenate([rest, ids])
            while len(rest) >= IN_BATCH * length:
                put(rest[: IN_BATCH * length], IN_BATCH * length)
                rest = rest[IN_BATCH * length :]
        if sinks:
            if len(rest):
                put(np.pad(rest, (0, -len(rest) % length)), len(rest))
            for x in sinks:
                x.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["part", "n_docs", "n_tokens"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    return plain.repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie).mapInArrow(run, "part int, n_docs long, n_tokens long")


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[int, int]]) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32. files: (part, ids before it), one small row for each file."""

    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                tokens, places = mapped(f"{folder}/tokens-{part:06d}.arrow"), mapped(f"{folder}/places-{part:06d}.arrow")
                held, held_at, k = np.empty(0, np.uint32), 0, 0  # a moving stretch of the stream
                at = 0
                for i in range(places.num_record_batches):
                    rows = places.get_batch(i)
                    counts = rows.column("n_tokens").to_numpy()
                    ends = at + np.cumsum(counts)
                    more = [held[at - held_at :]]
                    have = held_at + len(held)
                    while have < ends[-1]:
                        got = tokens.get_batch(k)
                        ids = got.column("ids").flatten().to_numpy()[got.column("mask").flatten().to_numpy(zero_copy_only=False)]
                        more.append(ids)
                        have, k = have + len(ids), k + 1
                    held, held_at = np.concatenate(more), at
                    little = held.astype("<u4")
                    crc = [zlib.crc32(little[e - n - held_at : e - held_at]) for e, n in zip(ends.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(base + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = int(ends[-1])

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    rows = spark.createDataFrame(files or [], "part int, base long")
    return rows.repartition(max(1, len(files))).mapInArrow(run, kind)


def token_files(docs: DataFrame, **options) -> tuple[str, list[tuple[int, int]]]:
    """Writes the files into the shared folder; returns it and, for each file, its number and the ids before it.

    What comes to the driver is one row for each partition.
    """
    folder = shared_folder(docs.sparkSession)
    files, base = [], 0
    for row in sorted(write_tokens(docs, folder, **options).collect()):
        files.append((row.part, base))
        base += row.n_tokens
    return folder, files


def store_and_read(docs: DataFrame, **options) -> DataFrame:
    """token_files, then read_tokens. An empty table gives no files and no rows."""
    folder, files = token_files(docs, **options)
    return read_tokens(docs.sparkSession, folder, files)
