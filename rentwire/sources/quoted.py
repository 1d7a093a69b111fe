"""Large sheets with quoted cells, read by many tasks.

Whether a line begins inside a quoted cell depends on all lines before it. Each range of a file therefore says how it ends if it
begins outside quotes and how if it begins inside; these effects, one row a range, compose to the true state of each range.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rentwire.operators.tables import cut

from .sheets import as_cells

LINES = "sheet_id string, start long, place long, value string, begins array<boolean>, ends array<boolean>, n array<long>"


def walk(text: str, sep: str, inside: bool = False) -> tuple[list[tuple[int, int]], bool]:
    """Where each cell of a text begins and ends, and whether the last is still open. A quote opens a cell only at its start, a doubled one stands for itself."""
    found, at = [], 0
    while True:
        opened = inside or text.startswith('"', at)
        close = at
        if opened:
            close = text.find('"', at if inside else at + 1)
            while close >= 0 and text.startswith('"', close + 1):
                close = text.find('"', close + 2)
            if close < 0:
                return [*found, (at, len(text))], True
        inside = False
        end = text.find(sep, close + 1 if opened else at)
        found.append((at, len(text) if end < 0 else end))
        if end < 0:
            return found, False
        at = end + len(sep)


def plain(cell: str) -> str:
    """A cell without its quotes. One with text behind its closing quote stays as it is; one that nothing closes runs to its end."""
    if not cell.startswith('"'):
        return cell
    bare = cell.rstrip()
    closed = walk(bare, "\0")[1] is False
    if closed and not (len(bare) > 1 and bare.endswith('"') and walk(bare[:-1], "\0")[1]):
        return cell
    return (bare[1:-1] if closed else cell[1:]).replace('""', '"')


def marked(lines: DataFrame, sep: str, encoding: str) -> DataFrame:
    """LINES: of each line and both states that its range may begin in, the state at its ends and the records begun up to it."""
    utf8 = codecs.lookup(encoding).name == "utf-8"

    def run(batches):
        path, start, place, state, count = None, None, 0, [False, True], [0, 0]
        for batch in batches:
            paths, starts, raw = batch.column(0), batch.column(1), batch.column(2)
            values = raw.cast(pa.string()) if utf8 else pa.array([v.decode(encoding) for v in raw.to_pylist()], pa.string())
            quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
            filled = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(starts.to_numpy())) + 1
            if paths.slice(1) != paths.slice(0, max(len(paths) - 1, 0)):
                new = np.union1d(new, np.flatnonzero(pc.not_equal(paths.slice(1), paths.slice(0, len(paths) - 1)).to_numpy(zero_copy_only=False)) + 1)
            edges = [0, *new.tolist(), len(values)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if (paths[a].as_py(), starts[a].as_py()) != (path, start):
                    path, start, place, state, count = paths[a].as_py(), starts[a].as_py(), 0, [False, True], [0, 0]
                own = values.slice(a, b - a)
                if utf8 and start == 0 and place == 0 and own[0].as_py().startswith("﻿"):
                    own = pa.concat_arrays([pa.array([own[0].as_py()[1:]], pa.string()), own.slice(1)])
                at = np.flatnonzero(quoted[a:b])
                begins, ends, n = [], [], []
                for h in (0, 1):
                    after, now = np.empty(len(at), bool), state[h]
                    for k, j in enumerate(at):
                        after[k] = now = walk(own[int(j)].as_py(), sep, now)[1]
                    end = np.concatenate([[state[h]], after])[np.cumsum(quoted[a:b])]  # the state behind the last quoted line up to here
                    begin = np.concatenate([[state[h]], end[:-1]])
                    so_far = count[h] + np.cumsum(~begin & filled[a:b])
                    state[h], count[h] = bool(end[-1]), int(so_far[-1])
                    begins.append(begin), ends.append(end), n.append(so_far)
                pair = lambda xs, kind: pa.ListArray.from_arrays(np.arange(0, 2 * (b - a) + 1, 2, dtype=np.int32), pa.array(np.stack(xs, 1).ravel(), kind))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [paths.slice(a, b - a), starts.slice(a, b - a), pa.array(np.arange(place, place + b - a), pa.int64()), own, pair(begins, pa.bool_()), pair(ends, pa.bool_()), pair(n, pa.int64())],
                    ["sheet_id", "start", "place", "value", "begins", "ends", "n"],
                )
                place += b - a

    return lines.mapInArrow(run, LINES)


def begun(ranges: DataFrame) -> DataFrame:
    """sheet_id, start, state (1: the range begins inside quotes), base (records begun before it) of (sheet_id, start, ends, n) of whole ranges.

    A range's effect keeps the state, turns it, or sets it. So the state is what the last setting range left, turned once for each
    turning range since. The window of a sheet holds a row for each range.
    """
    before = W.partitionBy("sheet_id").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    outside, inside = F.col("ends")[0], F.col("ends")[1]
    turns = ranges.withColumn("turn", (outside & ~inside).cast("long")).withColumn("turned", F.coalesce(F.sum("turn").over(before), F.lit(0)))
    last = F.last(F.when(outside == inside, F.struct(outside.cast("long").alias("left"), "turned")), ignorenulls=True).over(before)
    state = turns.withColumn("last", last).withColumn("state", ((F.coalesce("last.left", F.lit(0)) + F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2).cast("int"))
    return state.select("sheet_id", "start", "state", F.coalesce(F.sum(F.get("n", F.col("state"))).over(before), F.lit(0)).alias("base"))


def cells_of(records: DataFrame, sep: str) -> DataFrame:
    """sheet_id, row_no, cells of (sheet_id, row_no, value) with a record each."""

    def run(batches):
        for batch in batches:
            cells = [[plain(v[a:b]) for a, b in walk(v, sep)[0]] if '"' in v else v.split(sep) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], ["sheet_id", "row_no", "cells"])

    return records.select("sheet_id", "row_no", "value").mapInArrow(run, "sheet_id string, row_no long, cells array<string>")


def read_rows(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", scratch: list[str] | None = None) -> DataFrame:
    """sheet_id, row_no (from 0), cells of delimited files, whose quoted cells may hold line breaks (read as line feeds); empty lines are no rows.

    Files are split into ranges as Spark splits text, so one large file is read by many tasks. Its lines are written once, with both
    states. Only the lines of records over several lines are shuffled; a quote that nothing closes makes the rest of its file one
    cell. encoding: one that writes ASCII as ASCII. scratch: gets the path of the table of lines.
    """
    if "\n".encode(encoding) != b"\n":
        raise ValueError(f"{encoding} cannot be split at lines")
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("sheet_id"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    lines = cut(marked(text, sep, encoding), scratch)
    whole = lines.groupBy("sheet_id", "start").agg(F.max_by(F.struct("ends", "n"), "place").alias("last")).select("sheet_id", "start", "last.ends", "last.n")
    known = cut(begun(whole), scratch)  # a row a range: Spark broadcasts it while it is small

    def true(column: str) -> Column:
        return F.get(column, F.col("state"))

    placed = lines.join(known, ["sheet_id", "start"]).select("sheet_id", (F.col("base") + true("n") - 1).alias("row_no"), "start", "place", "value", true("begins").alias("begins"), true("ends").alias("ends"))
    single = placed.filter("not begins and not ends and value <> ''").select("sheet_id", "row_no", "value")
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "value")))
    joined = placed.filter("begins or ends").groupBy("sheet_id", "row_no").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))
    return cells_of(single.unionByName(joined), sep)


def read_cells(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8", scratch: list[str] | None = None) -> DataFrame:
    """sheet_id, row_no, col_no, value of filled cells, as ``sheets.read_cells`` gives them, with large files split over tasks."""
    return as_cells(read_rows(spark, path, sep, encoding, scratch))
