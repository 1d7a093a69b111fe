"""Sheets whose files are split over tasks, although cells hold line breaks."""

import random

import pytest

from rentwire.sources import quoted, sheets


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def rows_of(df):
    return {(r.sheet_id[-5:], r.row_no, r.col_no): r.value for r in df.collect()}


def test_split_files_equal_the_reader_of_whole_files(spark, tmp_path, small_ranges):
    draw = random.Random(5)
    pieces = ["a", 'say ""hi""', "x,y", "one\ntwo", "\n\n", "é", ",\n,", '""']
    for name in ("a.csv", "b.csv"):
        out = []
        for k in range(300):
            cells = [f'"{"".join(draw.choices(pieces, k=draw.randint(0, 9)))}"' if draw.random() < 0.4 else draw.choice(["plain", "", "5' wide", 'a 6" pipe']) for _ in range(draw.randint(2, 5))]
            out.append(",".join(cells))
            if k % 17 == 0:
                out.append("")
        (tmp_path / name).write_text("\n".join(out) + "\n", encoding="utf-8")
    got = quoted.read_rows(spark, str(tmp_path))
    ours = rows_of(sheets.as_cells(got))
    assert ours == rows_of(sheets.read_cells(spark, str(tmp_path), columns=40)) and len(ours) > 1000
    text = spark.read.text(str(tmp_path))
    assert text.rdd.getNumPartitions() > 20


def test_a_cell_over_many_ranges_and_odd_files(spark, tmp_path, small_ranges):
    long = "line of text\n" * 400
    (tmp_path / "l.csv").write_bytes(('﻿id,note\n1,"' + long + '"\n2,"b"\r\n3,"c\r\nd"\r\n').encode())
    (tmp_path / "z.csv").write_text("")
    got = rows_of(quoted.read_cells(spark, str(tmp_path)))
    assert got == {("l.csv", 0, 0): "id", ("l.csv", 0, 1): "note", ("l.csv", 1, 0): "1", ("l.csv", 1, 1): long, ("l.csv", 2, 0): "2", ("l.csv", 2, 1): "b", ("l.csv", 3, 0): "3", ("l.csv", 3, 1): "c\nd"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "w.tsv").write_bytes('caf\xe9\t"x\ty"\n1\t"open\nto the end'.encode("latin-1"))
    got = rows_of(quoted.read_cells(spark, str(tmp_path / "one"), sep="\t", encoding="latin-1"))
    assert got == {("w.tsv", 0, 0): "café", ("w.tsv", 0, 1): "x\ty", ("w.tsv", 1, 0): "1", ("w.tsv", 1, 1): "open\nto the end"}
    with pytest.raises(ValueError, match="split at lines"):
        quoted.read_cells(spark, str(tmp_path), encoding="utf-16")


def test_states_compose(spark):
    kinds = {"keep": [False, True], "turn": [True, False], "open": [True, True], "shut": [False, False]}
    draw = random.Random(1)
    for trial in range(5):
        names = [draw.choice(list(kinds)) for _ in range(60)]
        rows = [("s", 10 * k, kinds[x], [3, 5]) for k, x in enumerate(names)]
        got = {r.start: (r.state, r.base) for r in quoted.begun(spark.createDataFrame(rows, "sheet_id string, start long, ends array<boolean>, n array<long>")).collect()}
        state, base = 0, 0
        for k, x in enumerate(names):
            assert got[10 * k] == (state, base)
            base += (3, 5)[state]
            state = int(kinds[x][state])
