"""Sheets: reading, header rows, the field table and numbering."""

import pytest
from pyspark.sql import functions as F

from rentwire.operators import headers, shapes
from rentwire.operators.tables import numbered
from rentwire.sources import sheets


def test_read_cells(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("a,b\n" + ",".join(f"v{k}" for k in range(400)) + "\n\n" + '"x ""q"", y","two\nlines, 1,2,3",\n')
    got = {(r.row_no, r.col_no): r.value for r in sheets.read_cells(spark, str(tmp_path)).collect()}
    rows = sorted({k for k, _ in got})
    assert len(got) == 2 + 400 + 2 and got[rows[1], 399] == "v399" and got[rows[2], 0] == 'x "q", y' and got[rows[2], 1] == "two\nlines, 1,2,3"
    with pytest.raises(Exception, match="FAILED_READ_FILE|out of bounds"):
        sheets.read_cells(spark, str(tmp_path), columns=3).count()
    (tmp_path / "tabs").mkdir()
    (tmp_path / "tabs" / "t.tsv").write_text("a\tb, c\n1\t2\n")
    assert sheets.read_cells(spark, str(tmp_path / "tabs"), sep="\t", multi_line=False).count() == 4


def cells(spark, rows):
    return sheets.as_cells(spark.createDataFrame([("s", n, r) for n, r in rows], "sheet_id string, row_no long, cells array<string>"))


def test_header_behind_many_blank_rows(spark):
    c = cells(spark, [(5000, ["Address", "City", "Rent"]), *((5001 + k, [f"{k} Oak St", "Austin", str(k)]) for k in range(40))])
    heads = sheets.header_rows(c)
    assert heads.first().row_no == 5000
    got = sheets.records(c, heads, sheets.header_names(c, heads)).orderBy("source_row").collect()
    assert [r.source_row for r in got] == list(range(1, 41)) and got[7].record == {"Address": "7 Oak St", "City": "Austin", "Rent": "7"}
    assert sheets.sheet_errors(c, heads).count() == 0
    only = cells(spark, [(0, ["Address", "City"])])
    assert sheets.sheet_errors(only, sheets.header_rows(only)).first().error == "no data rows"


def test_numbers_run_over_tasks(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 8, F.lit("big")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"), (F.col("id") * 7919 % 1009).alias("o"))
    got = numbered(df, "g", "o", "n").collect()
    for g in {r.g for r in got}:
        own = sorted((r.n, r.o) for r in got if r.g == g)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [o for _, o in own] == sorted(o for _, o in own)


def test_every_export_header_leads_back_to_its_field(spark):
    assert len(headers.FIELDS) == 51 and len(sheets.EXPORT) == 45
    names = [h for h, _ in sheets.EXPORT]
    mapped = headers.assign(headers.score(spark.createDataFrame([("s", h) for h in names], "sheet_id string, header string"), headers.field_table(spark)))
    got = {r.header: r.field for r in mapped.collect()}
    assert got == {header: headers.OF_COLUMN.get(column, headers.camel(column)) for header, column in sheets.EXPORT}


def test_shapes():
    box = shapes.Shape("rectangle", ((30.0, -98.0), (30.1, -97.9)))
    circle = shapes.Shape("circle", ((30.0, -97.0),), 1609.34)
    triangle = shapes.Shape("polygon", ((30.0, -98.0), (30.1, -98.0), (30.0, -97.9)))
    assert shapes.bounds(box) == (30.0, -98.0, 30.1, -97.9) and shapes.bounds(triangle) == (30.0, -98.0, 30.1, -97.9)
    south, west, north, east = shapes.bounds(circle)
    assert north - south == pytest.approx(0.02895, abs=1e-4) and east - west == pytest.approx(0.03343, abs=1e-4)
    assert [shapes.area_label(s) for s in (box, circle, shapes.Shape("circle", ((0, 0),), 100.0))] == ["41.3 sq mi", "3.14 sq mi", "8 acres"]
    assert shapes.area(triangle) == pytest.approx(shapes.area(box) / 2, rel=0.01) and shapes.area(shapes.Shape("polygon", ((0, 0), (1, 1)))) == 0
    assert [shapes.label(s) for s in (triangle, box, circle)] == ["Polygon · 3 points", "Rectangle", "Radius · 1.00 mi"]
