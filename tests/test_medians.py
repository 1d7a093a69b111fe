"""Medians against Python's, over groups that are hot, tied, empty or of one value, with few and many rounds; pages by rank."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from rentwire.operators import filters, medians


@pytest.mark.parametrize("most, ranges", [(10_000, 64), (5, 64), (2, 3)])
def test_medians_equal_pythons(spark, monkeypatch, most, ranges):
    monkeypatch.setattr(medians, "MOST", most)
    monkeypatch.setattr(medians, "RANGES", ranges)
    r = random.Random(most)
    rows = [("hot", float(int(r.expovariate(1e-3))), r.choice((1, 2, 2, 2, 9))) for _ in range(1500)]
    rows += [("wide", 10.0 ** r.uniform(-200, 200), k) for k in range(301)] + [("two", 1.0, 5), ("two", 4.0, None), ("none", None, None), (None, -3.5, 7), ("nan", float("nan"), 1), ("same", 8.0, 8)]
    rows += [("same", 8.0, None)] * 400 + [("even", float(k), k % 2) for k in range(800)]
    df = spark.createDataFrame(rows, "g string, x double, y int").repartition(5)
    got = {row.g: (row.mx, row.my) for row in medians.medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}).collect()}
    mid = lambda vs: statistics.median(vs) if (vs := [float(v) for v in vs if v is not None and v == v]) else None
    assert got == {g: (mid([x for k, x, _ in rows if k == g]), mid([y for k, _, y in rows if k == g])) for g in {k for k, _, _ in rows}}
    whole = medians.medians(df, [], {"m": F.col("x")}).collect()
    assert [tuple(x) for x in whole] == [(mid([x for _, x, _ in rows]),)]
    assert [tuple(x) for x in medians.medians(df.limit(0), [], {"m": F.col("x")}).collect()] == [(None,)] and medians.medians(df.limit(0), ["g"], {"m": F.col("x")}).count() == 0


def test_pages_by_rank(spark):
    r = random.Random(2)
    rows = [(k, r.choice(("b", "A", " a ", "", None, "c")), r.choice((None, 1.0, 2.0, float(k)))) for k in range(3000)]
    deals = spark.createDataFrame(rows, "source_row long, city string, area_leased double").repartition(6)
    index = filters.page_index(deals, "area_leased", True)
    want = sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[0]))
    for number in (1, 2, 57, 150):
        assert [x.source_row for x in index.page(number, 20).collect()] == [x[0] for x in want[(number - 1) * 20 : number * 20]]
    assert index.page(151, 20).count() == index.page(10**9, 20).count() == 0
    assert sum(x.source_row for x in index.page(1, 3000).collect()) == sum(range(3000)) and index.rows == 3000
    assert len(index.parts(57, 20)) <= 2
    text = filters.page_index(deals, "city", False)
    want = sorted(rows, key=lambda x: (not (x[1] or "").strip(), (x[1] or "").strip().lower(), x[0]))
    assert [x.source_row for x in text.page(30, 50).collect()] == [x[0] for x in want[1450:1500]]
    assert filters.page_index(deals.limit(0), "city").page(1, 10).count() == 0
