"""Points in a table of shapes against each shape tested on each point."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentwire.operators import cover, shapes


def drawn(r):
    made = []
    for k in range(60):
        lat, lon, size = r.uniform(-70, 75), r.uniform(-170, 170), r.choice((0.0004, 0.05, 1.5, 9.0))
        kind = ("polygon", "circle", "rectangle")[k % 3]
        if kind == "polygon":
            ring = [(lat + r.uniform(-size, size), lon + r.uniform(-size, size)) for _ in range(r.randint(3, 40))]
        elif kind == "circle":
            ring = [(lat, lon)]
        else:
            ring = [(lat - size, lon - size), (lat + size, lon + size)]
        made.append((f"s{k}", kind, ring, size * 90_000 if kind == "circle" else 0.0))
    return [*made, ("line", "polygon", [(1.0, 1.0), (2.0, 2.0)], 0.0), ("none", "polygon", [], 0.0)]


@pytest.mark.parametrize("most", [4, 96, 2000])
def test_points_in_shapes_equal_each_tested_alone(spark, most):
    r = random.Random(most)
    made = drawn(r)
    points = []
    for _, _, ring, radius in made:
        for _ in range(40):
            lat, lon = r.choice(ring) if ring else (0.0, 0.0)
            far = max(radius / 90_000, max((abs(a - b) for p in ring for q in ring for a, b in zip(p, q)), default=1.0))
            points.append((len(points), lat + r.uniform(-far, far), lon + r.uniform(-far, far)))
        points += [(len(points), *p) for p in ring[:2]]
    points = [(k, lat, lon) for k, (_, lat, lon) in enumerate(points)]
    df = spark.createDataFrame([*points, (-1, None, 1.0), (-2, 1.0, None)], "id long, lat double, lon double")
    table = spark.createDataFrame(made, "shape_id string, kind string, ring array<struct<lat:double,lon:double>>, radius double")
    got = sorted(tuple(x) for x in cover.inside(df, table, most).select("id", "shape_id").collect())
    want = []
    for shape_id, kind, ring, radius in made:
        if ring:
            one = shapes.contains(shapes.Shape(kind, tuple(ring), radius), F.col("lat"), F.col("lon"))
            want += [(x.id, shape_id) for x in df.filter("lat is not null and lon is not null").filter(one).select("id").collect()]
    assert got == sorted(want) and len(got) > 300


def test_cells_inside_need_no_test():
    ring = np.array([(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)])
    few, many = (cover.cells("polygon", ring, 0.0, n) for n in (30, 3000))
    area = lambda found: sum(np.prod(cover.sides(level)) for level, *_, sure in found if sure)
    assert len(few) <= 60 and len(many) <= 6000 and 30 < area(few) < area(many) < 100 < sum(np.prod(cover.sides(level)) for level, *_ in many)
    assert len({c[:3] for c in many}) == len(many)


def test_counts_equal_the_points_inside(spark):
    r = random.Random(5)
    made = drawn(r)
    places = [(lat + r.uniform(-0.1, 0.1), lon + r.uniform(-0.1, 0.1)) for _, _, ring, _ in made for lat, lon in ring[:3]]
    points = [*(r.choice(places) for _ in range(3000)), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame(points, "lat double, lon double")
    table = spark.createDataFrame(made, "shape_id string, kind string, ring array<struct<lat:double,lon:double>>, radius double").coalesce(1)
    want = {x.shape_id: x["count"] for x in cover.inside(df, table).groupBy("shape_id").count().collect()}
    assert {x.shape_id: x.n for x in cover.counts(df, table).collect()} == want and sum(want.values()) > 500
    assert cover.counts(df, table.limit(0)).count() == 0
    assert cover.cover(table).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_ring_is_made_once_a_row(spark):
    df = spark.createDataFrame([(31.0, -97.5, 5000.0)], "lat double, lon double, radius double")
    area = df.select(shapes.ring_area(shapes.circle_ring(F.col("lat"), F.col("lon"), F.col("radius"))).alias("a"))
    assert area._jdf.queryExecution().optimizedPlan().toString().lower().count("atan2") == 1
    assert abs(area.first().a / (np.pi * 5000.0**2) - 1) < 0.01
