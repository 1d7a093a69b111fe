"""Terms by posting lists, and footprints in crowded blocks, against brute force."""

import random

from pyspark.sql import functions as F

from rentwire.operators import cover, places, shapes, term_index

SITE = "site_id string, lat double, lon double, label string, city string, grade string, deals long"


def test_index_finds_what_the_scan_finds(spark):
    draw = random.Random(3)
    words = ["Oak", "oakland", "a", "Ak", "éa", "Tower", "TOWERS", "wert", "😀x", "x", "aaaa", "aaa", "St. %_"]
    rows = [(f"s{k}", 0.0, 0.0, None if k % 50 == 0 else " ".join(draw.choices(words, k=draw.randint(0, 4))), draw.choice([None, "", "Oakland", "Tow er"]), "rooftop", draw.randint(1, 3)) for k in range(400)]
    site = spark.createDataFrame(rows, SITE)
    index = places.site_index(site)
    for query in ("oak", "OAKLAND tow", "a", "aaaa", "aaaaa", "tower", "towers wert", "😀", "é", " oak  tower ", "%_", "nothing", "", "x a", "er"):
        for most in (12, 1000):
            slow = [r.site_id for r in places.search_sites(site, query, most).collect()]
            assert [r.site_id for r in places.search_index(index, query, most).collect()] == slow, query
        known = {r.site_id for r in index.rows.join(term_index.holding(index, query), "rank", "left_semi").collect()}
        assert not query.split() or known == {r[0] for r in rows if all(t in f"{r[3] or ''} {r[4] or ''}".lower() for t in query.lower().split())}
    empty = places.site_index(site.limit(0))
    assert places.search_index(empty, "oak").count() == 0


def test_posting_lists_are_told_to_the_scan(spark):
    site = spark.createDataFrame([("s1", 0.0, 0.0, "Oak Tower", "X", "rooftop", 1)], SITE)
    index = places.site_index(site)
    plan = term_index.holding(index, "tower ow")._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(In(gram, [tow,wer]),StringStartsWith(gram,ow))]" in plan or "StringStartsWith(gram,ow)" in plan
    assert plan.count("FileScan parquet") == 2 and "label" not in plan.split("== Physical Plan ==")[1]


def ring(y, x, dy, dx, turn=False):
    out = [(x - dx, y - dy), (x + dx, y - dy), (x + dx, y + dy), (x - dx, y + dy)]
    return out[::-1] if turn else out


def test_crowded_block_equals_brute_force(spark):
    draw = random.Random(9)
    site = [(f"s{k}", 30 + draw.random() * 0.004, -97 + draw.random() * 0.004, f"l{k % 7}", "c", "rooftop" if k % 9 else "parcel", k % 5) for k in range(600)]
    site += [("null", None, None, "n", "c", "rooftop", 1), ("twin", site[0][1], site[0][2], "l0", "c", "rooftop", 9)]
    prints = []
    for k in range(150):
        y, x = 30 + draw.random() * 0.004, -97 + draw.random() * 0.004
        parts = [[ring(y, x, 0.0001 + draw.random() * 0.0004, 0.0001 + draw.random() * 0.0004), *([ring(y, x, 0.00005, 0.00005)] if k % 3 == 0 else [])]]
        if k % 4 == 0:
            parts.append([ring(y + 0.001, x, 0.0002, 0.0002, True)])
        prints.append((f"f{k}", parts))
    prints += [("campus", [[ring(30.002, -96.998, 0.002, 0.002)]]), ("none", []), prints[0]]
    sites = spark.createDataFrame(site, SITE)
    footprints = spark.createDataFrame(prints, "footprint_id string, parts array<array<array<struct<lng:double,lat:double>>>>")
    parts = places.footprint_parts(footprints).filter((F.col("area") > 0) & (F.col("area") <= places.LARGEST)).dropDuplicates()
    pairs = sites.crossJoin(parts).filter(places.part_contains(F.col("part"), F.col("lat"), F.col("lon"))).select("site_id", "footprint_id", "part_no", "area", "key", "deals", "label", "grade").collect()
    got = {(r.site_id, r.footprint_id, r.part_no) for r in places.sites_in_parts(sites, parts).collect()}
    assert got == {(r.site_id, r.footprint_id, r.part_no) for r in pairs} and len(got) > 300
    best = {}
    for r in pairs:
        if r.grade == "rooftop":
            best[r.site_id] = min(best.get(r.site_id, (9e9,)), (r.area, r.footprint_id, r.part_no, r.key, -r.deals, r.label, r.site_id))
    taken = {}
    for v in best.values():
        taken[v[3]] = min(taken.get(v[3], (1,)), v[4:] + (v[1],))
    assert {(r.site_id, r.footprint_id) for r in places.match_footprints(sites, footprints).collect()} == {(v[2], v[3]) for v in taken.values()}
    outline = F.transform(F.element_at("part", 1), lambda v: F.struct(v["lat"].alias("lat"), v["lng"].alias("lon")))
    drawn = parts.select(F.concat_ws("#", "footprint_id", "part_no").alias("shape_id"), F.lit("polygon").alias("kind"), outline.alias("ring"), F.lit(0.0).alias("radius"))
    keys = cover.cover(drawn, places.FOOTPRINT_CELLS).groupBy("level", "cy", "cx").count().count()
    assert keys > 500  # the block, one cell of the earlier grid, is many keys
