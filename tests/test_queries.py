"""Registered queries against their DuckDB forms on the smallest tables."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rentwire.operators import filters, stories
from rentwire.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [n for n in ORACLES if n.split("_")[0] in {"L14", "L17", "L20", "L21", "L29", "L32", "L35", "L37", "L39", "L43", "L44", "L46", "L48", "L49", "L50", "L1", "L2", "L3", "L4", "L6", "L8", "L9", "L26", "L28", "L33", "L52", "L55", "N11", "N14", "N17", "N30", "L56", "L58", "L64", "L66", "N1", "N6", "N7", "N19", "N23", "N28"}]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    c = con.execute(ORACLES[name])
    at = [[x[0] for x in c.description].index(k) for k in columns]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in c.fetchall()), key=repr)


def test_filters_in_words():
    f = filters.Filters(cities=tuple(f"c{k}" for k in range(14)), area_leased=(1, None), mapped_only=True)
    assert filters.describe(f) == ["City: " + ", ".join(f"c{k}" for k in range(12)) + " and 2 more", "Area leased: from 1", "Mapped deals only"]


def greedy(articles):
    """The clustering rule over all articles, in plain Python."""
    rows = sorted(articles, key=lambda a: (-a["score"], a["seq"]))
    out, clusters = {}, []
    for a in rows:
        t = set(a["title"].lower().split())
        for c in clusters:
            u = t | c["t"]
            if a["url"] in c["urls"] or a["title"].lower() in c["norms"] or (u and len(t & c["t"]) / len(u) >= 0.8):
                out[a["seq"]] = (c["id"], "duplicate" if a["source"] in c["sources"] else "corroborator")
                c["urls"].add(a["url"]), c["norms"].add(a["title"].lower()), c["sources"].add(a["source"])
                break
        else:
            clusters.append({"id": a["seq"], "t": t, "urls": {a["url"]}, "norms": {a["title"].lower()}, "sources": {a["source"]}})
            out[a["seq"]] = (a["seq"], "primary")
    return out


def test_clusters_equal_the_greedy_rule(spark):
    r = random.Random(3)
    words = "clinic opens tower nurses strike grant lab".split()
    articles = []
    for k in range(80):
        title = " ".join(r.choice(words) for _ in range(r.randint(3, 7)))
        articles.append({"seq": k, "title": title, "summary": "", "source": f"s{r.randint(0, 3)}", "url": f"u{r.randint(0, 70)}", "score": r.randint(0, 5), "published": 1})
    df = spark.createDataFrame([(a["seq"], a["title"], "", a["source"], a["url"], a["score"]) for a in articles], "seq long, title string, summary string, source string, url string, score int").withColumn("published", F.lit("2024-01-01").cast("timestamp"))
    got = {x.seq: (x.cluster_id, x.role) for x in stories.cluster(df.repartition(8)).collect()}
    assert got == greedy(articles)
