"""Stories, verdicts, counts, the digest and the scan on a small set of articles with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentwire.operators import items, stories
from rentwire.operators.items import Vocabulary
from rentwire.plans import brief
from rentwire.streaming import scan

#: seq, title, summary, source, url, score, minutes, category
ROWS = [
    (1, "Clinic opens in Tacoma with 200 jobs", "The clinic cost $150 million.", "Herald", "https://h.example.com/1", 9, 10, "hospitals"),
    (2, "Clinic opens in Tacoma with 200 jobs", "It cost $120 million.", "Tribune", "https://t.example.com/2", 8, 20, "hospitals"),
    (3, "Clinic opens in Tacoma with 200 jobs today", "", "Herald", "https://h.example.com/3", 7, 30, "hospitals"),
    (4, "Nurses strike at three hospitals", "1,200 nurses strike.", "Herald", "https://h.example.com/4", 6, 40, "workforce"),
    (5, "Three hospitals face nurses strike", "About 1,200 nurses strike.", "Post", "https://p.example.com/5", 5, 50, "workforce"),
    (6, "Biotech leases 40,000 square feet", "", "Wire", "https://w.example.com/6", 4, 60, "life_sciences"),
    (7, "Another headline altogether", "", "Blog", "https://w.example.com/6/#top", 3, 70, "life_sciences"),
    (8, "Three hospitals face nurses walkout", "Some 90 nurses.", "Blog", "https://b.example.com/8", 2, 80, "workforce"),
]


@pytest.fixture(scope="module")
def articles(spark):
    df = spark.createDataFrame(ROWS, "seq long, title string, summary string, source string, url string, score int, minutes int, category string")
    return df.withColumn("published", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("minutes") * 60))


@pytest.fixture(scope="module")
def clustered(articles):
    from rentwire.operators.tables import cut

    return cut(stories.cluster(articles))


def test_clusters(articles, clustered):
    got = {r.seq: (r.cluster_id, r.role) for r in clustered.collect()}
    assert got == {
        1: (1, "primary"), 2: (1, "corroborator"), 3: (1, "duplicate"), 4: (4, "primary"), 5: (4, "corroborator"),  # alike at 0.6, with the same headcount
        6: (6, "primary"), 7: (6, "corroborator"), 8: (8, "primary"),  # 7 by its url alone; 8 is alike at 0.45 or less, or without a figure in common
    }
    assert sorted(r.seq for r in stories.dedupe(articles, clustered).collect()) == [1, 4, 6, 8]


def test_verdicts(articles, clustered):
    judged = stories.verdicts(articles, clustered)
    got = {r.cluster_id: (r.sources, r.verdict, r.details) for r in judged.collect()}
    assert got == {
        1: (["Herald", "Tribune"], "discrepancy", ["dollar amount differs: Herald reports $150M, Tribune reports $120M"]),
        4: (["Herald", "Post"], "corroborated", ["Consistent across two sources: Herald and Post."]),
        6: (["Wire", "Blog"], "corroborated", ["Consistent across two sources: Wire and Blog."]),
        8: (["Blog"], "single-source", ["Only Blog reported this story in this scan. Details are not yet corroborated elsewhere."]),
    }
    assert {r.verdict: r.n for r in stories.verdict_counts(judged).collect()} == {"discrepancy": 1, "corroborated": 2, "single-source": 1}


def test_digest(articles, clustered):
    d = brief.digest(stories.dedupe(articles, clustered), stories.verdicts(articles, clustered), ("hospitals", "workforce", "life_sciences")).first()
    assert (d.stories, d.busiest, d.busiest_n, d.corroborated, d.discrepancy, d.single_source, d.line) == (4, "workforce", 2, 2, 1, 1, "two stories corroborated")
    assert [tuple(x) for x in d.leads] == [("hospitals", 1, 1), ("workforce", 2, 4), ("life_sciences", 1, 6)]
    assert [tuple(x) for x in d.figures] == [("headcount", 1200.0, 4), ("money", 150.0, 1), ("sqft", 40000.0, 6)]
    assert d.notes == ["dollar amount differs: Herald reports $150M, Tribune reports $120M"]
    assert d.n_notes == 1 and [(r.nth, r.note) for r in brief.discrepancies(stories.verdicts(articles, clustered)).collect()] == [(0, d.notes[0])]
    cut_off = brief.digest(stories.dedupe(articles, clustered), stories.verdicts(articles, clustered), most_notes=0).first()
    assert cut_off.notes == [] and cut_off.n_notes == 1
    none = brief.digest(articles.limit(0), stories.verdicts(articles.limit(0), clustered.limit(0))).first()
    assert (none.stories, none.busiest, none.leads, none.figures, none.notes, none.line) == (0, None, [], [], [], "zero stories corroborated")


def test_scan_counts(spark, clustered):
    evaluated = spark.createDataFrame([(None,), ("not on topic",), ("incidental mention (er)",), ("incidental mention (um)",)], "drop_reason string")
    assert {r.reason: r.n for r in items.scan_counts(evaluated, clustered).collect()} == {"not on topic": 1, "incidental mention": 2, "duplicate": 1}


def test_source_totals(spark):
    results = spark.createDataFrame([("b", True, 3, ""), ("c", False, 0, "not a whole feed"), ("a", False, 0, "")], "origin string, ok boolean, items int, error string")
    t = items.source_totals(results).first()
    assert (t.sources, t.ok, t.failed, t["items"], t.errors) == (3, 1, 2, 3, ["a", "c: not a whole feed"])


def test_scan_drops_repeats_and_late_items(spark, tmp_path):
    v = Vocabulary(region=(("town", 1),), elsewhere=(), categories=(("hospitals", (("clinic", 1),)),), qualifying=("hospitals",), property_category="hospitals", noise=())
    start = dt.datetime(2024, 1, 1)

    def item(url, hours, title="Town clinic opens"):
        return (title, f"https://n.example.com/{url}", start + dt.timedelta(hours=hours), "Herald", "")

    files = [
        [item("a", 0), item("a/", 1), item("b", 1), item("c", 2, "Town fair opens")],  # the second is the first again; the last is off topic
        [item("d", 30), item("a#x", 3)],  # again, within the look-back
        [item("e", 31), item("f", 2), item("d", 31)],  # f comes 28 hours late
        [item("g", 60)],
    ]
    kind = "title string, link string, published timestamp, source_name string, summary string"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        made = next((tmp_path / "in" / str(k)).glob("*.parquet"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        made.rename(tmp_path / "flat" / f"{k}.parquet")
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "flat"))
        scan.run_available(scan.fresh(stream, v).select("url_key", "published"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.url_key[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "d", "e", "g"]


def greedy(rows, orgs):
    """The clustering rule over all articles in plain Python: (seq, title, summary, source, url, score, money in millions, organizations)."""
    out, clusters = {}, []
    for seq, title, _, source, url, _, money, named in sorted(rows, key=lambda a: (-a[5], a[0])):
        tokens, key = set(title.lower().split()), url.split("#")[0].rstrip("/")
        for c in clusters:
            like = len(tokens & c["tokens"]) / len(tokens | c["tokens"])
            proof = bool(named & c["orgs"]) or (money and c["money"] and abs(money - c["money"]) <= 0.02 * max(money, c["money"]))
            if key in c["urls"] or title.lower() in c["norms"] or like >= 0.8 or (like >= 0.45 and proof):
                out[seq] = (c["id"], "duplicate" if source in c["sources"] else "corroborator")
                c["sources"].add(source), c["urls"].add(key), c["norms"].add(title.lower())
                break
        else:
            clusters.append({"id": seq, "tokens": tokens, "money": money, "orgs": named, "urls": {key}, "norms": {title.lower()}, "sources": {source}})
            out[seq] = (seq, "primary")
    return out


def test_clusters_with_evidence_equal_the_greedy_rule(spark):
    import random

    r = random.Random(9)
    words, orgs = "clinic opens tower strike grant lab county doctors city bridge".split(), ("mercy", "unity")
    rows = []
    for k in range(150):
        money, named = r.choice((0, 100, 101, 103, 150)), {o for o in orgs if r.random() < 0.15}
        title = " ".join(r.sample(words, r.randint(3, 6)))
        rows.append((k, title, f"It costs ${money} million." if money else "", f"s{r.randint(0, 3)}", f"https://x.example.com/{r.randint(0, 400)}", r.randint(0, 9), money, named))
    df = spark.createDataFrame([(*x[:6], sorted(x[7])) for x in rows], "seq long, title string, summary string, source string, url string, score int, topic_hits array<string>").withColumn("published", F.lit("2024-01-01").cast("timestamp"))
    got = {x.seq: (x.cluster_id, x.role) for x in stories.cluster(df.repartition(5), orgs).collect()}
    assert got == greedy(rows, orgs)
