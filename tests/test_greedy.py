"""Clustering against the greedy rule: many articles with urls, titles, organizations and figures in common, blocks of any size, and long chains."""

import random

import pytest
from pyspark.sql import functions as F

from rentwire.operators import similar, stories

ORGS = ("mercy", "unity")


def greedy(rows):
    """The rule over all articles in plain Python: (seq, title, money in millions, source, url, score, organizations)."""
    out, clusters = {}, []
    for seq, title, money, source, url, _, named in sorted(rows, key=lambda a: (-a[5], a[0])):
        tokens, key = frozenset(title.lower().split()), url.split("#")[0].rstrip("/")
        for c in clusters:
            union = len(tokens | c["tokens"])
            like = len(tokens & c["tokens"]) / union if union else 0
            proof = bool(named & c["orgs"]) or (money and c["money"] and abs(money - c["money"]) <= 0.02 * max(money, c["money"]))
            if (key and key in c["urls"]) or title.lower() in c["norms"] or like >= 0.8 or (like >= 0.45 and proof):
                out[seq] = (c["id"], "duplicate" if source in c["sources"] else "corroborator")
                c["sources"].add(source), c["urls"].add(key), c["norms"].add(title.lower())
                break
        else:
            clusters.append({"id": seq, "tokens": tokens, "money": money, "orgs": named, "urls": {key}, "norms": {title.lower()}, "sources": {source}})
            out[seq] = (seq, "primary")
    return out


def clustered(spark, rows):
    made = [(seq, title, f"It costs ${money} million." if money else "", source, url, score, sorted(named)) for seq, title, money, source, url, score, named in rows]
    df = spark.createDataFrame(made, "seq long, title string, summary string, source string, url string, score int, topic_hits array<string>").withColumn("published", F.lit("2024-01-01").cast("timestamp"))
    return {x.seq: (x.cluster_id, x.role) for x in stories.cluster(df.repartition(4), ORGS).collect()}


@pytest.mark.parametrize("block, most, seed", [(20_000, 256, 1), (7, 4, 2), (40, 1, 3)])
def test_equal_to_the_greedy_rule(spark, monkeypatch, block, most, seed):
    monkeypatch.setattr(stories, "BLOCK", block)
    monkeypatch.setattr(similar.pairs, "__defaults__", (most,))
    r = random.Random(seed)
    words = "clinic opens tower strike grant lab county doctors city bridge river nurses".split()
    rows = []
    for k in range(260):
        title = " ".join(r.sample(words, r.randint(3, 7))) if r.random() < 0.97 else ""
        url = "" if r.random() < 0.05 else f"https://x.example.com/{r.randint(0, 500)}{r.choice(('', '/', '#top'))}"
        rows.append((k, title, r.choice((0, 0, 100, 101, 103, 150)), f"s{r.randint(0, 3)}", url, r.randint(0, 9), {o for o in ORGS if r.random() < 0.15}))
    assert clustered(spark, rows) == greedy(rows)


def test_a_chain_of_titles_over_many_blocks(spark, monkeypatch):
    """Each title is like the one before and the one behind alone, in the order of the chain: every second begins a story."""
    monkeypatch.setattr(stories, "BLOCK", 2_500)
    n = 10_000
    rows = spark.range(n).select(F.col("id").alias("seq"), F.array_join(F.transform(F.sequence(F.col("id"), F.col("id") + 9), lambda x: F.concat(F.lit("w"), x.cast("string"))), " ").alias("title"), F.lit("").alias("summary"), F.lit("s").alias("source"), F.concat(F.lit("https://x.example.com/"), "id").alias("url"), F.lit(1).alias("score"), F.lit("2024-01-01").cast("timestamp").alias("published"))
    got = {x.seq: x.cluster_id for x in stories.cluster(rows).collect()}
    assert got == {k: k - k % 2 for k in range(n)}


def test_one_url_and_one_title_on_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(stories, "BLOCK", 50)
    r = random.Random(8)
    rows = [(k, r.choice(("hot title of the day", f"other title {k} alone here")), 0, f"s{k % 5}", r.choice(("https://hot.example.com/", f"https://x.example.com/{k}")), r.randint(0, 3), set()) for k in range(240)]
    assert clustered(spark, rows) == greedy(rows)


@pytest.mark.parametrize("share, most", [(0.8, 256), (0.8, 2), (0.45, 256), (0.45, 3), (0.45, 1)])
def test_pairs_equal_brute_force(spark, share, most):
    r = random.Random(int(share * 100) + most)
    order = [f"t{k}" for k in range(24)]
    sets = [(k, k // 2, r.choice(("a", "b")), sorted(r.sample(order, min(24, r.choice((1, 1, 2, 3, 4, 5, 6, 9, 14)))), key=order.index)) for k in range(150)]
    sets += [(150 + k, 900 + k, "a", ["t22", "t23"]) for k in range(12)]  # more than a list holds, and nothing to extend it by
    want = {(x[0], y[0]) for x in sets for y in sets if x[0] < y[0] and x[1] != y[1] and x[2] == y[2] and len(set(x[3]) & set(y[3])) / len(set(x[3]) | set(y[3])) >= share}
    made = []
    got = [(p.x, p.y) for p in similar.pairs(spark.createDataFrame(sets, "id long, owner long, room string, ts array<string>"), share, made, most).collect()]
    assert set(got) == want and len(got) == len(want) > 20
