"""Stories: clusters of articles on one event, their figures compared between outlets, and verdicts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rentwire.functions import news

from . import similar
from .tables import cut, discard, ordered, partitions

NEAR, LOOSE = 0.8, 0.45


def prepared(articles: DataFrame, orgs: tuple[str, ...] = ()) -> DataFrame:
    """scan_id, seq, source, url_key, norm, tokens, orgs, facts, score, published. seq breaks ties and names the article."""
    a = articles
    topic = F.col("topic_hits") if "topic_hits" in a.columns else F.expr("cast(array() as array<string>)")
    scan = F.col("scan_id") if "scan_id" in a.columns else F.lit("")
    return a.select(
        scan.alias("scan_id"), F.col("seq").cast("long").alias("seq"), "source", "score", "published", news.url_key(F.col("url")).alias("url_key"), news.normalize_title(F.col("title")).alias("norm"),
        news.title_tokens(F.col("title")).alias("tokens"), F.array_intersect(topic, F.array(*map(F.lit, orgs))) .alias("orgs") if orgs else F.expr("cast(array() as array<string>)").alias("orgs"),
        news.facts(F.concat_ws(" ", "title", "summary")).alias("facts"),
    )


#: Articles that one task decides at once, about.
BLOCK = 20_000
KINDS = ("money", "headcount", "sqft")


def atoms(orgs: Column, facts: Column) -> Column:
    """What an article names and counts: array of (kind, name, value)."""
    made = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    of = lambda kind: F.transform(facts[kind], lambda v: made(kind, F.lit(""), v))
    figures = [of(kind) for kind in KINDS]
    return F.array_distinct(F.concat(F.transform(orgs, lambda o: made("org", o, F.lit(0))), *figures))


def rooms(scan: Column, kind: Column, name: Column, value: Column) -> Column:
    """Where an atom meets those that agree with it: organizations by name; figures fall into steps of a little over two percent, and each is in the room of its step and of the next."""
    step = F.floor(F.log(F.abs(value)) / math.log(1.0205))
    figure = F.array(*(F.concat_ws("|", scan, kind, F.signum(value).cast("int"), step + k) for k in (0, 1)))
    return F.when(kind == "org", F.array(F.concat_ws("|", scan, kind, name))).when(value == 0, F.array(F.concat_ws("|", scan, kind))).otherwise(figure)


def agree(x: Column, y: Column) -> Column:
    return (x == y) | (F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * 0.02)


def likenesses(p: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """unit, ord: the units of each article: its title (a set of tokens), and its title with each of its atoms; and i, j: which units are so like that a story of one takes the other.

    Titles alike at NEAR are, and titles alike at LOOSE with atoms that agree. Both ways round; a title of several articles also
    goes with itself. Units without such a partner are left out. p: scan_id, ord, tokens, orgs, facts.
    """
    worded = p.filter(F.size("tokens") > 0).withColumn("tokens", F.array_sort("tokens"))
    titles = cut(worded.groupBy("scan_id", "tokens").agg(F.min("ord").alias("title"), F.count("*").alias("articles")), made)
    words = titles.select("scan_id", "title", F.explode("tokens").alias("t"))
    often = words.groupBy("scan_id", "t").agg(F.count("*").alias("df"))
    ranked = cut(words.join(often, ["scan_id", "t"]).groupBy("scan_id", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda s: s["t"]).alias("ts")), made)
    near = similar.pairs(ranked.select(F.col("title").alias("id"), F.col("title").alias("owner"), F.col("scan_id").alias("room"), "ts"), NEAR, made)
    near = near.select((F.col("x") * 2).alias("x"), (F.col("y") * 2).alias("y"))
    own = cut(worded.join(titles.select("scan_id", "tokens", "title"), ["scan_id", "tokens"]).select("scan_id", "ord", "title", atoms(F.col("orgs"), F.col("facts")).alias("atoms")), made)
    claims = own.select("scan_id", "ord", "title", F.explode("atoms").alias("a")).select("scan_id", "ord", "title", "a.*")
    items = cut(claims.groupBy("scan_id", "title", "kind", "name", "value").agg(F.min("ord").alias("first")).withColumn("item", F.monotonically_increasing_id()), made)
    placed = items.select(F.col("item").alias("id"), F.col("title").alias("owner"), F.explode(rooms(F.col("scan_id"), F.col("kind"), F.col("name"), F.col("value"))).alias("room"), "scan_id").join(ranked.select("scan_id", F.col("title").alias("owner"), "ts"), ["scan_id", "owner"])
    loose = similar.pairs(placed.select("id", "owner", "room", "ts"), LOOSE, made)
    value = lambda side: items.select(F.col("item").alias(side), F.col("value").alias(f"value_{side}"))
    loose = loose.join(value("x"), "x").join(value("y"), "y").filter(agree(F.col("value_x"), F.col("value_y"))).select((F.col("x") * 2 + 1).alias("x"), (F.col("y") * 2 + 1).alias("y"))
    one_way = cut(near.unionByName(loose), made)
    itself = titles.filter("articles > 1").select((F.col("title") * 2).alias("i"), (F.col("title") * 2).alias("j"))
    links = cut(one_way.select(F.col("x").alias("i"), F.col("y").alias("j")).unionByName(one_way.select(F.col("y").alias("i"), F.col("x").alias("j"))).unionByName(itself), made)
    of_items = claims.join(items.drop("first"), ["scan_id", "title", "kind", "name", "value"]).select((F.col("item") * 2 + 1).alias("unit"), "ord")
    units = own.select((F.col("title") * 2).alias("unit"), "ord").unionByName(of_items)
    return cut(units.join(links.select(F.col("i").alias("unit")).distinct(), "unit", "left_semi"), made), links


def decide(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """The greedy rule over the undecided articles of a block, in order: the state of each is 1 (begins a story), 0 (is like one that does) or null (waits for an article of another block)."""
    near: dict[int, list[int]] = {}
    for i, j in zip(links.i.tolist(), links.j.tolist()):
        near.setdefault(i, []).append(j)
    taken, waiting, rows = set(), set(), []
    for at, own in nodes.sort_values("ord", kind="stable").groupby("ord", sort=True):
        units = own.unit.tolist()
        if not taken.isdisjoint(units):
            state = 0
        else:
            waits = bool(own.waits.any()) or not waiting.isdisjoint(units)
            state = None if waits else 1
            (waiting if waits else taken).update(j for i in units for j in near.get(i, ()))
        rows.append((at, state))
    return pd.DataFrame(rows, columns=["ord", "state"]).astype({"state": "Int32"})


def beginners(units: DataFrame, links: DataFrame, made: list[str]) -> DataFrame:
    """unit, ord of the articles in ``units`` that begin a story: no earlier one that begins a story is like them.

    In each round the undecided articles are dealt in their order to blocks of about BLOCK, and each block decides what depends
    on no undecided article of an earlier block. What a beginner is like to is then settled in joins.
    """
    open_, begun = units, []
    while True:
        asked = open_.select("ord").distinct()
        parts = max(1, -(-asked.count() // BLOCK))
        dealt = cut(asked.repartitionByRange(parts, "ord").withColumn("block", F.spark_partition_id()), made)
        if dealt.isEmpty():
            break
        own = cut(open_.join(dealt, "ord"), made)
        first = own.groupBy("unit").agg(F.min("ord").alias("first"))
        earliest = links.join(first.withColumnRenamed("unit", "j"), "j").groupBy(F.col("i").alias("unit")).agg(F.min("first").alias("first"))
        starts = dealt.groupBy("block").agg(F.min("ord").alias("start"))
        nodes = own.join(earliest, "unit", "left").join(starts, "block").select("block", "ord", "unit", F.coalesce(F.col("first") < F.col("start"), F.lit(False)).alias("waits"))
        within = own.select("block", "unit").distinct()
        inner = within.withColumnRenamed("unit", "i").join(links, "i").join(within.withColumnRenamed("unit", "j"), ["block", "j"]).select("block", "i", "j")
        nodes, inner = cut(nodes, made), cut(inner, made)  # a cogroup needs sides of their own
        states = cut(nodes.groupBy("block").cogroup(inner.groupBy("block")).applyInPandas(decide, "ord long, state int"), made)
        fresh = cut(own.join(states.filter("state = 1").select("ord"), "ord", "left_semi").select("unit", "ord"), made)
        begun.append(fresh)
        left = open_.join(states.filter("state is null").select("ord"), "ord", "left_semi")
        taken = links.join(fresh.groupBy(F.col("unit").alias("j")).agg(F.min("ord").alias("first")), "j").groupBy(F.col("i").alias("unit")).agg(F.min("first").alias("first"))
        settled = left.join(taken, "unit").filter("first < ord").select("ord").distinct()
        open_ = cut(left.join(settled, "ord", "left_anti"), made)
    found = units.limit(0)
    for some in begun:
        found = found.unionByName(some.select(*units.columns))
    return found


def follow(chains: DataFrame, stories: DataFrame, made: list[str]) -> DataFrame:
    """ord, story: ``stories`` (ord, story or null) with each article of a chain (chain, ord) taken by the earliest story that any article before it in the chain is in.

    The least value of all articles before is found over ranges of the chains, so that a chain of any length is spread over
    tasks; repeated until nothing changes, as articles are in chains of urls and of titles.
    """
    ranged = cut(chains.repartitionByRange(partitions(chains.sparkSession), "chain", "ord").withColumn("part", F.spark_partition_id()), made)
    earlier = W.partitionBy("chain").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    within = W.partitionBy("chain", "part").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    while True:
        now = ranged.join(stories, "ord")
        before = now.groupBy("chain", "part").agg(F.min("story").alias("story")).select("chain", "part", F.min("story").over(earlier).alias("before"))
        least = now.withColumn("inner", F.min("story").over(within)).join(before, ["chain", "part"]).select("ord", F.least("before", "inner").alias("found")).groupBy("ord").agg(F.min("found").alias("found"))
        better = F.col("found").isNotNull() & (F.col("story").isNull() | (F.col("found") < F.col("story")))
        moved = cut(stories.join(least, "ord", "left").select("ord", F.least("story", "found").alias("story"), better.alias("moved")), made)
        stories = moved.select("ord", "story")
        if moved.filter("moved").isEmpty():
            return stories


def cluster(articles: DataFrame, orgs: tuple[str, ...] = (), scratch: list[str] | None = None) -> DataFrame:
    """scan_id, seq, cluster_id (seq of the primary), role (primary, corroborator, duplicate), place (rises with the order within a scan).

    Equal to the greedy rule over each whole scan, in the order of score, time and seq: an article joins the first story that holds
    its url or title or whose primary is like it, else it begins one. An article with the url or title of an earlier one never
    begins a story; of the others those begin one that no earlier beginner is like. An article's story is the earliest of those
    whose beginner is like it and those of the articles before it with its url or its title. In a story, the first
    article of each source but the primary's corroborates, the others are duplicates. scratch: gets the path of the result's table.
    """
    made: list[str] = []
    last = lambda x: F.coalesce(F.negative(x), F.lit(float("inf")))
    order = F.struct(last(F.col("score").cast("double")).alias("a"), last(F.unix_micros("published").cast("double")).alias("b"), F.col("seq").alias("c"))
    written = cut(prepared(articles, orgs).withColumn("order", order), made)  # a range sort reads its input twice
    p = ordered(written, "scan_id", "order", name="ord", scratch=made)
    chains = []
    for k, key in enumerate(("url_key", "norm")):
        keyed = p.filter("url_key <> ''") if key == "url_key" else p
        groups = keyed.groupBy("scan_id", key).agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
        chains.append(keyed.select("scan_id", key, "ord").join(groups, ["scan_id", key]).select((F.col("first") * 2 + k).alias("chain"), "ord", (F.col("ord") > F.col("first")).alias("later")))
    chains = cut(chains[0].unionByName(chains[1]), made)
    later = chains.filter("later").select("ord").distinct()
    units, links = likenesses(p, made)
    begun = cut(beginners(cut(units.join(later, "ord", "left_anti"), made), links, made), made)
    like = links.join(begun.groupBy(F.col("unit").alias("j")).agg(F.min("ord").alias("first")), "j").groupBy(F.col("i").alias("unit")).agg(F.min("first").alias("first"))
    taken = units.join(like, "unit").filter("first < ord").groupBy("ord").agg(F.min("first").alias("story"))
    late = later.withColumn("late", F.lit(True))
    stories = cut(p.select("ord").join(taken, "ord", "left").join(late, "ord", "left").select("ord", F.when(F.col("story").isNull() & F.col("late").isNull(), F.col("ord")).otherwise(F.col("story")).alias("story")), made)
    if not chains.isEmpty():
        stories = follow(chains.select("chain", "ord"), stories, made)
    whole = p.select("scan_id", "seq", "source", "ord").join(stories, "ord")
    first = whole.groupBy("story", "source").agg(F.min("ord").alias("first"))
    beginner = p.select(F.col("ord").alias("story"), F.col("seq").alias("cluster_id"))
    told = whole.join(first.withColumnRenamed("source", "s").withColumnRenamed("story", "of"), (F.col("story") == F.col("of")) & F.col("source").eqNullSafe(F.col("s"))).join(beginner, "story")
    role = F.when(F.col("ord") == F.col("story"), "primary").when(F.col("ord") == F.col("first"), "corroborator").otherwise("duplicate")
    out = cut(told.select("scan_id", "seq", "cluster_id", role.alias("role"), F.col("ord").alias("place")), scratch)
    discard(articles.sparkSession, made)
    return out


def dedupe(articles: DataFrame, clustered: DataFrame) -> DataFrame:
    """The primary article of each story."""
    return articles.join(clustered.filter("role = 'primary'").select("seq"), "seq", "left_semi")


def verdicts(articles: DataFrame, clustered: DataFrame) -> DataFrame:
    """cluster_id, sources, verdict, details: single-source, discrepancy or corroborated, from the first four corroborators.

    A source corroborates a story once, so ``sources`` holds a name for each outlet at most, and only four of them bring notes.
    """
    text = F.concat_ws(" ", "title", "summary", *(["article_text"] if "article_text" in articles.columns else []))
    own = articles.select("seq", "source", news.facts(text).alias("facts")).join(clustered.filter("role <> 'duplicate'"), "seq")
    primary = own.filter("role = 'primary'").select("cluster_id", F.col("source").alias("p_source"), F.col("facts").alias("p_facts"))
    nth = W.partitionBy("cluster_id").orderBy("place")
    others = own.filter("role = 'corroborator'").withColumn("nth", F.row_number().over(nth))
    notes = news.fact_notes(F.col("p_facts"), F.col("facts"), F.col("p_source"), F.col("source"))
    judged = primary.join(others.select("cluster_id", "nth", "source", "facts"), "cluster_id", "left").withColumn("notes", F.when(F.col("nth") <= 4, notes))
    merged = judged.groupBy("cluster_id", "p_source").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", "source", "notes")))), lambda x: x["source"]).alias("more"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 4, F.struct("nth", "notes")))), lambda x: x["notes"]))).alias("notes"))
    names = F.array_distinct(F.concat(F.array("p_source"), "more"))
    n = F.size("sources")
    five = F.slice("sources", 1, 5)
    listed = F.concat(F.array_join(F.slice(five, F.lit(1), F.size(five) - 1), ", "), F.lit(" and "), F.element_at(five, -1))
    verdict = F.when(n < 2, F.lit("single-source")).when(F.size("notes") > 0, F.lit("discrepancy")).otherwise(F.lit("corroborated"))
    details = F.when(n < 2, F.array(F.concat(F.lit("Only "), F.col("p_source"), F.lit(" reported this story in this scan. Details are not yet corroborated elsewhere.")))).when(F.size("notes") > 0, F.col("notes")).otherwise(F.array(F.concat(F.lit("Consistent across "), news.spelled_count(n), F.lit(" sources: "), listed, F.lit("."))))
    return merged.withColumn("sources", names).select("cluster_id", "sources", verdict.alias("verdict"), details.alias("details"))


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))
