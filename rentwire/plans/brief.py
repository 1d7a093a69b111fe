"""The brief: articles by category, and a digest of the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from rentwire.functions import news


def by_category(articles: DataFrame, order: tuple[str, ...], most: int = 25) -> DataFrame:
    """category_no, place and the article columns: the newest ``most`` of each category, in category order."""
    newest = W.partitionBy("category").orderBy(F.desc("published"), "seq")
    known = articles.withColumn("category_no", F.array_position(F.array(*map(F.lit, order)), F.col("category")).cast("int")).filter("category_no > 0")
    return known.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)


def leads(articles: DataFrame) -> DataFrame:
    """category, n, lead (seq of the article of the highest score, then newest)."""
    return articles.groupBy("category").agg(F.count("*").alias("n"), F.max_by("seq", F.struct("score", "published", -F.col("seq"))).alias("lead"))


def largest_figures(articles: DataFrame) -> DataFrame:
    """kind, value, seq: the largest money, headcount and square feet, with the first article that states it."""
    facts = news.facts(F.concat_ws(" ", "title", "summary"))
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.array_max(F.col("f")[k]).cast("double").alias("value")) for k in ("money", "headcount", "sqft")))
    each = articles.select("seq", facts.alias("f")).select("seq", F.inline(rows)).filter("value is not null")
    return each.groupBy("kind").agg(F.max("value").alias("value"), F.max_by("seq", F.struct("value", -F.col("seq"))).alias("seq"))


def discrepancies(judged: DataFrame) -> DataFrame:
    """cluster_id, nth, note: every note of the stories whose outlets differ, a row each (16 a story at most: of four corroborators in four kinds of figures)."""
    return judged.filter("verdict = 'discrepancy'").select("cluster_id", F.posexplode("details").alias("nth", "note"))


def digest(articles: DataFrame, judged: DataFrame, order: tuple[str, ...] = (), most_notes: int = 1000) -> DataFrame:
    """One row: stories, busiest category and its count, verdict counts and their line, how many notes of discrepancies there are
    (n_notes), and as arrays the lead of each category (in ``order``, then by name), the largest figures and the first notes.

    ``articles`` are the primaries. notes holds the first ``most_notes`` by story; ``discrepancies`` has all of them, a row each.
    """
    lead = leads(articles)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("category")), F.lit(0)), F.lit(len(order) + 1)) if order else F.lit(0)
    busiest = lead.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("stories"), F.max_by("category", F.struct("n", -place, "category")).alias("busiest"), F.max("n").alias("busiest_n"),
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "category", "n", "lead"))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n"), x["lead"].alias("seq"))).alias("leads"),
    )
    figures = largest_figures(articles).agg(F.array_sort(F.collect_list(F.struct("kind", "value", "seq"))).alias("figures"))
    differ = F.when(F.col("verdict") == "discrepancy", F.size("details")).otherwise(F.lit(0))
    v = judged.agg(*(F.count_if(F.col("verdict") == x).alias(x.replace("-", "_")) for x in ("corroborated", "discrepancy", "single-source")), F.coalesce(F.sum(differ), F.lit(0)).alias("n_notes"))
    first = discrepancies(judged).orderBy("cluster_id", "nth").limit(most_notes)
    notes = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "nth", "note"))), lambda x: x["note"]).alias("notes"))
    both = busiest.crossJoin(figures).crossJoin(v).crossJoin(notes)  # one row each
    many = F.when(F.col("corroborated") == 1, F.lit("story")).otherwise(F.lit("stories"))
    return both.withColumn("line", F.concat_ws(" ", news.spelled_count(F.col("corroborated")), many, F.lit("corroborated")))
