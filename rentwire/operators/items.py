"""News items: the recency window, scoring with a reason for what is dropped, and counts."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, functions as F

from rentwire.functions import news

Terms = tuple[tuple[str, int], ...]


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """Weighted phrases; all are parameters of a job. Categories are in their order; orgs nudge the category that they are under."""

    region: Terms = (("seattle", 2), ("puget sound", 2), ("washington state", 2), ("tacoma", 2), ("bellevue", 1))
    region_orgs: Terms = ()
    elsewhere: Terms = (("washington, d.c.", 1), ("capitol hill lawmakers", 1))
    categories: tuple[tuple[str, Terms], ...] = (
        ("medical_office", (("medical office", 3), ("outpatient clinic", 2))),
        ("workforce", (("layoffs", 2), ("strike", 2), ("nurses", 1))),
        ("investment", (("acquisition", 2), ("funding round", 2))),
        ("life_sciences", (("biotech", 3), ("clinical trial", 2))),
        ("hospitals", (("hospital", 2), ("health system", 2))),
    )
    orgs: tuple[tuple[str, Terms], ...] = ()
    property_signals: Terms = (("lease", 1), ("square feet", 1))
    qualifying: tuple[str, ...] = ("medical_office", "life_sciences", "hospitals")
    noise: Terms = (("horoscope", 1), ("box score", 1))
    domains: tuple[str, ...] = ()
    fallback: str = "hospitals"
    property_category: str = "medical_office"


def in_window(items: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Dated items of the last ``hours``, up to two hours ahead."""
    return items.filter((F.col("published") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("published") <= now + F.make_dt_interval(F.lit(0), F.lit(2))))


def evaluate(items: DataFrame, v: Vocabulary, min_region: int = 1) -> DataFrame:
    """The items with title, url, source, summary, category, region_hits, topic_hits, score and drop_reason (null: kept).

    A projection without a shuffle. Reasons in order: no title, region, elsewhere, topic, incidental mention.
    """
    defaults = {"source_name": "", "source_url": "", "summary": "", "link": "", "image_url": "", "region_implied": False, "topic_implied": False}
    d = items.withColumns({c: F.coalesce(F.col(c), F.lit(x)) if c in items.columns else F.lit(x) for c, x in defaults.items()})
    d = d.withColumn("title", news.without_source(F.coalesce("title", F.lit("")), F.col("source_name"))).withColumn("url", news.unwrap_redirect(F.col("link")))
    plain = news.strip_html(F.col("summary"))
    begin = F.greatest(F.lit(20), F.floor(F.length("title") / 2)).cast("int")
    repeats = plain.startswith(F.substring("title", F.lit(1), begin))
    d = d.withColumn("summary", F.when(repeats, F.lit("")).when(F.length(plain) > 400, F.concat(F.rtrim(F.substring(plain, 1, 397)), F.lit("..."))).otherwise(plain))
    d = d.withColumn("_text", F.concat_ws(" ", "title", "summary")).withColumn("_domain", news.domain_of(F.when(F.col("source_url") != "", F.col("source_url")).otherwise(F.col("url"))))
    text = F.col("_text")

    def matched(name: str, terms: Terms):
        return {f"_{name}": news.phrase_match(text, terms)}

    columns = matched("region", v.region + v.region_orgs) | matched("elsewhere", v.elsewhere) | matched("noise", v.noise) | matched("property", v.property_signals)
    for name, terms in v.categories:
        columns |= matched(f"c_{name}", terms)
    orgs = dict(v.orgs)
    for name, terms in orgs.items():
        columns |= matched(f"o_{name}", terms)
    # inline() keeps the optimizer from copying the matches into every filter over what follows.
    d = d.select("*", F.inline(F.array(F.struct(*(x.alias(name) for name, x in columns.items())))))
    local = F.col("_domain").isin(list(v.domains)) if v.domains else F.lit(False)
    marks = F.filter(F.array(F.when(local, F.concat(F.lit("wa-source:"), F.col("_domain"))), F.when(F.col("region_implied"), F.lit("regional-feed"))), lambda x: x.isNotNull())
    region = F.col("_region.s") + F.size(marks) * 2
    scores = {}
    for name, _ in v.categories:
        s = F.col(f"_c_{name}.s") + (F.col(f"_o_{name}.s") if name in orgs else F.lit(0))
        scores[name] = F.when(F.col(f"_c_{name}.s") > 0, s + F.col("_property.s")).otherwise(s) if name == v.property_category else s
    d = d.withColumns({f"_s_{name}": s for name, s in scores.items()} | {"_r": region, "region_hits": F.array_sort(F.array_distinct(F.concat(F.col("_region.h"), marks)))})
    qualifier = sum((F.col(f"_s_{name}") for name in v.qualifying), F.lit(0))
    d = d.withColumn("_q", qualifier).withColumn(f"_s_{v.fallback}", F.when(F.col("_q") == 0, F.lit(1)).otherwise(F.col(f"_s_{v.fallback}")))
    named = F.concat(*(F.col(f"_c_{name}.h") for name, _ in v.categories), *(F.col(f"_o_{name}.h") for name in orgs), F.when(F.col(f"_c_{v.property_category}.s") > 0, F.col("_property.h")).otherwise(F.expr("cast(array() as array<string>)")))
    most = F.greatest(*(F.col(f"_s_{name}") for name, _ in v.categories), F.lit(0))
    category = F.lit("other")
    for name, _ in reversed(v.categories):
        category = F.when((F.col(f"_s_{name}") == most) & (most > 0), F.lit(name)).otherwise(category)

    def listed(name: str) -> Column:
        return F.array_join(F.slice(F.col(f"_{name}.h"), 1, 3), ", ")

    reason = (
        F.when(F.col("title") == "", F.lit("no title"))
        .when(F.col("_r") < min_region, F.lit("not in the region"))
        .when((F.col("_elsewhere.s") > 0) & (F.col("_r") < 2), F.concat(F.lit("story from elsewhere ("), listed("elsewhere"), F.lit(")")))
        .when((F.col("_q") == 0) & ~F.col("topic_implied"), F.lit("not on topic"))
        .when((F.col("_noise.s") > 0) & (F.col("_q") <= 3), F.concat(F.lit("incidental mention ("), listed("noise"), F.lit(")")))
    )
    source = F.coalesce(*(F.when(x != "", x) for x in (F.col("source_name"), F.col("_domain"), news.domain_of(F.col("url")))), F.lit("unknown"))
    total = F.col("_r") + sum((F.col(f"_s_{name}") for name, _ in v.categories), F.lit(0))
    out = d.withColumns({"category": category, "topic_hits": F.array_sort(F.array_distinct(named)), "score": total, "drop_reason": reason, "source": source})
    return out.select(*(c for c in out.columns if not c.startswith("_")))


def drop_counts(evaluated: DataFrame) -> DataFrame:
    """reason, n: dropped items by the reason without its details."""
    return evaluated.filter("drop_reason is not null").groupBy(F.substring_index("drop_reason", " (", 1).alias("reason")).agg(F.count("*").alias("n"))


def scan_counts(evaluated: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """reason, n: dropped items by reason, with a row 'duplicate' for articles that a story holds already."""
    counts = drop_counts(evaluated)
    if clustered is None:
        return counts
    duplicates = clustered.agg(F.count_if(F.col("role") == "duplicate").alias("n")).select(F.lit("duplicate").alias("reason"), "n")
    return counts.unionByName(duplicates)


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("origin").agg(F.count("*").alias("items"))


def source_totals(results: DataFrame) -> DataFrame:
    """One row over source results (origin, ok, items, error): sources, ok, failed, items, errors (the failed ones, sorted)."""
    failed = F.when(~F.col("ok"), F.concat_ws(": ", "origin", F.nullif("error", F.lit(""))))
    return results.agg(F.count("*").alias("sources"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.array_sort(F.collect_list(failed)).alias("errors"))
