"""Statistics over deals: weighted rents, indicators, breakdowns, time series, histograms, coverage and signing lead times.

Every function reads the deals once with partial aggregation, but for medians, which are exact and found by selection
(operators/medians.py). What is counted for a category or a day is a handful of sums that add up, so that a dashboard can
count all its categories and days in one pass and read its frames from those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rentwire.functions import cells

from .medians import medians

UNSPECIFIED, OTHER = "Not specified", "Other"
MOST_BINS = 40


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean weighted by positive weights; the plain mean where no value has one."""
    usable = value.isNotNull() & (weight > 0)
    return F.coalesce(F.sum(F.when(usable, value * weight)) / F.sum(F.when(usable, weight)), F.avg(value))


def key_or_unspecified(column: str) -> Column:
    trimmed = F.trim(F.coalesce(F.col(column), F.lit("")))
    return F.when(trimmed == "", F.lit(UNSPECIFIED)).otherwise(trimmed)


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def indicators() -> dict[str, Column]:
    """The headline indicators that add up, as aggregates over deals; all but the median."""
    mapped = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    first, last = (F.date_format(f("lease_date"), "MMM yyyy") for f in (F.min, F.max))
    return {
        "deal_count": F.count("*"),
        "mapped_count": F.count_if(mapped),
        "site_count": F.count_distinct(F.when(mapped, coordinate_key(F.col("lat"), F.col("lon")))),
        "total_area": F.sum("area_leased"),
        "weighted_base_rent": weighted_mean(F.col("base_rent_annual"), F.col("area_leased")),
        "average_base_rent": F.avg("base_rent_annual"),
        "average_term": F.avg("term_months"),
        "average_free_rent": F.avg("free_rent"),
        "average_ti": F.avg("ti_allowance"),
        "average_opex": F.avg("opex_annual"),
        "date_range_label": F.when(first.isNull(), F.lit("No lease dates")).when(first == last, first).otherwise(F.concat_ws(" to ", first, last)),
    }


#: Columns of kpis(), in order.
KPIS = ("deal_count", "mapped_count", "site_count", "total_area", "median_area", "weighted_base_rent", "average_base_rent", "average_term", "average_free_rent", "average_ti", "average_opex", "date_range_label")


def kpis(deals: DataFrame) -> DataFrame:
    """One row of headline indicators."""
    plain = deals.agg(*(x.alias(name) for name, x in indicators().items()))
    return plain.crossJoin(medians(deals, [], {"median_area": F.col("area_leased")})).select(*KPIS)  # one row each


def sums() -> list[Column]:
    """What is kept of the deals of a category or a day."""
    area, rent = F.col("area_leased"), F.col("base_rent_annual")
    usable = rent.isNotNull() & (area > 0)
    return [
        F.count("*").alias("deals"), F.sum(F.coalesce(area, F.lit(0.0))).alias("area"), F.sum(F.when(usable, rent * area)).alias("rent_area"), F.sum(F.when(usable, area)).alias("rented"),
        F.sum(rent).alias("rents"), F.count(rent).alias("n_rents"), F.sum("term_months").alias("terms"), F.count("term_months").alias("n_terms"), F.min("source_row").alias("first_row"),
    ]


SUMS = ("deals", "area", "rent_area", "rented", "rents", "n_rents", "terms", "n_terms", "first_row")


def added() -> list[Column]:
    """The sums of several categories or days together."""
    return [(F.min if c == "first_row" else F.sum)(c).alias(c) for c in SUMS]


def told(*names: str) -> list[Column]:
    """deals, area, avg_rent, avg_term or first_row from the sums; no rent and no term are null."""
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n))
    whole = {"avg_rent": F.coalesce(F.col("rent_area") / F.col("rented"), mean("rents", "n_rents")), "avg_term": mean("terms", "n_terms")}
    return [whole.get(c, F.col(c)).alias(c) for c in names]


def categories(deals: DataFrame, column: str) -> DataFrame:
    """name and the sums of its deals; first_row (the first appearance) breaks ties."""
    return deals.groupBy(key_or_unspecified(column).alias("name")).agg(*sums())


def category_breakdown(deals: DataFrame, column: str, limit: int = 10, sort_by: str = "deals", drop_unspecified: bool = False) -> DataFrame:
    """place, name, deals, area, avg_rent, avg_term: the first ``limit`` categories, and the rest as one row.

    The sorted head is a top-k; only the rest is summed, so no category list goes through one task.
    """
    return ranked(categories(deals, column), limit, sort_by, drop_unspecified)


def ranked(counted: DataFrame, limit: int = 10, sort_by: str = "deals", drop_unspecified: bool = False) -> DataFrame:
    """``category_breakdown`` from categories that are counted already (name and sums)."""
    data = counted.select("name", *told("deals", "area", "avg_rent", "avg_term", "first_row"))
    if drop_unspecified:
        data = data.filter(F.col("name") != UNSPECIFIED)
    order = {"deals": [F.desc("deals"), F.desc("area")], "area": [F.desc("area")], "avg_rent": [F.desc_nulls_last("avg_rent")]}[sort_by]
    order = [*order, F.col("first_row"), F.col("name")]
    head = data.orderBy(*order).limit(limit)
    placed = head.withColumn("place", F.row_number().over(W.orderBy(*order)))  # `limit` rows
    all_of = data.agg(F.count("*").alias("n"), F.sum("deals").alias("deals"), F.sum("area").alias("area"))
    some = head.agg(F.count("*").alias("m"), F.sum("deals").alias("some_deals"), F.sum("area").alias("some_area"))
    rest = all_of.crossJoin(some).filter(F.col("n") > F.col("m"))  # one row each
    tail = rest.select(
        F.lit(limit + 1).alias("place"),
        F.format_string(f"{OTHER} (%d)", F.col("n") - F.col("m")).alias("name"),
        (F.col("deals") - F.col("some_deals")).alias("deals"),
        (F.col("area") - F.col("some_area")).alias("area"),
        F.lit(None).cast("double").alias("avg_rent"),
        F.lit(None).cast("double").alias("avg_term"),
    )
    return placed.select(tail.columns).unionByName(tail)


def grain(deals: DataFrame, date: str = "lease_date") -> DataFrame:
    """One row: grain of a timeline by the span of its dates."""
    days = F.datediff(F.max(date), F.min(date)) / 30.44
    return deals.agg(F.when(F.count(date) < 2, F.lit("quarter")).when(days <= 30, F.lit("month")).when(days <= 120, F.lit("quarter")).otherwise(F.lit("year")).alias("grain"))


def bucket(date: Column, size: str) -> tuple[Column, Column, Column]:
    """key, label and sort number of a date's bucket."""
    year = F.year(date)
    if size == "year":
        return year.cast("string"), year.cast("string"), year * 100
    if size == "quarter":
        q = F.quarter(date)
        return F.format_string("%d-Q%d", year, q), F.format_string("Q%d %02d", q, year % 100), year * 100 + q
    return F.date_format(date, "yyyy-MM"), F.date_format(date, "MMM yy"), year * 100 + F.month(date)


def days(deals: DataFrame, split_by: str | None = None, date: str = "lease_date") -> DataFrame:
    """day, series and the sums of its deals."""
    series = key_or_unspecified(split_by) if split_by else F.lit("All deals")
    return deals.filter(F.col(date).isNotNull()).groupBy(F.col(date).alias("day"), series.alias("series")).agg(*sums())


def time_series(deals: DataFrame, size: str, split_by: str | None = None, most: int = 5, date: str = "lease_date", measure: str = "area") -> DataFrame:
    """key, label, sort, deals, area, avg_rent and by_type (series to amount, 0 where a bucket has none).

    Series are the ``most`` categories with the largest sum of area + 1, the rest as Other; they are a few rows, found
    first. by_type is of one series, all deals, without ``split_by``.
    """
    return timeline(days(deals, split_by, date), size, most if split_by else None, measure)


def timeline(counted: DataFrame, size: str, most: int | None = 5, measure: str = "area") -> DataFrame:
    """``time_series`` from days that are counted already (day, series and sums). most: None takes every series as it is."""
    key, label, sort = bucket(F.col("day"), size)
    dated = counted.select(key.alias("key"), label.alias("label"), sort.alias("sort"), "series", *SUMS)
    totals = dated.groupBy("series").agg(F.sum(F.col("area") + F.col("deals")).alias("total")).orderBy(F.desc("total"), "series").limit((most or 1) + 1).collect()
    keep = [r.series for r in totals[: most or 1]]
    names = [*keep, OTHER] if len(totals) > len(keep) else keep
    series = F.when(F.col("series").isin(keep), F.col("series")).otherwise(F.lit(OTHER))
    amount = F.col("deals").cast("double") if measure == "deals" else F.col("area")
    parts = dated.withColumn("series", series).groupBy("key").agg(
        F.min("label").alias("label"), F.min("sort").alias("sort"), *added(),
        *(F.sum(F.when(F.col("series") == n, amount).otherwise(F.lit(0.0))).alias(f"s{k}") for k, n in enumerate(names)),
    )
    by_type = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), F.col(f"s{k}")))) if names else F.expr("cast(map() as map<string,double>)")
    return parts.select("key", "label", "sort", *told("deals", "area", "avg_rent"), by_type.alias("by_type"))


def rent_trend(series: DataFrame) -> DataFrame:
    return series.filter(F.col("avg_rent").isNotNull())


def nice_step(raw: Column) -> Column:
    """1, 2, 2.5, 5 or 10 times a power of ten, not under ``raw``."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    n = raw / size
    step = F.when(n <= 1, 1.0).when(n <= 2, 2.0).when(n <= 2.5, 2.5).when(n <= 5, 5.0).otherwise(10.0)
    return F.when(raw <= 0, F.lit(1.0)).otherwise(step * size)


def histogram(deals: DataFrame, column: str, target: int) -> DataFrame:
    """bin (from 0), low, high, count; empty bins are there. No rows for no values."""
    return histograms(deals, {column: (F.col(column), target)}).drop("name")


def histograms(deals: DataFrame, asked: dict[str, tuple[Column, int]]) -> DataFrame:
    """name, bin (from 0), low, high, count of several columns (name: column and about how many bins): two passes for all of them, one for the edges and one for the counts."""
    each = F.array(*(F.struct(F.lit(name).alias("name"), v.cast("double").alias("v"), F.lit(target).alias("target")) for name, (v, target) in asked.items()))
    values = deals.select(F.inline(each)).filter("v is not null and not isnan(v)")
    edges = values.groupBy("name", "target").agg(F.min("v").alias("least"), F.max("v").alias("most"))  # a row for each of `asked`
    edges = edges.withColumn("step", F.when(F.col("least") == F.col("most"), F.lit(0.0)).otherwise(nice_step((F.col("most") - F.col("least")) / F.col("target"))))
    edges = edges.withColumn("start", F.when(F.col("step") == 0, F.col("least")).otherwise(F.floor(F.col("least") / F.col("step")) * F.col("step")))
    bins = F.when(F.col("step") == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(MOST_BINS), F.ceil((F.col("most") - F.col("start")) / F.col("step"))))).cast("int")
    edges = edges.withColumn("bins", bins).drop("target")
    place = F.when(F.col("step") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("start")) / F.col("step")))))
    counted = values.join(F.broadcast(edges), "name").groupBy("name", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("name", "start", "step", "most", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    low = F.col("start") + F.col("bin") * F.col("step")
    return every.join(counted, ["name", "bin"], "left").select("name", "bin", low.alias("low"), F.when(F.col("step") == 0, F.col("most")).otherwise(low + F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


#: Fields of the coverage table, in order, and the columns that they count.
COVERAGE = (
    ("Mapped location", "lat+lon"), ("Lease date", "lease_date"), ("Signed date", "execution_date"), ("Term length", "term_months"), ("Area leased", "area_leased"),
    ("Base rent", "base_rent"), ("OpEx", "opex"), ("Escalation", "escalation_text"), ("Free rent", "free_rent"), ("TI allowance", "ti_allowance"),
    ("Lease type", "lease_type"), ("Property subtype", "property_subtype"), ("Lessor", "lessor"),
)


def with_escalation(deals: DataFrame) -> DataFrame:
    """The deals with escalation_text, made of its parts where they have none."""
    if "escalation_text" in deals.columns:
        return deals
    return deals.withColumn("escalation_text", cells.resolve_escalation(*(F.col(c) for c in ("escalation", "escalation_percent", "escalation_value", "escalation_type", "escalation_comments"))))


def presences() -> list[Column]:
    """c0 …: how many deals have each field of COVERAGE."""
    texts = {"escalation_text", "lease_type", "property_subtype", "lessor"}

    def present(column: str) -> Column:
        if column == "lat+lon":
            return F.col("lat").isNotNull() & F.col("lon").isNotNull()
        return F.trim(F.coalesce(column, F.lit(""))) != "" if column in texts else F.col(column).isNotNull()

    return [F.count_if(present(c)).alias(f"c{k}") for k, (_, c) in enumerate(COVERAGE)]


def coverage_rows(counts: DataFrame) -> DataFrame:
    """place, label, present, total, percent (rounded half up) of one row of total and presences."""
    rows = F.array(*(F.struct(F.lit(k + 1).alias("place"), F.lit(label).alias("label"), F.col(f"c{k}").alias("present")) for k, (label, _) in enumerate(COVERAGE)))
    percent = F.when(F.col("total") > 0, F.floor(F.col("present") * 100 / F.col("total") + 0.5)).otherwise(F.lit(0)).cast("int")
    return counts.select("total", F.inline(rows)).select("place", "label", "present", "total", percent.alias("percent"))


def coverage(deals: DataFrame) -> DataFrame:
    """place, label, present, total, percent (rounded half up): one pass over the deals."""
    return coverage_rows(with_escalation(deals).agg(F.count("*").alias("total"), *presences()))


def with_lag(deals: DataFrame) -> DataFrame:
    """The deals with lag_days, from signing to commencement."""
    return deals.withColumn("lag_days", F.datediff("lease_date", "execution_date"))


def signings() -> dict[str, Column]:
    """The signing figures that add up, as aggregates over deals with lag_days; all but the median."""
    return {"signed_count": F.count("execution_date"), "paired_count": F.count("lag_days"), "signed_late_count": F.count_if(F.col("lag_days") < 0), "signed_from": F.min("execution_date"), "signed_to": F.max("execution_date")}


#: Columns of signing(), in order.
SIGNING = ("signed_count", "paired_count", "median_lag_days", "signed_late_count", "signed_from", "signed_to")


def signing(deals: DataFrame) -> DataFrame:
    """One row: signed and paired deals, median lead time, deals signed late, first and last signing."""
    lagged = with_lag(deals)
    plain = lagged.agg(*(x.alias(name) for name, x in signings().items()))
    return plain.crossJoin(medians(lagged, [], {"median_lag_days": F.col("lag_days")})).select(*SIGNING)  # one row each
