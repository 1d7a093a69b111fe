"""The dashboard: all statistics over one filtered set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rentwire.functions import display as show
from rentwire.operators import filters, stats
from rentwire.operators.medians import medians
from rentwire.operators.tables import cut


#: Columns that the statistics read.
READ = ("source_row", "lease_date", "execution_date", "area_leased", "base_rent", "base_rent_annual", "term_months", "free_rent", "ti_allowance", "opex", "opex_annual", "lat", "lon", "lease_type", "city", "property_subtype", "lessor", "escalation_text")
#: Breakdowns: frame, column, how many categories, by what, and whether blanks are dropped.
BREAKDOWNS = (("by_lease_type", "lease_type", 8, "deals", False), ("by_city", "city", 10, "area", True), ("by_subtype", "property_subtype", 8, "avg_rent", True), ("by_lessor", "lessor", 10, "area", True))
#: Histograms: frame, column, about how many bins.
BINS = (("area_bins", "area_leased", 12), ("term_bins", "term_months", 10), ("lag_bins", "lag_days", 12))


def model(deals: DataFrame, chosen: filters.Filters, split_by: str = "lease_type", scratch: list[str] | None = None) -> dict[str, DataFrame]:
    """One frame for each figure of the dashboard, over the deals that are chosen.

    The deals are read once: the columns that count, of the deals that are chosen (the others leave a row of nulls), become a written
    table. Grouping sets over it count every category and every day of every series in one pass, another pass has the
    indicators, one more the histograms, and selection the medians; the frames are read from these few sums.
    scratch: gets the paths of the tables that the frames read.
    """
    made = [] if scratch is None else scratch
    source = stats.with_escalation(deals)
    keep = chosen_column(source, chosen)
    narrow = cut(source.select(keep.alias("kept"), *(F.when(keep, F.col(c)).alias(c) for c in dict.fromkeys((*READ, split_by)))), made)
    kept = stats.with_lag(narrow.filter("kept"))
    names = {column: stats.key_or_unspecified(column) for column in dict.fromkeys([*(c for _, c, *_ in BREAKDOWNS), split_by])}
    keyed = kept.select("*", *(key.alias(f"k_{c}") for c, key in names.items()))
    sets = [*([f"k_{c}"] for _, c, *_ in BREAKDOWNS), ["lease_date", f"k_{split_by}"], ["execution_date", f"k_{split_by}"]]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    cells = cut(keyed.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(*(F.grouping(c).alias(f"g_{c}") for c in columns), *stats.sums()), made)

    def of(keys: list[str]) -> DataFrame:
        return cells.filter(" and ".join(f"g_{c} = {int(c not in keys)}" for c in columns))

    single = cut(kept.agg(*(x.alias(n) for n, x in {**stats.indicators(), **stats.signings()}.items()), *stats.presences()), made)
    middle = medians(kept, [], {"median_area": F.col("area_leased"), "median_lag_days": F.col("lag_days")}, made)
    one = cut(single.crossJoin(middle).crossJoin(narrow.agg(F.count("*").alias("total_deals"))).withColumn("total", F.col("deal_count")), made)  # one row each
    bins = cut(stats.histograms(kept, {frame: (F.col(column), target) for frame, column, target in BINS}), made)
    lines = {}
    for frame, date, measure in (("activity", "lease_date", "area"), ("signed_activity", "execution_date", "deals")):
        days = of([date, f"k_{split_by}"]).filter(F.col(date).isNotNull()).select(F.col(date).alias("day"), F.col(f"k_{split_by}").alias("series"), *stats.SUMS)
        dates = days.select(F.col("day").alias("date"), F.explode(F.sequence(F.lit(1), F.least(F.col("deals"), F.lit(2)))))  # whether there are two dates or more is all that counts
        lines[frame] = stats.timeline(days, stats.grain(dates, "date").first().grain, measure=measure)
    return {
        "totals": one.select("total_deals", F.col("deal_count").alias("matching")),
        "kpis": one.select(*stats.KPIS),
        "activity": lines["activity"],
        "rent_trend": stats.rent_trend(lines["activity"]),
        **{frame: stats.ranked(of([f"k_{c}"]).select(F.col(f"k_{c}").alias("name"), *stats.SUMS), n, by, drop) for frame, c, n, by, drop in BREAKDOWNS},
        **{frame: bins.filter(F.col("name") == frame).drop("name") for frame, _, _ in BINS},
        "signing": one.select(*stats.SIGNING),
        "signed_activity": lines["signed_activity"],
        "coverage": stats.coverage_rows(one),
    }


def chosen_column(deals: DataFrame, chosen: filters.Filters) -> Column:
    """Whether a deal is chosen; never null."""
    return F.coalesce(reduce(Column.__and__, filters.predicates(deals, chosen).values()), F.lit(False))


def rows(frames: dict[str, DataFrame]) -> DataFrame:
    """frame, key, n, value, more: every row of every frame of ``model`` in one table, a row for each figure."""
    c = F.col
    no = F.lit(None).cast("double")
    measures = lambda *names: F.array(*(F.struct(F.lit(x).alias("key"), c(x).cast("double").alias("value")) for x in names))

    def shaped(frame: str, df: DataFrame) -> DataFrame:
        if frame in ("totals", "kpis", "signing"):
            named = [x for x, kind in df.dtypes if kind not in ("string", "date")]
            return df.select(F.inline(measures(*named))).select("key", F.lit(None).cast("long").alias("n"), "value", no.alias("more"))
        if frame in ("activity", "rent_trend", "signed_activity"):
            return df.select("key", "deals", "avg_rent", F.explode("by_type").alias("series", "amount")).select(F.concat_ws("|", "key", "series"), "deals", "amount", "avg_rent")
        if frame == "coverage":
            return df.select("label", "present", c("percent").cast("double"), no)
        if frame.endswith("_bins"):
            return df.select(c("bin").cast("string"), "count", "low", "high")
        return df.select(F.concat_ws("|", c("place").cast("string"), "name"), "deals", "area", "avg_rent")

    made = [shaped(frame, df).toDF("key", "n", "value", "more").select(F.lit(frame).alias("frame"), "key", c("n").cast("long").alias("n"), c("value").cast("double").alias("value"), c("more").cast("double").alias("more")) for frame, df in frames.items()]
    return reduce(DataFrame.unionByName, made)


def kpi_lines(kpis: DataFrame, signing: DataFrame) -> DataFrame:
    """place, id, label, value, note: the tiles of the dashboard as text, those of signing last. Both inputs are one row."""
    c = F.col
    none, per_sf = F.lit(None).cast("string"), F.lit("/SF")
    or_dash = lambda x, shown: F.when(c(x).isNull(), F.lit(show.EMPTY)).otherwise(shown)
    tiles = (
        ("deals", "Deals", show.number(c("deal_count")), F.concat_ws(" ", show.number(c("mapped_count")), F.lit("on the map"))),
        ("area", "Total area leased", show.compact(c("total_area")), F.when(c("median_area").isNotNull(), F.concat_ws(" ", F.lit("Median"), show.area(c("median_area"))))),
        ("rent", "Base rent", or_dash("weighted_base_rent", F.concat_ws(" ", show.money(c("weighted_base_rent")), per_sf)), F.lit("Annual, weighted by area leased")),
        ("term", "Average term", show.years(c("average_term")), F.when(c("average_term").isNull(), F.lit("No term data")).otherwise(show.short_months(c("average_term")))),
        ("freeRent", "Average free rent", or_dash("average_free_rent", F.concat(F.format_number(F.round("average_free_rent", 1), 1), F.lit(" mos"))), F.lit("Across deals that report it")),
        ("ti", "Average TI", or_dash("average_ti", F.concat_ws(" ", show.money(c("average_ti")), per_sf)), F.when(c("average_opex").isNotNull(), F.concat(F.lit("OpEx "), show.money(c("average_opex")), F.lit(" /SF/Yr")))),
        ("signed", "Deals signed", show.number(c("signed_count")), F.when(c("signed_from").isNotNull(), F.concat_ws(" to ", show.date(c("signed_from")), show.date(c("signed_to")))).otherwise(F.lit("No signed dates mapped"))),
        ("lag", "Signing to commencement", or_dash("median_lag_days", show.lag_days(c("median_lag_days"))), F.when(c("paired_count") == 0, F.lit("Needs both a signed date and a lease date")).otherwise(F.concat(F.lit("Median across "), show.number(c("paired_count")), F.lit(" deals with both dates")))),
        ("late", "Signed after commencement", F.when(c("paired_count") == 0, F.lit(show.EMPTY)).otherwise(show.number(c("signed_late_count"))), F.lit("Papered after the tenant took the space")),
    )
    rows = [F.struct(F.lit(k).alias("place"), F.lit(i).alias("id"), F.lit(label).alias("label"), value.alias("value"), F.coalesce(note, none).alias("note")) for k, (i, label, value, note) in enumerate(tiles, 1)]
    return kpis.crossJoin(signing).select(F.inline(F.array(*rows)))


def selection_line(totals: DataFrame, kpis: DataFrame, signing: DataFrame) -> DataFrame:
    """One row: line (how much is selected, its dates and places) and coverage (how many carry a signed date)."""
    matching, total = (F.format_number(x, 0) for x in ("matching", "total_deals"))
    sites = F.when(F.col("site_count") > 0, F.concat(F.format_number("site_count", 0), F.lit(" mapped locations")))
    line = F.concat_ws(" · ", F.concat(matching, F.lit(" of "), total, F.lit(" deals")), "date_range_label", sites)
    coverage = F.when(F.col("signed_count") == 0, F.lit("No signed dates are mapped in the current selection.")).otherwise(F.concat(F.format_number("signed_count", 0), F.lit(" of "), matching, F.lit(" matching deals carry one.")))
    return totals.crossJoin(kpis).crossJoin(signing).select(line.alias("line"), coverage.alias("coverage"))
