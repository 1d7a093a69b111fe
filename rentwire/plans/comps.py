"""Registered queries over deals, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentwire.functions import cells, display as show
from rentwire.operators import cover, filters, shapes, stats, term_index
from rentwire.operators.filters import Filters
from rentwire.operators.medians import medians

from .view import DEALS, deals, rounded, table

D = f"WITH deals AS ({DEALS})"
#: The selection that the filter queries use.
CHOSEN = Filters(search="supplier 0", states=("asia", "Europe ", "AMERICA"), lease_types=("R", "n"), area_leased=(1000.0, 9000.0), base_rent=(None, 400.0), lease_date=("1995-01-01", "1999-12-31"))
_RENT = "coalesce(sum(CASE WHEN base_rent_annual IS NOT NULL AND area_leased > 0 THEN base_rent_annual * area_leased END) / sum(CASE WHEN base_rent_annual IS NOT NULL AND area_leased > 0 THEN area_leased END), avg(base_rent_annual))"
_DATES = "lease_date >= DATE '1995-01-01' AND lease_date <= DATE '1999-12-31'"
_REST = f"area_leased BETWEEN 1000 AND 9000 AND base_rent_annual <= 400 AND {_DATES} AND contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), 'supplier') AND contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), '0')"
_STATE, _TYPE = "lower(trim(state)) IN ('asia', 'europe', 'america')", "lower(trim(lease_type)) IN ('r', 'n')"
_PASS = f"({_REST} AND {_STATE} AND {_TYPE})"
SQUARE = shapes.Shape("polygon", ((30.2, -99.5), (31.7, -99.1), (31.4, -97.3), (30.9, -98.4), (30.1, -97.2)))
CIRCLE = shapes.Shape("circle", ((31.0, -98.5),), 60_000.0)
BOX = shapes.Shape("rectangle", ((30.5, -99.0), (31.5, -98.0)))

QUERIES, ORACLES = {}, {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


@register("L29_filtered_deals", f"{D} SELECT source_row, lessee, lessor, area_leased, base_rent_annual FROM deals WHERE {_PASS}")
def filtered_deals(spark, sf_dir):
    return filters.apply(deals(spark, sf_dir), CHOSEN).select("source_row", "lessee", "lessor", "area_leased", "base_rent_annual")


@register("L30_keyword", f"{D} SELECT count(*) AS n FROM deals WHERE contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), 'asia') AND contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), '1')")
def keyword(spark, sf_dir):
    d = deals(spark, sf_dir).drop("market")
    return d.filter(filters.keyword(d, " Asia  1")).agg(F.count("*").alias("n"))


@register("L30_indexed_keyword", f"{D} SELECT count(*) AS n, count(DISTINCT lessee) AS lessees FROM deals WHERE contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), 'asia') AND contains(lower(concat_ws(' ', property_name, city, state, lessee, lessor, property_subtype, lease_type)), '1')")
def indexed_keyword(spark, sf_dir):
    """The same search from posting lists of three letters."""
    d = deals(spark, sf_dir).drop("market")
    index = term_index.build(d, tuple(c for c in filters.SEARCHED if c in d.columns))
    return index.rows.join(term_index.holding(index, " Asia  1"), "rank", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("lessee").alias("lessees"))


@register("L31_date_preset", f"{D} SELECT state, count(*) AS n FROM deals WHERE lease_date >= DATE '1998-03-02' AND lease_date <= DATE '1999-03-31' - INTERVAL 29 DAY GROUP BY state")
def date_preset(spark, sf_dir):
    import datetime as dt

    span = filters.preset("12", dt.date(1999, 3, 2))
    return filters.apply(deals(spark, sf_dir), Filters(lease_date=span)).groupBy("state").agg(F.count("*").alias("n"))


def _edges(s):
    pts = s.points
    terms = []
    for (y1, x1), (y2, x2) in zip(pts, pts[-1:] + pts[:-1]):
        terms.append(f"CASE WHEN ({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - ({x1})) * (lat - {y1}) / ({y2} - {y1}) + ({x1}) THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


_METRES = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - 31.0) / 2), 2) + cos(radians(31.0)) * cos(radians(lat)) * pow(sin(radians(lon + 98.5) / 2), 2))))"


@register("L32_shapes", f"{D} SELECT 'polygon' AS kind, count(*) AS n FROM deals WHERE lat IS NOT NULL AND {_edges(SQUARE)} UNION ALL SELECT 'circle', count(*) FROM deals WHERE lat IS NOT NULL AND {_METRES} <= 60000 UNION ALL SELECT 'rectangle', count(*) FROM deals WHERE lat BETWEEN 30.5 AND 31.5 AND lon BETWEEN -99.0 AND -98.0")
def in_shapes(spark, sf_dir):
    d = deals(spark, sf_dir)
    own = [F.struct(F.lit(s.kind).alias("kind"), (F.col("lat").isNotNull() & shapes.contains(s, F.col("lat"), F.col("lon"))).alias("inside")) for s in (SQUARE, CIRCLE, BOX)]
    return d.select(F.inline(F.array(*own))).groupBy("kind").agg(F.count_if("inside").alias("n"))


#: A shape for each supplier, around a point by its number: corners of the polygons from there, half the side of the rectangles, radius of the circles.
_CORNERS, _HALF, _REACH = ((-0.1003, -0.1501), (-0.05, 0.12), (0.11, 0.08), (0.0207, 0.0103), (0.09, -0.1)), 0.1017, 9000.0
_PLACED = "SELECT s_suppkey, 30.0005::DOUBLE + (s_suppkey * 37 % 2000) / 1000.0::DOUBLE AS cy, -97.0005::DOUBLE - (s_suppkey * 91 % 3000) / 1000.0::DOUBLE AS cx FROM supplier"
_CROSSED = " + ".join(f"CASE WHEN (cy + {y1} > lat) <> (cy + {y2} > lat) AND lon < (cx + {x2} - (cx + {x1})) * (lat - (cy + {y1})) / (cy + {y2} - (cy + {y1})) + (cx + {x1}) THEN 1 ELSE 0 END" for (y1, x1), (y2, x2) in zip(_CORNERS, _CORNERS[-1:] + _CORNERS[:-1]))
_AWAY = f"2 * {shapes.RADIUS_M} * asin(least(1.0, sqrt(pow(sin(radians(lat - cy) / 2), 2) + cos(radians(cy)) * cos(radians(lat)) * pow(sin(radians(lon - cx) / 2), 2))))"


@register("L32_shape_table", f"{D}, p AS ({_PLACED}) SELECT s_suppkey, count(*) AS n FROM p, deals WHERE lat IS NOT NULL AND CASE s_suppkey % 3 WHEN 0 THEN ({_CROSSED}) % 2 = 1 WHEN 1 THEN {_AWAY} <= {_REACH} ELSE abs(lat - cy) <= {_HALF} AND abs(lon - cx) <= {_HALF} END GROUP BY s_suppkey")
def shape_table(spark, sf_dir):
    """Deals in each of a table of polygons, circles and rectangles."""
    placed = spark.sql(_PLACED.replace("::DOUBLE", "D").replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))
    ring = lambda corners: F.array(*(F.struct((F.col("cy") + y).alias("lat"), (F.col("cx") + x).alias("lon")) for y, x in corners))
    of = F.col("s_suppkey") % 3
    kind = F.when(of == 0, "polygon").when(of == 1, "circle").otherwise("rectangle")
    rings = F.when(of == 0, ring(_CORNERS)).when(of == 1, ring([(0.0, 0.0)])).otherwise(ring([(-_HALF, -_HALF), (_HALF, _HALF)]))
    drawn = placed.select(F.col("s_suppkey").cast("string").alias("shape_id"), kind.alias("kind"), rings.alias("ring"), F.lit(_REACH).alias("radius"))
    return cover.counts(deals(spark, sf_dir).select("lat", "lon"), drawn).select(F.col("shape_id").cast("long").alias("s_suppkey"), "n")


@register("L34_facets", f"{D} SELECT DISTINCT * FROM (SELECT 'cities' AS facet, trim(city) AS value FROM deals UNION ALL SELECT 'states', trim(state) FROM deals UNION ALL SELECT 'lease_types', trim(lease_type) FROM deals UNION ALL SELECT 'property_subtypes', trim(property_subtype) FROM deals) WHERE value <> ''")
def facets(spark, sf_dir):
    return filters.facets(deals(spark, sf_dir))


@register(
    "L35_facet_counts",
    f"{D} SELECT facet, value, count(*) AS n FROM (SELECT 'cities' AS facet, trim(city) AS value FROM deals WHERE {_PASS} UNION ALL SELECT 'states', trim(state) FROM deals WHERE {_REST} AND {_TYPE} UNION ALL SELECT 'lease_types', trim(lease_type) FROM deals WHERE {_REST} AND {_STATE} UNION ALL SELECT 'property_subtypes', trim(property_subtype) FROM deals WHERE {_PASS}) WHERE value <> '' GROUP BY facet, value",
)
def facet_counts(spark, sf_dir):
    return filters.facet_counts(deals(spark, sf_dir), CHOSEN)


_BOUNDS = ", ".join(f"{f}({c}) AS {n}_{f}" for n, c in (("area_leased", "area_leased"), ("term_months", "term_months"), ("base_rent", "base_rent_annual"), ("free_rent", "free_rent"), ("lease_date", "lease_date"), ("execution_date", "execution_date")) for f in ("min", "max"))


@register("L36_bounds", f"{D} SELECT * REPLACE (round(base_rent_min, 4) AS base_rent_min, round(base_rent_max, 4) AS base_rent_max) FROM (SELECT {_BOUNDS} FROM deals)")
def bounds(spark, sf_dir):
    return rounded(filters.bounds(deals(spark, sf_dir)))


_ORDER = "area_leased DESC NULLS LAST, source_row, lessee, lessor, base_rent_annual, lease_date"


@register("L37_sorted_page", f"{D} SELECT area_leased, source_row FROM deals WHERE lessee <> '' ORDER BY area_leased DESC NULLS LAST, source_row LIMIT 50 OFFSET 100")
def sorted_page(spark, sf_dir):
    return filters.page(deals(spark, sf_dir).select("area_leased", "source_row"), "area_leased", True, 3, 50)


@register("L38_first_page_by_text", f"{D} SELECT city, source_row FROM deals ORDER BY CASE WHEN trim(city) <> '' THEN lower(trim(city)) END ASC NULLS LAST, source_row LIMIT 25")
def first_page_by_text(spark, sf_dir):
    return filters.page(deals(spark, sf_dir).select("city", "source_row"), "city", False, 1, 25)


@register("L38_deep_page", f"{D} SELECT area_leased, source_row FROM deals ORDER BY area_leased DESC NULLS LAST, source_row LIMIT 25 OFFSET 24975")
def deep_page(spark, sf_dir):
    """The thousandth page of 25, read from the parts of a sorted table that hold it."""
    return filters.page_index(deals(spark, sf_dir).select("area_leased", "source_row"), "area_leased", True).page(1000, 25)


@register("L39_report_rows", f"{D} SELECT source_row, lease_date, lessee FROM deals WHERE confidentiality NOT IN ('Confidential', 'Yes') ORDER BY lease_date DESC NULLS LAST, source_row, lessee LIMIT 100")
def report_rows(spark, sf_dir):
    return filters.report_rows(deals(spark, sf_dir), 100, ("source_row", "lease_date", "lessee"))


@register("L39_report_counts", f"{D} SELECT count(*) FILTER (WHERE confidentiality NOT IN ('Confidential', 'Yes')) AS available, count(*) FILTER (WHERE confidentiality IN ('Confidential', 'Yes')) AS omitted FROM deals")
def report_counts(spark, sf_dir):
    return filters.report_counts(deals(spark, sf_dir))


@register("L40_filter_lines", f"{D} SELECT count(*) AS deals, 'Search: supplier 0|State: asia, Europe , AMERICA|Lease type: R, n|Commencement: 1995-01-01 to 1999-12-31|Area leased: 1000.0 to 9000.0|Base rent: up to 400.0' AS filters FROM deals WHERE {_PASS}")
def filter_lines(spark, sf_dir):
    return filters.apply(deals(spark, sf_dir), CHOSEN).agg(F.count("*").alias("deals"), F.lit("|".join(filters.describe(CHOSEN))).alias("filters"))


@register("L41_basic_statistics", f"{D} SELECT city, round(avg(term_months), 4) AS mean, median(area_leased) AS median, sum(area_leased) AS total FROM deals GROUP BY city")
def basic_statistics(spark, sf_dir):
    d = deals(spark, sf_dir).select("city", "term_months", "area_leased")
    plain = d.groupBy("city").agg(F.avg("term_months").alias("mean"), F.sum("area_leased").alias("total"))
    return rounded(plain.join(medians(d, ["city"], {"median": F.col("area_leased")}), "city").select("city", "mean", "median", "total"))


@register("L42_weighted_rent", f"{D} SELECT lessor, round({_RENT}, 4) AS rent FROM deals GROUP BY lessor")
def weighted_rent(spark, sf_dir):
    return rounded(deals(spark, sf_dir).groupBy("lessor").agg(stats.weighted_mean(F.col("base_rent_annual"), F.col("area_leased")).alias("rent")))


_KPIS = f"""SELECT count(*) AS deal_count, count(lat) AS mapped_count, count(DISTINCT CASE WHEN lat IS NOT NULL THEN printf('%.5f,%.5f', lat, lon) END) AS site_count, sum(area_leased) AS total_area,
median(area_leased) AS median_area, round({_RENT}, 4) AS weighted_base_rent, round(avg(base_rent_annual), 4) AS average_base_rent, round(avg(term_months), 4) AS average_term, round(avg(free_rent), 4) AS average_free_rent,
round(avg(ti_allowance), 4) AS average_ti, round(avg(opex_annual), 4) AS average_opex,
CASE WHEN min(lease_date) IS NULL THEN 'No lease dates' WHEN strftime(min(lease_date), '%b %Y') = strftime(max(lease_date), '%b %Y') THEN strftime(min(lease_date), '%b %Y') ELSE strftime(min(lease_date), '%b %Y') || ' to ' || strftime(max(lease_date), '%b %Y') END AS date_range_label FROM deals"""


@register("L43_kpis", f"{D} {_KPIS}")
def kpis(spark, sf_dir):
    return rounded(stats.kpis(deals(spark, sf_dir)))


def _breakdown(column: str, limit: int, order: str, drop: bool) -> str:
    return f"""{D}, c AS (SELECT CASE WHEN trim({column}) = '' THEN 'Not specified' ELSE trim({column}) END AS name, count(*) AS deals, coalesce(sum(area_leased), 0) AS area, {_RENT} AS avg_rent, avg(term_months) AS avg_term, min(source_row) AS first_row FROM deals GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY {order}, first_row, name) AS place FROM c {"WHERE name <> 'Not specified'" if drop else ""})
SELECT CAST(place AS INTEGER) AS place, name, deals, area, round(avg_rent, 4) AS avg_rent, round(avg_term, 4) AS avg_term FROM k WHERE place <= {limit}
UNION ALL SELECT {limit + 1}, 'Other (' || count(*) || ')', CAST(sum(deals) AS BIGINT), sum(area), NULL, NULL FROM k WHERE place > {limit} HAVING count(*) > 0"""


@register("L44_by_lease_type", _breakdown("lease_type", 8, "deals DESC, area DESC", False))
def by_lease_type(spark, sf_dir):
    return rounded(stats.category_breakdown(deals(spark, sf_dir), "lease_type", 8))


@register("L44_by_city", _breakdown("city", 10, "area DESC", True))
def by_city(spark, sf_dir):
    return rounded(stats.category_breakdown(deals(spark, sf_dir), "city", 10, "area", True))


@register("L44_by_subtype", _breakdown("property_subtype", 8, "avg_rent DESC NULLS LAST", True))
def by_subtype(spark, sf_dir):
    return rounded(stats.category_breakdown(deals(spark, sf_dir), "property_subtype", 8, "avg_rent", True))


@register("L44_by_lessor", _breakdown("lessor", 10, "area DESC", True))
def by_lessor(spark, sf_dir):
    return rounded(stats.category_breakdown(deals(spark, sf_dir), "lessor", 10, "area", True))


@register("L45_grain", f"{D} SELECT CASE WHEN count(lease_date) < 2 THEN 'quarter' WHEN date_diff('day', min(lease_date), max(lease_date)) / 30.44 <= 30 THEN 'month' WHEN date_diff('day', min(lease_date), max(lease_date)) / 30.44 <= 120 THEN 'quarter' ELSE 'year' END AS grain FROM deals")
def grain(spark, sf_dir):
    return stats.grain(deals(spark, sf_dir))


def _series(date: str, measure: str, only_rent: bool = False) -> str:
    amount = "1.0" if measure == "deals" else "coalesce(area_leased, 0)"
    return f"""{D}, d AS (SELECT *, CASE WHEN trim(property_subtype) = '' THEN 'Not specified' ELSE trim(property_subtype) END AS cat, year({date}) || '-Q' || quarter({date}) AS key FROM deals WHERE {date} IS NOT NULL),
t AS (SELECT cat, row_number() OVER (ORDER BY sum(coalesce(area_leased, 0) + 1) DESC, cat) AS r FROM d GROUP BY cat),
m AS (SELECT d.*, CASE WHEN t.r <= 5 THEN d.cat ELSE 'Other' END AS series FROM d JOIN t USING (cat)),
b AS (SELECT key, count(*) AS deals, sum(coalesce(area_leased, 0)) AS area, round({_RENT}, 4) AS avg_rent FROM m GROUP BY key),
s AS (SELECT b.key, x.series, coalesce(sum({amount.replace("area_leased", "m.area_leased")}) FILTER (WHERE m.key IS NOT NULL), 0.0) AS amount FROM b CROSS JOIN (SELECT DISTINCT series FROM m) x LEFT JOIN m ON m.key = b.key AND m.series = x.series GROUP BY 1, 2)
SELECT b.key, b.deals, b.area, b.avg_rent, s.series, s.amount FROM b JOIN s USING (key){" WHERE b.avg_rent IS NOT NULL" if only_rent else ""}"""


def _long(series):
    return rounded(series.select("key", "deals", "area", "avg_rent", F.explode("by_type").alias("series", "amount")))


@register("L46_activity", _series("lease_date", "area"))
def activity(spark, sf_dir):
    return _long(stats.time_series(deals(spark, sf_dir), "quarter", "property_subtype", 5))


@register("L46_signed_activity", _series("execution_date", "deals"))
def signed_activity(spark, sf_dir):
    return _long(stats.time_series(deals(spark, sf_dir), "quarter", "property_subtype", 5, "execution_date", "deals"))


@register("L47_rent_trend", _series("lease_date", "area", True))
def rent_trend(spark, sf_dir):
    return _long(stats.rent_trend(stats.time_series(deals(spark, sf_dir), "quarter", "property_subtype", 5)))


def _histogram(value: str, target: int) -> str:
    return f"""{D}, v AS (SELECT CAST({value} AS DOUBLE) AS v FROM deals WHERE {value} IS NOT NULL),
a AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {target} AS raw FROM v), g AS (SELECT *, pow(10.0, floor(log10(raw))) AS size FROM a WHERE lo < hi),
e AS (SELECT lo, hi, size * CASE WHEN raw / size <= 1 THEN 1.0 WHEN raw / size <= 2 THEN 2.0 WHEN raw / size <= 2.5 THEN 2.5 WHEN raw / size <= 5 THEN 5.0 ELSE 10.0 END AS step FROM g),
f AS (SELECT *, floor(lo / step) * step AS start, CAST(greatest(1, least(40, ceil((hi - floor(lo / step) * step) / step))) AS BIGINT) AS bins FROM e),
c AS (SELECT CAST(greatest(0, least(bins - 1, floor((v - start) / step))) AS BIGINT) AS bin, count(*) AS n FROM v, f GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(start + b.bin * step, 4) AS low, round(start + b.bin * step + step, 4) AS high, coalesce(n, 0) AS count FROM (SELECT *, unnest(range(bins)) AS bin FROM f) b LEFT JOIN c ON b.bin = c.bin"""


@register("L48_area_histogram", _histogram("area_leased", 12))
def area_histogram(spark, sf_dir):
    return rounded(stats.histogram(deals(spark, sf_dir), "area_leased", 12))


@register("L48_rent_histogram", _histogram("base_rent_annual", 10))
def rent_histogram(spark, sf_dir):
    return rounded(stats.histogram(deals(spark, sf_dir), "base_rent_annual", 10))


@register("L50_lag_histogram", _histogram("date_diff('day', execution_date, lease_date)", 12))
def lag_histogram(spark, sf_dir):
    return rounded(stats.histogram(stats.with_lag(deals(spark, sf_dir)), "lag_days", 12))


_COVERED = ("count(lat)", "count(lease_date)", "count(execution_date)", "count(term_months)", "count(area_leased)", "count(base_rent)", "count(opex)", "count(CASE WHEN trim(escalation_text) <> '' THEN 1 END)", "count(free_rent)", "count(ti_allowance)", "count(CASE WHEN trim(lease_type) <> '' THEN 1 END)", "count(CASE WHEN trim(property_subtype) <> '' THEN 1 END)", "count(CASE WHEN trim(lessor) <> '' THEN 1 END)")


@register("L49_coverage", D + " " + " UNION ALL ".join(f"SELECT {k + 1} AS place, '{label}' AS label, {count} AS present, count(*) AS total, CAST(floor({count} * 100 / count(*) + 0.5) AS INTEGER) AS percent FROM deals" for k, ((label, _), count) in enumerate(zip(stats.COVERAGE, _COVERED))))
def coverage(spark, sf_dir):
    return stats.coverage(deals(spark, sf_dir))


@register("L50_signing", f"{D} SELECT count(execution_date) AS signed_count, count(date_diff('day', execution_date, lease_date)) AS paired_count, median(date_diff('day', execution_date, lease_date)) AS median_lag_days, count(*) FILTER (WHERE date_diff('day', execution_date, lease_date) < 0) AS signed_late_count, min(execution_date) AS signed_from, max(execution_date) AS signed_to FROM deals")
def signing(spark, sf_dir):
    return stats.signing(deals(spark, sf_dir))


@register("L51_dashboard", f"{D}, f AS (SELECT * FROM deals WHERE {_PASS}), k AS ({_KPIS.replace('FROM deals', 'FROM f')}) SELECT total_deals, deal_count AS matching, weighted_base_rent, median_area, late FROM k, (SELECT count(*) AS total_deals FROM deals), (SELECT count(*) FILTER (WHERE lease_date < execution_date) AS late FROM f)")
def dashboard(spark, sf_dir):
    from .dashboard import model

    m = model(deals(spark, sf_dir), CHOSEN)
    return rounded(m["totals"].crossJoin(m["kpis"].select("weighted_base_rent", "median_area")).crossJoin(m["signing"].select(F.col("signed_late_count").alias("late"))))


_F = f"WITH every AS ({DEALS}), deals AS (SELECT * FROM every WHERE {_PASS})"


def _frame(name: str, sql: str, key: str, n: str, value: str, more: str) -> str:
    return f"SELECT '{name}' AS frame, {key} AS key, CAST({n} AS BIGINT) AS n, CAST({value} AS DOUBLE) AS value, CAST({more} AS DOUBLE) AS more FROM ({sql.replace(D, _F)})"


_FIGURES_OF = {
    "totals": (f"{_F} SELECT (SELECT count(*) FROM every) AS total_deals, count(*) AS matching FROM deals", ("total_deals", "matching")),
    "kpis": (f"{D} {_KPIS}", ("deal_count", "mapped_count", "site_count", "total_area", "median_area", "weighted_base_rent", "average_base_rent", "average_term", "average_free_rent", "average_ti", "average_opex")),
    "signing": (ORACLES["L50_signing"], ("signed_count", "paired_count", "median_lag_days", "signed_late_count")),
}
_FRAMES = [
    *(_frame(name, f"SELECT unnest([{', '.join(repr(x) for x in names)}]) AS key, unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in names)}]) AS value FROM ({sql})", "key", "NULL", "value", "NULL") for name, (sql, names) in _FIGURES_OF.items()),
    *(_frame(name, _series(date, measure, only), "key || '|' || series", "deals", "amount", "avg_rent") for name, date, measure, only in (("activity", "lease_date", "area", False), ("rent_trend", "lease_date", "area", True), ("signed_activity", "execution_date", "deals", False))),
    *(_frame(name, ORACLES[f"L44_{name}"], "place || '|' || name", "deals", "area", "avg_rent") for name in ("by_lease_type", "by_city", "by_subtype", "by_lessor")),
    *(_frame(name, _histogram(value, target), "CAST(bin AS VARCHAR)", "count", "low", "high") for name, value, target in (("area_bins", "area_leased", 12), ("term_bins", "term_months", 10), ("lag_bins", "date_diff('day', execution_date, lease_date)", 12))),
    _frame("coverage", ORACLES["L49_coverage"], "label", "present", "percent", "NULL"),
]


@register("L51_frames", "SELECT frame, key, n, round(value, 4) AS value, round(more, 4) AS more FROM (" + " UNION ALL ".join(_FRAMES) + ")")
def frames(spark, sf_dir):
    """All fourteen frames, from one read of the deals."""
    from .dashboard import model, rows

    return rounded(rows(model(deals(spark, sf_dir), CHOSEN, split_by="property_subtype")))


_COMMAS = "format('{{:,}}', CAST(floor({0} + 0.5) AS BIGINT))"
_ONE = "printf('%.1f', floor(({0}) * 10 + 0.5) / 10)"
_PLAIN = "CASE WHEN floor({0} * 10 + 0.5) % 10 = 0 THEN CAST(CAST(floor({0} * 10 + 0.5) / 10 AS BIGINT) AS VARCHAR) ELSE " + _ONE + " END"
_CENTS = "CAST(floor(abs({0}) * 100 + 0.5) AS BIGINT)"
_MONEY = "CASE WHEN {0} < 0 THEN '-$' ELSE '$' END || format('{{:,}}', " + _CENTS + " // 100) || '.' || lpad(CAST(" + _CENTS + " % 100 AS VARCHAR), 2, '0')"
#: Figures of many sizes, in quarters, so that both engines round the same numbers.
_FIGURES = "SELECT l_orderkey, l_linenumber, l_partkey, (l_orderkey * 7919 + l_partkey) % 4000000 / 4.0::DOUBLE AS x, (l_orderkey % 700) / 4.0::DOUBLE AS m, CAST(l_partkey % 400 - 200 AS BIGINT) AS d, l_linestatus FROM lineitem"


@register(
    "L26_display",
    f"""WITH f AS ({_FIGURES}) SELECT l_orderkey, l_linenumber, l_partkey, {_COMMAS.format('x')} || ' SF' AS area, {_MONEY.format('x')} AS money,
CASE WHEN l_linestatus = 'O' THEN {_MONEY.format('m')} || ' /SF/Mo' WHEN m > 0 AND m < 400 THEN {_MONEY.format('m')} || ' /SF/Yr' ELSE '$' || {_COMMAS.format('m')} END AS rent,
CASE WHEN m < 12 THEN {_PLAIN.format('m')} || ' mos' ELSE {_ONE.format('m / 12')} || ' yrs' END AS years,
CASE WHEN floor(m * 10 + 0.5) = 10 THEN '1 mo' WHEN floor(m * 10 + 0.5) < 120 THEN {_PLAIN.format('m')} || ' mos' ELSE {_PLAIN.format('m')} || ' mos (' || {_PLAIN.format('(floor(m * 10 + 0.5) / 10 / 12)')} || ' yrs)' END AS months,
CASE WHEN x = 0 THEN '0' WHEN x >= 10000 THEN {_COMMAS.format('x / 1000')} || 'K' WHEN x >= 1000 THEN {_ONE.format('x / 1000')} || 'K' WHEN x >= 10 THEN {_COMMAS.format('x')} ELSE {_ONE.format('x')} END AS compact,
{_ONE.format('m')} || '%' AS percent, CASE WHEN abs(d) < 62 THEN d || ' days' ELSE CASE WHEN d < 0 THEN '-' ELSE '' END || {_ONE.format('abs(d) / 30.44')} || ' mos' END AS lag FROM f""",
)
def display_text(spark, sf_dir):
    f = spark.sql(_FIGURES.replace("FROM lineitem", "FROM {lineitem}").replace("::DOUBLE", "D"), lineitem=table(spark, sf_dir, "lineitem"))
    x, m = F.col("x"), F.col("m")
    rate = F.when(F.col("l_linestatus") == "O", F.lit("Monthly")).otherwise(F.lit(""))
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey", show.area(x).alias("area"), show.money(x).alias("money"), show.rent(m, rate).alias("rent"), show.years(m).alias("years"), show.months(m).alias("months"),
        show.compact(x).alias("compact"), show.percent(m).alias("percent"), show.lag_days(F.col("d")).alias("lag"),
    )


_SIGNED = "SELECT count(execution_date) AS signed, min(execution_date) AS since, max(execution_date) AS until FROM deals"
_DAY = "strftime({0}, '%b %-d, %Y')"


@register(
    "L52_lines",
    f"""{D}, k AS ({_KPIS}), s AS ({_SIGNED}) SELECT 'deals' AS id, {_COMMAS.format('deal_count')} AS value, {_COMMAS.format('mapped_count')} || ' on the map' AS note FROM k
UNION ALL SELECT 'signed', {_COMMAS.format('signed')}, {_DAY.format('since')} || ' to ' || {_DAY.format('until')} FROM s
UNION ALL SELECT 'selection', {_COMMAS.format('deal_count')} || ' of ' || {_COMMAS.format('deal_count')} || ' deals · ' || date_range_label || ' · ' || {_COMMAS.format('site_count')} || ' mapped locations', {_COMMAS.format('signed')} || ' of ' || {_COMMAS.format('deal_count')} || ' matching deals carry one.' FROM k, s""",
)
def lines(spark, sf_dir):
    from .dashboard import kpi_lines, selection_line

    d = deals(spark, sf_dir)
    k, s = stats.kpis(d), stats.signing(d)
    counted = k.select(F.col("deal_count").alias("matching"), F.col("deal_count").alias("total_deals"))
    told = kpi_lines(k, s).filter("id in ('deals', 'signed')").select("id", "value", "note")
    return told.unionByName(selection_line(counted, k, s).select(F.lit("selection").alias("id"), F.col("line").alias("value"), F.col("coverage").alias("note")))


@register("L33_shape_areas", f"SELECT s_suppkey, round({shapes.RADIUS_M}::DOUBLE * {shapes.RADIUS_M} * radians(0.5) * abs(sin(radians(s_suppkey % 60 + 0.25)) - sin(radians(s_suppkey % 60 - 0.25))), 2) AS area, true AS near FROM supplier")
def shape_areas(spark, sf_dir):
    """A square of half a degree around each supplier, and whether a circle's ring has the circle's area but for a hundredth."""
    y, x, d = F.col("s_suppkey") % 60, -F.col("s_suppkey") % 90, 0.25
    square = F.array(*(F.struct((y + sy * d).alias("lat"), (x + sx * d).alias("lon")) for sy, sx in ((-1, -1), (-1, 1), (1, 1), (1, -1))))
    ring = shapes.ring_area(shapes.circle_ring(y.cast("double"), x.cast("double"), F.lit(5000.0)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(shapes.ring_area(square), 2).alias("area"), F.abs(ring / (3.141592653589793 * 5000.0**2) - 1).between(0, 0.01).alias("near"))


# Cells: numbers, dates and durations are spelled out in several ways and read back; the oracle has the values themselves.
_SPELL_NUMBER = """SELECT l_orderkey, l_linenumber, l_partkey, k, i, c, CASE k
  WHEN 0 THEN '$' || CAST(i AS VARCHAR(20)) || '.' || lpad(CAST(c AS VARCHAR(20)), 2, '0')
  WHEN 1 THEN '(' || CAST(i AS VARCHAR(20)) || '.' || lpad(CAST(c AS VARCHAR(20)), 2, '0') || ')'
  WHEN 2 THEN CAST(7 + i AS VARCHAR(20)) || ',123.' || lpad(CAST(c AS VARCHAR(20)), 2, '0') || ' USD'
  WHEN 3 THEN CAST(7 + i AS VARCHAR(20)) || '.123,' || lpad(CAST(c AS VARCHAR(20)), 2, '0')
  WHEN 4 THEN ' N/A '
  WHEN 5 THEN CAST(i AS VARCHAR(20)) || ',' || lpad(CAST(c AS VARCHAR(20)), 2, '0')
  WHEN 6 THEN CAST(7 + i AS VARCHAR(20)) || ',456'
  WHEN 7 THEN '-' || CAST(i AS VARCHAR(20)) || ' SF'
  WHEN 8 THEN '1,' || lpad(CAST(c AS VARCHAR(20)), 3, '0') || ',456'
  ELSE 'tbd' END AS cell
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 10 AS k, CAST(floor(l_extendedprice) AS BIGINT) % 900 AS i, CAST(floor(l_quantity) AS BIGINT) % 100 AS c FROM {})"""


@register("L14_numbers", f"SELECT k, count(*) AS n, count(v) AS read, round(sum(v), 2) AS total FROM (SELECT k, CASE k WHEN 0 THEN i + c / 100.0 WHEN 1 THEN -(i + c / 100.0) WHEN 2 THEN (7 + i) * 1000 + 123 + c / 100.0 WHEN 3 THEN (7 + i) * 1000 + 123 + c / 100.0 WHEN 5 THEN i + c / 100.0 WHEN 6 THEN (7 + i) * 1000 + 456 WHEN 7 THEN -i WHEN 8 THEN 1000456 + c * 1000 END AS v FROM ({_SPELL_NUMBER.format('lineitem')})) GROUP BY k")
def numbers(spark, sf_dir):
    spelled = spark.sql(_SPELL_NUMBER.format("{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    v = cells.to_number(F.col("cell"))
    return rounded(spelled.groupBy("k").agg(F.count("*").alias("n"), F.count(v).alias("read"), F.sum(v).alias("total")), 2)


@register("L15_areas", f"SELECT k, count(v) FILTER (WHERE v > 0) AS areas FROM (SELECT k, CASE k WHEN 0 THEN i + c / 100.0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN i + c / 100.0 WHEN 6 THEN 1 WHEN 8 THEN 1 END AS v FROM ({_SPELL_NUMBER.format('lineitem')})) GROUP BY k")
def areas(spark, sf_dir):
    spelled = spark.sql(_SPELL_NUMBER.format("{lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return spelled.groupBy("k").agg(F.count(cells.to_area(F.col("cell"))).alias("areas"))


_DATE_KINDS = "CAST(l_shipdate AS DATE) AS d, l_partkey % 10 AS k"
_M3 = "('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec')"


def _spelled_dates(df):
    d, k = F.col("l_shipdate").cast("date"), F.col("l_partkey") % 10
    y, m, day = F.year(d), F.month(d), F.dayofmonth(d)
    short, long_ = F.date_format(d, "MMM"), F.date_format(d, "MMMM")
    cell = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.format_string("%d/%d/%d", m, day, y))
        .when(k == 2, F.format_string("%d/%d/%02d", m, day, y % 100))
        .when(k == 3, F.format_string("%d %s %d", day, short, y))
        .when(k == 4, F.format_string("%s %d, %d", long_, day, y))
        .when(k == 5, F.format_string("%s %d", long_, y))
        .when(k == 6, F.format_string("%d", F.datediff(d, F.lit("1899-12-30").cast("date"))))
        .when(k == 7, y.cast("string"))
        .when(k == 8, F.lit("TBD"))
        .otherwise(F.format_string("%s-%02d", F.lower(short), y % 100))
    )
    return df.select(k.alias("k"), d.alias("d"), cell.alias("cell"))


@register("L17_dates", f"SELECT k, count(*) AS n, count(v) AS read, min(v) AS first, max(v) AS last, sum(date_diff('day', DATE '1970-01-01', v)) AS days FROM (SELECT k, CASE WHEN k IN (0, 1, 2, 3, 4, 6) THEN d WHEN k IN (5, 9) THEN CAST(date_trunc('month', d) AS DATE) WHEN k = 7 THEN CAST(date_trunc('year', d) AS DATE) END AS v FROM (SELECT {_DATE_KINDS} FROM lineitem)) GROUP BY k")
def dates(spark, sf_dir):
    v = cells.to_date(F.col("cell"))
    read = _spelled_dates(table(spark, sf_dir, "lineitem")).select("k", v.alias("v"))
    return read.groupBy("k").agg(F.count("*").alias("n"), F.count("v").alias("read"), F.min("v").alias("first"), F.max("v").alias("last"), F.sum(F.datediff("v", F.lit("1970-01-01").cast("date"))).alias("days"))


_TERM = "CASE l_partkey % 6 WHEN 0 THEN CAST(l_linenumber AS VARCHAR(9)) || ' yrs ' || CAST(l_suppkey % 12 AS VARCHAR(9)) || ' months' WHEN 1 THEN CAST(l_linenumber AS VARCHAR(9)) || ' Years' WHEN 2 THEN CAST(l_suppkey % 90 AS VARCHAR(9)) || ' mo' WHEN 3 THEN CAST(l_linenumber AS VARCHAR(9)) WHEN 4 THEN CAST(l_suppkey % 300 AS VARCHAR(9)) || ' days' ELSE CAST(l_linenumber AS VARCHAR(9)) || ' weeks' END"


@register("L18_terms", "SELECT k, count(m) AS n, round(sum(m), 2) AS months, round(sum(y), 2) AS in_years, round(sum(f), 2) AS free FROM (SELECT l_partkey % 6 AS k, CASE l_partkey % 6 WHEN 0 THEN l_linenumber * 12 + l_suppkey % 12 WHEN 1 THEN l_linenumber * 12 WHEN 2 THEN l_suppkey % 90 WHEN 3 THEN l_linenumber WHEN 4 THEN (l_suppkey % 300) / 30.4375 ELSE l_linenumber END AS m, CASE l_partkey % 6 WHEN 0 THEN l_linenumber * 12 + l_suppkey % 12 WHEN 1 THEN l_linenumber * 12 WHEN 2 THEN l_suppkey % 90 WHEN 3 THEN l_linenumber * 12 WHEN 4 THEN (l_suppkey % 300) / 30.4375 ELSE l_linenumber * 12 END AS y, CASE l_partkey % 6 WHEN 0 THEN l_linenumber * 12 + l_suppkey % 12 WHEN 1 THEN l_linenumber * 12 WHEN 2 THEN l_suppkey % 90 WHEN 3 THEN l_linenumber WHEN 4 THEN (l_suppkey % 300) / 30.4375 ELSE l_linenumber / 4.345 END AS f FROM lineitem) GROUP BY k")
def terms(spark, sf_dir):
    cell = F.expr(_TERM)
    read = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 6).alias("k"), cells.to_months(cell).alias("m"), cells.to_months(cell, True).alias("y"), cells.to_free_rent_months(cell).alias("f"))
    return rounded(read.groupBy("k").agg(F.count("m").alias("n"), F.sum("m").alias("months"), F.sum("y").alias("in_years"), F.sum("f").alias("free")), 2)


@register("L16_coordinates", "SELECT l_linenumber, count(*) FILTER (WHERE v BETWEEN -90 AND 90 AND v <> 0) AS lats, count(*) FILTER (WHERE v <> 0) AS lons FROM (SELECT l_linenumber, l_suppkey % 181 - 90 + l_linenumber AS v FROM lineitem) GROUP BY l_linenumber")
def coordinates(spark, sf_dir):
    cell = F.concat((F.col("l_suppkey") % 181 - 90 + F.col("l_linenumber")).cast("string"), F.lit("°"))
    read = table(spark, sf_dir, "lineitem").select("l_linenumber", cells.to_coordinate(cell, 90).alias("lat"), cells.to_coordinate(cell, 180).alias("lon"))
    return read.groupBy("l_linenumber").agg(F.count("lat").alias("lats"), F.count("lon").alias("lons"))


@register("L12_nullish", "SELECT l_returnflag, count(*) FILTER (WHERE l_linenumber IN (1, 3)) AS nullish, count(*) FILTER (WHERE l_linenumber NOT IN (1, 3)) AS text FROM lineitem GROUP BY l_returnflag")
def nullish(spark, sf_dir):
    cell = F.when(F.col("l_linenumber") == 1, F.lit(" Not Disclosed ")).when(F.col("l_linenumber") == 3, F.lit("#REF!")).otherwise(F.concat(F.lit(" a\u001e\u0007  "), F.col("l_returnflag")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(cells.is_nullish(cell)).alias("nullish"), F.count_if(cells.to_text(cell) == F.concat(F.lit("a- "), F.col("l_returnflag"))).alias("text"))


@register("L20_places", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'NH' WHEN 2 THEN 'QC' ELSE 'Elsewhere' END AS state, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey % 10000 AS VARCHAR), 5, '0') ELSE lpad(CAST(c_custkey % 10000 AS VARCHAR), 5, '0') || '-0042' END AS zip, CASE c_custkey % 3 WHEN 0 THEN 'St Mcallen of Springs' WHEN 1 THEN 'McKinney' ELSE 'de Soto' END AS city FROM customer".replace("St Mcallen of Springs", "St McAllen of Springs"))
def places(spark, sf_dir):
    k = F.col("c_custkey")
    state = F.element_at(F.array(F.lit("texas"), F.lit(" New Hampshire "), F.lit("qc"), F.lit("Elsewhere")), (k % 4 + 1).cast("int"))
    digits = (k % 10000).cast("string")
    zip_ = F.when(k % 3 == 0, digits).otherwise(F.concat(F.lpad(digits, 5, "0"), F.lit("-0042")))
    city = F.element_at(F.array(F.lit("ST MCALLEN OF SPRINGS"), F.lit("mckinney"), F.lit("de Soto")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", cells.normalize_state(state).alias("state"), cells.normalize_zip(zip_).alias("zip"), cells.title_case_city(city).alias("city"))


@register("L21_addresses", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_suppkey AS VARCHAR) || ' Main St' END AS street, CASE WHEN s_suppkey % 5 = 0 THEN 'name:' || lower(replace(s_name, '#', ' ')) || '|austin|tx|78701' ELSE CAST(s_suppkey AS VARCHAR) || ' main st|austin|tx|78701' END AS address_key, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) || ' Main St' END || ', Austin, TX, 78701' AS query FROM supplier")
def addresses(spark, sf_dir):
    k = F.col("s_suppkey")
    address = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(" Main  St, Suite #200"))).when(k % 5 == 2, F.concat(k.cast("string"), F.lit(" Main St Ste. 4B,"))).otherwise(F.concat(k.cast("string"), F.lit(" Main St, Floor 3 # 12")))
    parts = (address, F.lit("Austin"), F.lit("TX"), F.lit("78701"), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", cells.clean_street(address).alias("street"), cells.address_key(*parts).alias("address_key"), cells.geocode_query(*parts).alias("query"))


@register("L22_rates", f"{D} SELECT rate_type, CASE WHEN rate_type LIKE 'Monthly%' THEN '/SF/Mo' ELSE '/SF/Yr' END AS unit, count(base_rent) AS n, round(sum(CASE WHEN rate_type LIKE 'Monthly%' THEN base_rent * 12 ELSE base_rent END), 2) AS annual FROM deals GROUP BY rate_type")
def rates(spark, sf_dir):
    rate = cells.annualize(F.col("base_rent"), F.col("rate_type"))
    return rounded(deals(spark, sf_dir).groupBy("rate_type").agg(F.min(cells.rent_unit(F.col("base_rent"), F.col("rate_type"))).alias("unit"), F.count("base_rent").alias("n"), F.sum(rate).alias("annual")), 2)


@register("L23_escalations", "SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN '3%' WHEN 2 THEN '$1.50 · Fixed' WHEN 3 THEN 'CPI' WHEN 4 THEN '2.5% · Annual' WHEN 5 THEN '$0.75' WHEN 6 THEN '' ELSE '3% annually · from year 2' END AS escalation, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def escalations(spark, sf_dir):
    def pick(*values):
        return F.element_at(F.array(*map(F.lit, values)), F.least("l_linenumber", F.lit(7)))

    text = cells.resolve_escalation(pick("0.03", "$1.5", "CPI", "", "", " ", "3% annually"), pick("", "", "", "2.5", "0", "0.00", ""), pick("", "", "", "", ".75", "0", ""), pick("", "Fixed", "cpi", "Annual", "", "", "annually"), pick("", "", "", "", "", "", "from year 2"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.min(text).alias("escalation"), F.count("*").alias("n"))


@register("L24_confidential", f"{D} SELECT CASE WHEN confidentiality IN ('Confidential', 'Yes') THEN 'Confidential' ELSE '' END AS label, count(*) AS n FROM deals GROUP BY 1")
def confidential(spark, sf_dir):
    return deals(spark, sf_dir).groupBy(cells.confidentiality_label(F.col("confidentiality")).alias("label")).agg(F.count("*").alias("n"))


@register("L25_labels", f"{D} SELECT source_row % 5 AS k, CASE source_row % 5 WHEN 0 THEN 'Suite 12 · Floor 3' WHEN 1 THEN 'Tenant' WHEN 2 THEN 'Deal dated 2001-02-03' ELSE 'Row ' || source_row END AS label, 'A Co · B Firm (lessor) · Zed (lessee)' AS brokers, count(*) AS n FROM deals GROUP BY ALL")
def labels(spark, sf_dir):
    k = F.col("source_row") % 5
    label = cells.deal_label(F.when(k == 1, F.lit(" Tenant ")).otherwise(F.lit("")), F.when(k == 0, F.lit("suite 12")).otherwise(F.lit("")), F.when(k == 0, F.lit("3")).otherwise(F.lit("")), F.when(k == 2, F.lit("2001-02-03").cast("date")), F.col("source_row"))
    brokers = cells.resolve_brokers(F.lit("A Co"), F.lit(" co "), F.lit("B Firm"), F.lit("Zed"), F.lit(""))
    return deals(spark, sf_dir).groupBy(k.alias("k"), label.alias("label"), brokers.alias("brokers")).agg(F.count("*").alias("n"))
