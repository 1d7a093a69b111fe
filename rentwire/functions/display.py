"""Display text of figures: money, areas, rents, terms, dates and lead times. A null figure is a dash."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import cells

EMPTY = "—"
#: Below so many days a lead time is told in days; days of a month.
MOST_DAYS, MONTH_DAYS = 62, 30.44
#: Fixed values, from large to small: least size, what it is divided by, decimals, mark.
COMPACT = ((1e9, 1e9, 1, "B"), (1e6, 1e6, 1, "M"), (1e4, 1e3, 0, "K"), (1e3, 1e3, 1, "K"), (1e1, 1.0, 0, ""), (0.0, 1.0, 1, ""))


def or_empty(x: Column, shown: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(EMPTY)).otherwise(shown)


def _fixed(x: Column, decimals: int) -> Column:
    """So many decimals, halves away from zero, thousands apart."""
    return F.format_number(F.round(x.cast("double"), decimals), decimals)


def number(x: Column) -> Column:
    return or_empty(x, _fixed(x, 0))


def area(x: Column) -> Column:
    return or_empty(x, F.concat(F.format_number(F.floor(x + 0.5), 0), F.lit(" SF")))


def money(x: Column, decimals: int = 2) -> Column:
    return or_empty(x, F.concat(F.when(F.round(x, decimals) < 0, F.lit("-$")).otherwise(F.lit("$")), _fixed(F.abs(x), decimals)))


def rent(x: Column, rate_type: Column) -> Column:
    """Money with its unit, by the words of the rate type or the size of the figure; a total has none and no cents."""
    unit = cells.rent_unit(x, rate_type)
    return or_empty(x, F.when(unit == "", money(x, 0)).otherwise(F.concat_ws(" ", money(x), unit)))


def _plain(x: Column) -> Column:
    """One decimal, or none for a whole number."""
    tenth = F.floor(x * 10 + 0.5) / 10
    return F.when(tenth == F.floor(tenth), F.floor(tenth).cast("string")).otherwise(_fixed(tenth, 1))


def years(months: Column) -> Column:
    return or_empty(months, F.when(months < 12, F.concat(_plain(months), F.lit(" mos"))).otherwise(F.concat(_fixed(months / 12, 1), F.lit(" yrs"))))


def short_months(months: Column) -> Column:
    return or_empty(months, F.concat(_plain(months), F.lit(" mos")))


def months(x: Column) -> Column:
    """Months, and from a year on the years as well."""
    tenth = F.floor(x * 10 + 0.5) / 10
    return or_empty(x, F.when(tenth == 1, F.lit("1 mo")).when(tenth < 12, F.concat(_plain(x), F.lit(" mos"))).otherwise(F.concat(_plain(x), F.lit(" mos ("), _plain(tenth / 12), F.lit(" yrs)"))))


def date(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM d, yyyy"), F.lit(EMPTY))


def month_year(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "MMM yyyy"), F.lit(EMPTY))


def text(x: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(EMPTY))


def compact(x: Column, prefix: str = "") -> Column:
    """1.2M, 450K, 82."""
    size, shown = F.abs(x), None
    for least, unit, decimals, mark in COMPACT:
        one = F.concat(F.when(x < 0, F.lit(f"-{prefix}")).otherwise(F.lit(prefix)), _fixed(size / unit, decimals), F.lit(mark))
        shown = F.when(size >= least, one) if shown is None else shown.when(size >= least, one)
    return or_empty(x, F.when(x == 0, F.lit(f"{prefix}0")).otherwise(shown))


def percent(x: Column, decimals: int = 1) -> Column:
    return or_empty(x, F.concat(F.replace(_fixed(x, decimals), F.lit(","), F.lit("")), F.lit("%")))


def lag_days(days: Column) -> Column:
    """Days, from about two months on months; may be negative."""
    return F.when(F.abs(days) < MOST_DAYS, F.concat(F.floor(days + 0.5).cast("string"), F.lit(" days"))).otherwise(F.concat(F.replace(_fixed(days / MONTH_DAYS, 1), F.lit(","), F.lit("")), F.lit(" mos")))
