"""Records of mapped sheets to typed deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rentwire.functions import cells

UNIT_ROWS = 400
TEXT = {
    "propertyName": "property_name", "county": "county", "market": "market", "submarket": "submarket", "district": "district", "propertyType": "property_type",
    "propertySubtype": "property_subtype", "buildingClass": "building_class", "leaseType": "lease_type", "rateType": "rate_type", "transactionType": "transaction_type",
    "suite": "suite", "floor": "floor", "escalation": "escalation", "escalationType": "escalation_type", "escalationPercent": "escalation_percent", "escalationValue": "escalation_value",
    "escalationComments": "escalation_comments", "tiAsIs": "ti_as_is", "tiNotes": "ti_notes", "otherConcessions": "other_concessions", "lessor": "lessor", "sublessor": "sublessor",
    "lessee": "lessee", "lessorBroker": "lessor_broker", "lessorBrokerFirm": "lessor_broker_firm", "lesseeBroker": "lessee_broker", "lesseeBrokerFirm": "lessee_broker_firm",
    "brokers": "brokers", "naicsCode": "naics_code", "notes": "notes", "compId": "comp_id",
}

FIELDS = ("address", "city", "state", "zip", "latitude", "longitude", "leaseDate", "executionDate", "expirationDate", "termMonths", "yearBuilt", "areaLeased", "officeArea", "baseRent", "effectiveRent", "opex", "freeRent", "tiAllowance", "confidentiality", *TEXT)


def term_units(records: DataFrame, column_map: DataFrame) -> DataFrame:
    """sheet_id, in_years: the unit of each sheet's term column, by its header, else by the words in its first rows, else by the middle of its numbers."""
    term = column_map.filter("field = 'termMonths'").select("sheet_id", F.col("header").alias("term"))
    cell = F.try_element_at("record", F.col("term"))
    own = records.filter(F.col("source_row") <= UNIT_ROWS).join(term, "sheet_id").select("sheet_id", "term", cell.alias("v"))
    years, months = F.col("v").rlike(r"(?i)\b(years?|yrs?)\b"), F.col("v").rlike(r"(?i)\b(months?|mos?|mths?)\b")
    n = F.when(~(F.coalesce(years, F.lit(False)) | F.coalesce(months, F.lit(False))), cells.to_number(F.col("v")))
    sums = own.groupBy("sheet_id", "term").agg(F.count_if(years).alias("y"), F.count_if(months & ~years).alias("m"), F.sort_array(F.collect_list(F.when(n > 0, n))).alias("ns"))
    middle = F.try_element_at("ns", F.floor(F.size("ns") / 2).cast("int") + 1)
    by_header = F.when(F.lower("term").rlike(r"\b(year|yr|yrs|years)\b"), F.lit(True)).when(F.lower("term").rlike(r"\b(month|mo|mos|months|mths)\b"), F.lit(False))
    by_cells = F.when(F.col("y") + F.col("m") > 0, F.col("y") > F.col("m")).otherwise(F.coalesce(middle <= 25, F.lit(False)))
    return sums.select("sheet_id", F.coalesce(by_header, by_cells).alias("in_years"))


def whole_months(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def normalize(records: DataFrame, column_map: DataFrame) -> DataFrame:
    """Typed deals of all sheets. One row of map a sheet is joined; the rest is a projection."""
    maps = column_map.groupBy("sheet_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "header"))).alias("headers"))
    own = records.join(maps, "sheet_id", "left").join(term_units(records, column_map), "sheet_id", "left")
    looked_up = [F.try_element_at("record", F.try_element_at("headers", F.lit(f))).alias(f"_{f}") for f in FIELDS]
    own = own.select("sheet_id", "source_row", "record", "in_years", *looked_up)

    def pick(field: str) -> Column:
        return F.col(f"_{field}")

    number = lambda f: cells.to_number(pick(f))
    deals = own.select(
        "sheet_id", F.col("source_row").cast("long").alias("source_row"),
        cells.to_text(pick("address")).alias("address"), cells.title_case_city(pick("city")).alias("city"), cells.normalize_state(pick("state")).alias("state"), cells.normalize_zip(pick("zip")).alias("zip"),
        cells.to_coordinate(pick("latitude"), 90).alias("lat"), cells.to_coordinate(pick("longitude"), 180).alias("lon"),
        cells.to_date(pick("leaseDate")).alias("lease_date"), cells.to_date(pick("executionDate")).alias("execution_date"), cells.to_date(pick("expirationDate")).alias("expiration_date"),
        cells.to_months(pick("termMonths"), F.coalesce("in_years", F.lit(False))).alias("term_months"), number("yearBuilt").alias("year_built"),
        cells.to_area(pick("areaLeased")).alias("area_leased"), cells.to_area(pick("officeArea")).alias("office_area"), number("baseRent").alias("base_rent"), number("effectiveRent").alias("effective_rent"),
        number("opex").alias("opex"), cells.to_free_rent_months(pick("freeRent")).alias("free_rent"), number("tiAllowance").alias("ti_allowance"),
        cells.confidentiality_text(pick("confidentiality")).alias("confidentiality"), *(cells.to_text(pick(f)).alias(c) for f, c in TEXT.items()), F.col("record").alias("raw"),
    )
    between = whole_months(F.col("lease_date"), F.col("expiration_date"))
    term = F.coalesce("term_months", F.when(between > 0, between.cast("double")))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    deals = deals.withColumns({
        "term_months": F.when((term > 0) & (term <= 1200), term),
        "year_built": F.when((F.col("year_built") > 1500) & (F.col("year_built") < 2200), F.col("year_built")),
        "base_rent_annual": cells.annualize(F.col("base_rent"), F.col("rate_type")),
        "opex_annual": cells.annualize(F.col("opex"), F.col("rate_type")),
        "lat": F.when(placed, F.col("lat")),
        "lon": F.when(placed, F.col("lon")),
    })
    # lat and lon were replaced together above, each by the pair as read.
    return deals.withColumns({
        "geo_source": F.when(F.col("lat").isNotNull(), F.lit("file")).otherwise(F.lit("none")),
        "geo_precision": F.when(F.col("lat").isNotNull(), F.lit("rooftop")).otherwise(F.lit("approximate")),
        "geo_error": F.lit(""), "place_id": F.lit(""),
        "address_key": cells.address_key(F.col("address"), F.col("city"), F.col("state"), F.col("zip"), F.col("property_name")),
    })
