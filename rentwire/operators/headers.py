"""Matching sheet headers to fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

LEAST_SCORE = 340
#: Words that drive no match on their own.
NOISE = "the of a in per is and or for to usd yr year yearly annual annually mo month monthly psf sf sqft amt amount value no num number id".split()
#: Default fields: (field, required, synonyms best first, words that rule it out). A fuller table is a parameter of score().
FIELDS = (
    ("propertyName", False, ("property name", "building name"), ()),
    ("address", True, ("street address", "property address", "address", "street"), ("email", "ip address", "web")),
    ("city", False, ("city", "town", "municipality"), ()),
    ("state", False, ("state", "province"), ("status", "real estate")),
    ("zip", False, ("zip code", "zip", "postal code"), ()),
    ("county", False, ("county", "parish"), ()),
    ("market", False, ("market", "metro"), ("sub",)),
    ("submarket", False, ("submarket", "sub market"), ()),
    ("district", False, ("district", "neighborhood"), ()),
    ("latitude", False, ("latitude", "lat"), ()),
    ("longitude", False, ("longitude", "lon", "lng"), ()),
    ("propertyType", False, ("property type",), ("subtype",)),
    ("propertySubtype", False, ("property subtype", "subtype"), ()),
    ("buildingClass", False, ("property class", "building class", "class"), ()),
    ("yearBuilt", False, ("year built", "built"), ()),
    ("leaseDate", False, ("start date", "commencement date", "lease date", "commencement"), ("end", "expir", "signed")),
    ("executionDate", False, ("signed date", "execution date", "date signed"), ()),
    ("expirationDate", False, ("end date", "expiration date", "expiry"), ()),
    ("termMonths", False, ("lease term", "term months", "term"), ("date", "type")),
    ("leaseType", False, ("lease type",), ("transaction",)),
    ("rateType", False, ("rate type", "rent type"), ()),
    ("transactionType", False, ("lease transaction type", "transaction type"), ()),
    ("suite", False, ("suite", "unit"), ()),
    ("floor", False, ("floor", "floors"), ()),
    ("areaLeased", True, ("area leased", "leased area", "square feet", "size", "rsf"), ("office area", "rent", "rate")),
    ("officeArea", False, ("office area", "office area deprecated"), ()),
    ("baseRent", True, ("base rent yearly", "base rent", "starting rent", "rent", "rate"), ("type", "free", "effective", "escal")),
    ("effectiveRent", False, ("effective rent", "net effective rent"), ()),
    ("opex", False, ("opex yearly", "opex", "operating expenses"), ()),
    ("escalation", False, ("escalations", "escalation", "annual increase"), ("type", "percent", "value", "comment")),
    ("escalationType", False, ("escalation type",), ()),
    ("escalationPercent", False, ("escalation percent",), ()),
    ("escalationValue", False, ("escalation value", "escalation amount"), ()),
    ("escalationComments", False, ("escalation comments", "escalation notes"), ()),
    ("freeRent", False, ("free rent months", "free rent", "abatement"), ()),
    ("tiAllowance", False, ("ti allowance", "tenant improvements", "ti"), ("notes", "as is")),
    ("tiAsIs", False, ("tis as is", "ti as is", "as is"), ()),
    ("tiNotes", False, ("ti notes", "ti comments"), ()),
    ("otherConcessions", False, ("other concessions", "concessions"), ()),
    ("lessor", False, ("lessor", "landlord", "owner"), ("sub", "agent", "rep")),
    ("sublessor", False, ("sublessor", "sublandlord"), ()),
    ("lessee", False, ("tenant", "lessee"), ("agent", "rep", "naics", "improve")),
    ("lessorBroker", False, ("listing agent s", "listing agent", "landlord agent"), ()),
    ("lessorBrokerFirm", False, ("listing representative", "landlord representative", "listing firm"), ()),
    ("lesseeBroker", False, ("tenant agent s", "tenant agent"), ()),
    ("lesseeBrokerFirm", False, ("tenant representative", "tenant rep firm"), ()),
    ("brokers", False, ("brokers", "broker"), ()),
    ("naicsCode", False, ("tenant naics code", "naics code", "naics"), ()),
    ("notes", False, ("notes", "comments", "remarks"), ("ti", "escal")),
    ("compId", False, ("comp id", "record id"), ()),
    ("confidentiality", False, ("confidentiality", "confidential"), ()),
)


#: Fields whose column of deals is not their own name in snake case.
OF_COLUMN = {"lat": "latitude", "lon": "longitude"}


def camel(column: str) -> str:
    first, *rest = column.split("_")
    return first + "".join(x.capitalize() for x in rest)


def normalize_header(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[‘’“”]", ""), "[^a-z0-9]+", " "))


def field_table(spark: SparkSession, fields=FIELDS) -> DataFrame:
    """field, field_no, required, syn_rank, synonym, avoid: a row for each synonym of a small fixed table."""
    rows = [(f, k, required, i, s, list(avoid)) for k, (f, required, synonyms, avoid) in enumerate(fields) for i, s in enumerate(synonyms)]
    return spark.createDataFrame(rows, "field string, field_no int, required boolean, syn_rank int, synonym string, avoid array<string>")


def score(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """The columns of ``headers`` (header) with field, field_no and score (whole, 0 and up).

    ``fields`` is code, not data, so it is broadcast.
    """
    h, s = F.col("norm"), F.col("synonym")
    squashed_h, squashed_s = F.replace(h, F.lit(" "), F.lit("")), F.replace(s, F.lit(" "), F.lit(""))
    h_tokens, s_tokens = F.split(h, " "), F.split(s, " ")
    meaning = F.filter(s_tokens, lambda t: ~t.isin(NOISE))
    rank = F.col("syn_rank")
    phrase = F.concat(F.lit(" "), h, F.lit(" ")).contains(F.concat(F.lit(" "), s, F.lit(" ")))
    loose = (
        F.when(phrase, 600 + F.size(s_tokens) * 25 + F.size(s_tokens) / F.size(h_tokens) * 100 - rank * 4)
        .when((F.length(squashed_s) >= 4) & squashed_h.contains(squashed_s), 420 + F.length(squashed_s) / F.length(squashed_h) * 120 - rank * 4)
        .when((F.size(meaning) >= 2) & (F.size(F.array_except(meaning, h_tokens)) == 0), 380 + F.size(meaning) * 20 - rank * 4)
        .otherwise(F.lit(0))
    )
    exact = F.when((s == h) | (squashed_s == squashed_h), 1000 - rank * 5)
    ruled_out = F.exists("avoid", lambda a: h.contains(a))
    own = headers.columns
    pairs = headers.withColumn("norm", normalize_header(F.col("header"))).crossJoin(F.broadcast(fields)).withColumn("exact", exact).withColumn("loose", F.when(ruled_out, F.lit(0)).otherwise(loose))
    best = pairs.filter("norm <> ''").groupBy(*own, "field", "field_no").agg(F.max("exact").alias("exact"), F.max("loose").alias("loose"))
    return best.select(*own, "field", "field_no", F.coalesce("exact", F.floor(F.greatest("loose", F.lit(0)) + 0.5)).cast("int").alias("score"))


def assign(scored: DataFrame) -> DataFrame:
    """sheet_id, field, header, score: pairs by falling score, each field and header used once.

    Ties go to the header first by name without case, then to the first field. A sheet has a few thousand pairs at most.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(folded=pdf.header.str.lower()).sort_values(["score", "folded", "header", "field_no"], ascending=[False, True, True, True], kind="stable")
        fields, headers, rows = set(), set(), []
        for r in pdf.itertuples():
            if r.field not in fields and r.header not in headers:
                fields.add(r.field)
                headers.add(r.header)
                rows.append((r.sheet_id, r.field, r.header, r.score))
        return pd.DataFrame(rows, columns=["sheet_id", "field", "header", "score"])

    return scored.filter(F.col("score") >= LEAST_SCORE).groupBy("sheet_id").applyInPandas(greedy, "sheet_id string, field string, header string, score int")


def missing_required(sheets: DataFrame, column_map: DataFrame, fields: DataFrame) -> DataFrame:
    """sheet_id, field: required fields that a sheet has no header for."""
    need = fields.filter("required").select("field").distinct()
    return sheets.select("sheet_id").distinct().crossJoin(F.broadcast(need)).join(column_map, ["sheet_id", "field"], "left_anti")


def unused_headers(headers: DataFrame, column_map: DataFrame) -> DataFrame:
    return headers.select("sheet_id", "header").join(column_map, ["sheet_id", "header"], "left_anti")


def previews(records: DataFrame) -> DataFrame:
    """sheet_id, header, preview: the first three values that are not blank, each cut at 28 characters."""
    cells = records.select("sheet_id", "source_row", F.explode("record").alias("header", "value")).filter("trim(value) <> ''")
    nth = W.partitionBy("sheet_id", "header").orderBy("source_row")
    first = cells.withColumn("nth", F.row_number().over(nth)).filter("nth <= 3")
    short = F.when(F.length(F.trim("value")) > 28, F.concat(F.substring(F.trim("value"), 1, 27), F.lit("…"))).otherwise(F.trim("value"))
    return first.groupBy("sheet_id", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", short.alias("v")))), lambda x: x["v"]), ", ").alias("preview"))
