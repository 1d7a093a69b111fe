"""Delimited sheets: cells, header rows, header names, records, and the fixed export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rentwire.operators.tables import numbered

#: Rows looked at for a header, and rows after each that its consistency is judged by.
HEAD_ROWS, AFTER = 25, 5
#: Header and field of the export's columns, in order.
EXPORT = (
    ("Confidentiality", "confidentiality"), ("Signed Date", "execution_date"), ("Start Date", "lease_date"), ("Lease Term", "term_months"), ("End Date", "expiration_date"),
    ("Lease Transaction Type", "transaction_type"), ("Lease Type", "lease_type"), ("Tenant", "lessee"), ("Property Subtype", "property_subtype"), ("Property Class", "building_class"),
    ("Submarket", "submarket"), ("District", "district"), ("Property Name", "property_name"), ("Address", "address"), ("Floor", "floor"), ("Suite", "suite"), ("City", "city"),
    ("Area Leased", "area_leased"), ("Office Area (Deprecated)", "office_area"), ("Base Rent Yearly", "base_rent"), ("Rate Type", "rate_type"), ("OPEX (Yearly)", "opex"),
    ("Escalation Value", "escalation_value"), ("Escalation Percent", "escalation_percent"), ("Escalation Comments", "escalation_comments"), ("Free Rent Months", "free_rent"),
    ("TI Allowance", "ti_allowance"), ("TIs As-Is", "ti_as_is"), ("TI Notes", "ti_notes"), ("Other Concessions", "other_concessions"), ("Notes", "notes"), ("Tenant Agent(s)", "lessee_broker"),
    ("Tenant Representative", "lessee_broker_firm"), ("Listing Agent(s)", "lessor_broker"), ("Listing Representative", "lessor_broker_firm"), ("Sublessor", "sublessor"), ("Lessor", "lessor"),
    ("Tenant NAICS Code", "naics_code"), ("Year Built", "year_built"), ("Property Type", "property_type"), ("Market", "market"), ("State", "state"), ("Latitude", "lat"), ("Longitude", "lon"), ("Comp ID", "comp_id"),
)


def read_cells(spark: SparkSession, path: str, sep: str = ",", columns: int | None = None, encoding: str = "UTF-8", multi_line: bool = True) -> DataFrame:
    """sheet_id (the file), row_no (in file order), col_no, value: every cell as text; a quote in quotes is doubled.

    columns: of the widest sheet; None counts them in a pass of its own. A row with more is an error and never cut. With
    multi_line, quoted cells may hold line breaks and a file is one task (and, to be counted, one text of at most 2 GB);
    without, large files are split. A row number is its place in its file.
    """
    if columns is None:
        bare = F.regexp_replace("value", '"[^"]*+"', "")
        line = F.explode(F.split(bare, r"\r\n|\r|\n"))
        lines = spark.read.option("encoding", encoding).text(path, wholetext=multi_line).select(line.alias("value"))
        columns = 1 + int(lines.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))).alias("n")).first().n or 0)
    names = [f"c{k}" for k in range(columns)]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path, sep=sep, header=False, multiLine=multi_line, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", maxColumns=columns)
    rows = rows.select(F.col("_metadata.file_path").alias("sheet_id"), F.monotonically_increasing_id().alias("at"), F.array(*names).alias("cells"))
    first = rows.groupBy("sheet_id").agg(F.min("at").alias("first"))
    placed = rows.join(first, "sheet_id").select("sheet_id", (F.col("at") - F.col("first")).alias("row_no"), "cells")
    return as_cells(placed)


def as_cells(rows: DataFrame) -> DataFrame:
    """Long form of (sheet_id, row_no, cells)."""
    return rows.select("sheet_id", "row_no", F.posexplode("cells").alias("col_no", "value")).filter("value is not null and trim(value) <> ''")


def numeric(x: Column) -> Column:
    return x.rlike(r"^[\s$(+-]*[\d.,]+[\s%)]*$")


def header_rows(cells: DataFrame) -> DataFrame:
    """sheet_id, row_no, score: the header row of each sheet, the best of its first rows with at least two filled cells.

    Blank rows are not there, so places count filled rows. Rows are counted where they lie; of a sheet, only the first
    filled rows of each task meet.
    """
    filled = cells.groupBy("sheet_id", "row_no").agg(F.count("*").alias("filled"), F.avg((~numeric(F.col("value"))).cast("double")).alias("text_ratio"))
    rows = W.partitionBy("sheet_id").orderBy("row_no")  # a bounded number of rows a sheet
    placed = filled.withColumn("i", F.row_number().over(rows) - 1).filter(F.col("i") < HEAD_ROWS + AFTER)
    after = placed.withColumn("next", F.collect_list("filled").over(rows.rowsBetween(1, AFTER)))
    like = F.size(F.filter("next", lambda n: n >= F.greatest(F.lit(2.0), F.col("filled") * 0.4)))
    consistency = F.when(F.size("next") > 0, like / F.size("next")).otherwise(F.lit(0.0))
    score = F.col("filled") * 1.5 + F.col("text_ratio") * 20 + consistency * 25 - F.col("i") * 1.5
    scored = after.filter((F.col("i") < HEAD_ROWS) & (F.col("filled") >= 2)).withColumn("score", score)
    best = W.partitionBy("sheet_id").orderBy(F.desc("score"), "row_no")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("sheet_id", "row_no", "score")


def header_names(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet_id, col_no, header: white space collapsed, blanks numbered, repeats marked (2), (3) and so on."""
    own = cells.join(heads.select("sheet_id", F.col("row_no").alias("head")), "sheet_id")
    width = own.groupBy("sheet_id").agg(F.max("col_no").alias("last"))
    every = width.select("sheet_id", F.explode(F.sequence(F.lit(0), "last")).alias("col_no"))
    named = own.filter("row_no = head").select("sheet_id", "col_no", F.trim(F.regexp_replace("value", r"\s+", " ")).alias("name"))
    base = every.join(named, ["sheet_id", "col_no"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Column "), (F.col("col_no") + 1).cast("string"))))
    nth = F.row_number().over(W.partitionBy("sheet_id", "name").orderBy("col_no"))
    return base.withColumn("nth", nth).select("sheet_id", "col_no", F.when(F.col("nth") > 1, F.concat("name", F.lit(" ("), F.col("nth").cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("header"))


def records(cells: DataFrame, heads: DataFrame, names: DataFrame) -> DataFrame:
    """sheet_id, source_row (from 1), record (header to value) of the rows below the header row, as a written table."""
    below = cells.join(heads.select("sheet_id", F.col("row_no").alias("head")), "sheet_id").filter("row_no > head").join(names, ["sheet_id", "col_no"])
    rows = below.groupBy("sheet_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("header", "value"))).alias("record"))
    return numbered(rows, "sheet_id", "row_no", "source_row").select("sheet_id", F.col("source_row").cast("int").alias("source_row"), "record")


def sheet_errors(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """sheet_id, error: sheets without a row below their header."""
    last = cells.groupBy("sheet_id").agg(F.max("row_no").alias("last")).join(heads.select("sheet_id", "row_no"), "sheet_id", "left")
    return last.filter("row_no is null or last <= row_no").select("sheet_id", F.lit("no data rows").alias("error"))


def export_frame(deals: DataFrame) -> DataFrame:
    """The export's columns as text: dates ISO, coordinates with six decimals, whole numbers plain, nulls blank."""
    kinds = dict(deals.dtypes)

    def text(column: str) -> Column:
        c = F.col(column) if column in kinds else F.lit("")
        if kinds.get(column) == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif column in ("lat", "lon"):
            c = F.format_string("%.6f", c)
        elif kinds.get(column) == "double":
            c = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
        return F.coalesce(F.when(deals[column].isNotNull(), c) if column in kinds else c, F.lit(""))

    return deals.select(*(text(field).alias(header) for header, field in EXPORT))


def write_export(deals: DataFrame, path: str) -> None:
    export_frame(deals).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
