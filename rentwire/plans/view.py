"""The deals that the registered queries work on: a view over the star schema, by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "region", "part")
#: One deal a line of an order. source_row may repeat; queries break such ties by values.
DEALS = """
SELECT
  CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS source_row,
  c.c_name AS lessee, s.s_name AS lessor,
  CASE WHEN l.l_suppkey % 23 = 0 THEN '' ELSE n.n_name END AS city,
  r.r_name AS state,
  CASE WHEN l.l_partkey % 19 = 0 THEN '' ELSE l.l_returnflag END AS lease_type,
  CASE WHEN l.l_partkey % 29 = 0 THEN ' ' ELSE p.p_brand END AS property_subtype,
  p.p_type AS building_class, p.p_name AS property_name, c.c_mktsegment AS market,
  CASE WHEN l.l_orderkey % 6 = 0 THEN 'Confidential' WHEN l.l_orderkey % 6 = 1 THEN 'No' WHEN l.l_orderkey % 6 = 2 THEN 'Yes' WHEN l.l_orderkey % 6 = 3 THEN 'not restricted' ELSE '' END AS confidentiality,
  CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE CAST(l.l_shipdate AS DATE) END AS lease_date,
  CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS execution_date,
  CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE l.l_quantity * p.p_size * 10 END AS area_leased,
  CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE l.l_extendedprice / (l.l_quantity * 50) END AS base_rent,
  CASE WHEN l.l_linestatus = 'O' THEN 'Monthly $/SF' ELSE 'Annual $/SF' END AS rate_type,
  CASE WHEN l.l_suppkey % 13 = 0 THEN NULL WHEN l.l_linestatus = 'O' THEN l.l_extendedprice / (l.l_quantity * 50) * 12 ELSE l.l_extendedprice / (l.l_quantity * 50) END AS base_rent_annual,
  CAST(12 * l.l_linenumber AS DOUBLE) AS term_months,
  CASE WHEN l.l_partkey % 31 = 0 THEN NULL ELSE CAST(CAST(round(l.l_discount * 100) AS BIGINT) AS DOUBLE) END AS free_rent,
  CASE WHEN l.l_partkey % 37 = 0 THEN NULL ELSE CAST(CAST(round(l.l_tax * 1000) AS BIGINT) AS DOUBLE) END AS ti_allowance,
  CASE WHEN l.l_orderkey % 3 = 0 THEN NULL ELSE CAST(l.l_linenumber AS DOUBLE) END AS opex,
  CASE WHEN l.l_orderkey % 3 = 0 THEN NULL ELSE CAST(l.l_linenumber AS DOUBLE) END AS opex_annual,
  CASE WHEN l.l_orderkey % 4 = 0 THEN 'CPI' WHEN l.l_orderkey % 4 = 1 THEN '3%' ELSE '' END AS escalation_text,
  CASE WHEN l.l_partkey % 5 = 0 THEN NULL ELSE CAST(30000 + (l.l_suppkey * 37) % 2000 AS DOUBLE) / 1000 END AS lat,
  CASE WHEN l.l_partkey % 5 = 0 THEN NULL ELSE CAST(-97000 - (l.l_suppkey * 91) % 3000 AS DOUBLE) / 1000 END AS lon
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEALS.replace(" lineitem l", " {lineitem} l").replace("JOIN orders", "JOIN {orders}").replace("JOIN customer", "JOIN {customer}").replace("JOIN supplier", "JOIN {supplier}").replace("JOIN nation", "JOIN {nation}").replace("JOIN region", "JOIN {region}").replace("JOIN part", "JOIN {part}"), **{t: table(spark, sf_dir, t) for t in TABLES})


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Double columns rounded, as sums in another order differ in the last digits."""
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
