"""Exact medians of groups of any size, without holding a group's values anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import cut, discard

#: A group's values are cut into about so many ranges in each round, by a sketch whose relative rank error is one over ACCURACY.
RANGES, ACCURACY = 64, 1_000
#: So many values at most are sorted.
MOST = 10_000


def medians(df: DataFrame, by: list[str], columns: dict[str, Column], scratch: list[str] | None = None) -> DataFrame:
    """by …, and for each of ``columns`` its exact median (a double; the mean of the two middle values, null without values): a row for each group.

    Each round cuts what is left of a group's values into ranges of about equal counts, counts the ranges exactly, and goes on with the
    one range that holds the middle, about a sixty-fourth of the values whatever their distribution. A value that fills a
    range of its own ends the search; MOST values or fewer are sorted. No task holds more of a group than a sketch of bounded
    size or MOST values, and all groups and columns go through a round at once. NaN counts as no value. Without ``by`` the
    whole is one group, which an empty table has too. scratch: gets the path of the result's table.
    """
    spark, made = df.sparkSession, []
    each = F.array(*(F.struct(F.lit(k).alias("at"), v.cast("double").alias("v")) for k, v in enumerate(columns.values())))
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
    read = cut(df.select(group.alias("g"), F.inline(each)).select("g", "at", "v", F.xxhash64("g", "at").alias("h")), made)  # the input is read once
    values = read.filter("v is not null and not isnan(v)").select(F.struct("g", "at").alias("k"), "h", "v")
    asked = cut(values.groupBy("k", "h").agg(F.count("*").alias("n")).select("k", "h", "n", F.floor((F.col("n") - 1) / 2).alias("low"), F.floor(F.col("n") / 2).alias("high")), made)
    same = (F.col("h") == F.col("h_")) & F.col("k").eqNullSafe(F.col("k_"))
    renamed = lambda t: t.withColumnsRenamed({"k": "k_", "h": "h_"})
    done: list[DataFrame] = []
    while not asked.isEmpty():
        few = asked.filter(F.col("n") <= MOST)
        sorted_ = values.join(renamed(few), same).groupBy("k", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        done.append(cut(sorted_.select("k", ((F.get("vs", F.col("low").cast("int")) + F.get("vs", F.col("high").cast("int"))) / 2).alias("median")), made))
        many = asked.filter(F.col("n") > MOST)
        if many.isEmpty():
            break
        values = cut(values.join(renamed(many), same).select("k", "h", "v"), made)
        edges = cut(values.groupBy("k", "h").agg(F.percentile_approx("v", F.array(*(F.lit(x / RANGES) for x in range(1, RANGES))), ACCURACY).alias("edges")), made)
        # an edge is a range of its own, so that a value that comes often is told from its neighbours
        place = 2 * F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.array_contains("edges", F.col("v")).cast("int")
        placed = values.join(renamed(edges), same).withColumn("place", place)
        ranges = cut(placed.groupBy("k", "h", "place").agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most")), made)  # 2 RANGES rows a group at most
        before = F.coalesce(F.sum("m").over(W.partitionBy("k", "h").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranges.withColumn("before", before).join(renamed(many), same)
        holds = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("before") + F.col("m"))
        middle = cut(ranked.filter(holds("low") | holds("high")).select("k", "h", "place", "m", "least", "most", "before", "low", "high", (holds("low") & holds("high") & (F.col("least") < F.col("most"))).alias("open")), made)
        ends = middle.filter("not open").groupBy("k").agg(((F.max(F.when(holds("low"), F.col("most"))) + F.max(F.when(holds("high"), F.col("least")))) / 2).alias("median"))
        done.append(ends)
        left = middle.filter("open").select("k", "h", "place", "least", "most", F.col("m").alias("n"), (F.col("low") - F.col("before")).alias("low"), (F.col("high") - F.col("before")).alias("high"))
        asked = cut(left.select("k", "h", "n", "low", "high"), made)
        values = cut(values.join(renamed(left.select("k", "h", "least", "most")), same).filter(F.col("v").between(F.col("least"), F.col("most"))).select("k", "h", "v"), made)
    none = read.select(F.struct("g", "at").alias("k"), F.col("v").alias("median")).limit(0)
    found = reduce(DataFrame.unionByName, done, none).select("k.g", "k.at", "median")
    one = [F.max(F.when(F.col("at") == k, F.col("median"))).alias(name) for k, name in enumerate(columns)]
    every = read.select("g").distinct().withColumns({"at": F.lit(-1), "median": F.lit(None).cast("double")})
    if not by:
        every = spark.range(1).select(F.struct(F.lit(0).alias("_")).alias("g"), F.lit(-1).alias("at"), F.lit(None).cast("double").alias("median"))
    whole = every.unionByName(found).groupBy("g").agg(*(x.alias(f"m{k}") for k, x in enumerate(one)))
    out = cut(whole.select(*(F.col(f"g.`{c}`").alias(c) for c in by), *(F.col(f"m{k}").alias(name) for k, name in enumerate(columns))), scratch)
    discard(spark, made)
    return out
