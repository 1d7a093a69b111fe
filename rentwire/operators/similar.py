"""Similarity join of token sets: all pairs of a Jaccard likeness, with posting lists that stay short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .tables import cut

#: A posting list of more sets than this doesn't meet itself: its sets are listed under one more token instead.
MOST = 256


def _least(n: Column, share: float) -> Column:
    """Tokens that a set of n has in common with any like one, at least."""
    return F.ceil(n * share - 1e-9).cast("int")


def pairs(sets: DataFrame, share: float, made: list[str], most: int = MOST) -> DataFrame:
    """x, y: the ids of all sets with the same ``room`` and another ``owner`` whose tokens have a Jaccard likeness of ``share`` or more, x < y.

    sets: id (a long, each once in a room), owner (long), room (string), ts (distinct tokens, in one order for all, rare ones first).
    Like sets share their first common token within a prefix of each, and their first k common tokens within slightly longer
    ones. Sets are listed under the tokens of their prefix; where a list grows over ``most`` sets, those are listed under pairs of
    tokens, then triples and so on. A list that can't grow, as its sets have no more tokens that they need to share, is dealt over
    tasks: a part of ``most`` sets of it meets the whole. Positions in the sets and parities of hashed tokens drop most of the pairs
    that are not like; the rest is compared as a whole.
    """
    parity = F.expr("aggregate(ts, 0L, (a, t) -> a ^ shiftleft(1L, cast(pmod(xxhash64(t), 64) as int)))")
    base = cut(sets.select("id", "owner", "room", "ts", F.size("ts").alias("n"), parity.alias("parity")).filter("n > 0"), made)
    found: list[DataFrame] = []

    def meet(left: DataFrame, right: DataFrame, on: list[str], level: int) -> None:
        a = left.select(*on, *(F.col(c).alias(f"{c}_x") for c in ("id", "owner", "n", "at", "parity")))
        b = right.select(*on, *(F.col(c).alias(f"{c}_y") for c in ("id", "owner", "n", "at", "parity")))
        both = F.col("n_x") + F.col("n_y")
        overlap = F.ceil(both * (share / (1 + share)) - 1e-9)
        sizes = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * share - 1e-9
        places = level + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) - 1 >= overlap
        parities = F.bit_count(F.col("parity_x").bitwiseXOR(F.col("parity_y"))) <= both - 2 * overlap
        found.append(a.join(b, on).filter((F.col("id_x") < F.col("id_y")) & (F.col("owner_x") != F.col("owner_y")) & sizes & places & parities).select("id_x", "id_y"))

    prefix = F.slice("ts", F.lit(1), F.col("n") - _least(F.col("n"), share) + 1)
    rows = base.select("id", "owner", "room", "n", "parity", F.posexplode(prefix).alias("at", "t")).select("id", "owner", "n", "parity", "at", F.xxhash64("room", "t").alias("key"))
    level = 1
    while True:
        heavy = cut(rows.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > most), made)
        if heavy.isEmpty():
            meet(rows, rows, ["key"], level)
            break
        light = rows.join(heavy, "key", "left_anti")
        meet(light, light, ["key"], level)
        full = cut(rows.join(heavy, "key"), made)
        stuck = full.filter(_least(F.col("n"), share) <= level)
        parts = F.ceil(F.col("many") / most).cast("int")
        dealt = stuck.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        meet(dealt, stuck.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["key", "part"], level)
        last = F.least(F.col("n"), F.col("n") - _least(F.col("n"), share) + level + 1)  # tokens of the longer prefix
        longer = full.filter((F.col("n") > F.col("at") + 1) & (last > F.col("at") + 1)).join(base.select("id", "room", "ts"), "id")
        rows = longer.select("id", "owner", "n", "parity", "key", "at", F.posexplode(F.slice("ts", F.col("at") + 2, last - F.col("at") - 1)).alias("more", "t"))
        rows = cut(rows.select("id", "owner", "n", "parity", (F.col("at") + F.col("more") + 1).alias("at"), F.xxhash64("key", "t").alias("key")), made)
        level += 1
    met = found[0]
    for more in found[1:]:
        met = met.unionByName(more)
    sides = [base.select(F.col("id").alias(f"id_{s}"), F.col("room").alias(f"room_{s}"), F.col("ts").alias(f"ts_{s}")) for s in "xy"]
    common = F.size(F.array_intersect("ts_x", "ts_y"))
    whole = met.distinct().join(sides[0], "id_x").join(sides[1], "id_y").filter((F.col("room_x") == F.col("room_y")) & (common >= share * (F.size("ts_x") + F.size("ts_y") - common)))
    return whole.select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()
