"""Connected components of a table of links, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import cut, discard


def roots(links: DataFrame, scratch: list[str] | None = None) -> DataFrame:
    """node, root: for every node of ``links`` (x, y; longs, x differs from y) one node of its component, the same for all of it.

    Hooks every node to its smallest neighbour below it, shortens the chains to stars by doubling, and repeats on the
    links between the stars that are left. Each round at least halves the number of stars that have links.
    scratch: gets the path of the result's table; the tables of the steps go at the end.
    """
    made: list[str] = []
    edges = cut(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), made)
    label = None
    while True:
        parents = edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("root"))
        parents = cut(parents.unionByName(edges.select(F.col("x").alias("node"), F.col("x").alias("root")).distinct().join(parents.select("node"), "node", "left_anti")), made)
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            higher = cut(parents.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), made)
            parents = higher.select("node", "root")
            if higher.filter("moved").isEmpty():
                break
        label = parents if label is None else cut(label.withColumnRenamed("root", "at").join(parents.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("root", "at").alias("root")), made)
        of_x, of_y = (parents.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "xy")
        between = edges.join(of_x, "x").join(of_y, "y").filter("rx <> ry")
        edges = cut(between.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), made)
        if edges.isEmpty():
            label = cut(label, scratch)
            discard(links.sparkSession, made)
            return label
