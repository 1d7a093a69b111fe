"""Incremental scan: items as they arrive, scored, each url once within the look-back, counted by category and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rentwire.functions import news
from rentwire.operators.items import Vocabulary, evaluate

LOOK_BACK = "24 hours"


def fresh(items: DataFrame, v: Vocabulary, look_back: str = LOOK_BACK) -> DataFrame:
    """Kept items of a stream, the first of each url key; items later than the look-back are dropped, and so is its state."""
    kept = evaluate(items, v).filter("drop_reason is null").withColumn("url_key", news.url_key(F.col("url")))
    return kept.withWatermark("published", look_back).dropDuplicatesWithinWatermark(["url_key"])


def hourly(kept: DataFrame) -> DataFrame:
    """hour, category, n: for append mode, an hour when the watermark has passed it."""
    return kept.groupBy(F.window("published", "1 hour").alias("w"), "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "category", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, appended as Parquet."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
