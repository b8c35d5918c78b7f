"""Click counts kept up to date from a stream of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def click_counts(clicks: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """start, item_id, clicks per window of a stream (item_id, ``time``); clicks that come later than ``late`` are dropped
    by the watermark, which also bounds the state."""
    return clicks.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "item_id").agg(F.count("*").alias("clicks")).select(F.col("w.start").alias("start"), "item_id", "clicks")
