"""Extension: yearly topic counts kept by Structured Streaming as deliveries arrive, feeding the growth metrics.

The batch operators have no stream; this is an addition of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def yearly_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """(phase, topic, year, n): records by topic and year, each delivery of a uid counted once within the watermark."""
    seen = stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["uid"])
    return seen.filter("topic >= 0 AND year IS NOT NULL").groupBy("phase", "topic", "year").agg(F.count(F.lit(1)).alias("n"))


def deliveries_per_window(stream: DataFrame, length: str = "7 days", late: str = "14 days") -> DataFrame:
    """(start, topic, n): deliveries per tumbling window of arrival; late ones are counted until the watermark passes."""
    w = stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", length), "topic").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "topic", "n")
