"""Daily and weekly event figures with a bound on late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "2 days"


def tumbling(events: DataFrame, view: str = "1d", lateness: str = LATENESS) -> DataFrame:
    """Count and value per event type and day, or Monday week. State is dropped once the
    watermark has passed a window."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    # windows are aligned to 1970-01-01, a Thursday: four days on is a Monday
    window = (
        F.window("ts", "1 day") if view == "1d" else F.window("ts", "7 days", "7 days", "4 days")
    )
    return (
        timed.groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
        .select(F.to_date("w.start").alias("period"), "event_type", "n", "value")
    )
