"""Wide form of a grouped metric: one row per period of the spine, one column per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.calendar import axis_label
from shoptally.operators.periods import period_spine


def wide(long: DataFrame, cur: DataFrame, view: str, groups: list[str]) -> DataFrame:
    """Periods without a row for a group are 0. ``groups`` become columns in the order given: a
    chart's choice, or a short dimension table's keys. The long form serves many groups."""
    cells = long.groupBy("period").pivot("grp", groups).agg(F.first("value"))
    spine = period_spine(cur, view).withColumnRenamed("date", "period")
    filled = spine.join(cells, "period", "left").orderBy("period")
    return filled.select(
        "period",
        axis_label(F.col("period"), view).alias("label"),
        *[F.coalesce(F.col(f"`{g}`"), F.lit(0.0)).alias(g) for g in groups],
    )
