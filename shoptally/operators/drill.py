"""Drill-through on one bucket of a chart: regroup by any dimensions, filter by one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import distinct_with_null, total

DIMENSIONS = ("date", "invoice", "staff", "cat", "sku")


def regroup(df: DataFrame, keys: list[str]) -> DataFrame:
    """Group by any of the five dimensions; figures that are keys themselves are left out."""
    unknown = set(keys) - set(DIMENSIONS)
    if unknown or not keys:
        raise ValueError(f"group by one or more of {DIMENSIONS}")
    figures = {
        "invoice": distinct_with_null("invoice"),
        "qty": total("qty"),
        "revenue": total("revenue"),
        "date_traffic": F.max("date_traffic"),
    }
    return df.groupBy(*keys).agg(*[v.alias(k) for k, v in figures.items() if k not in keys])


def only(df: DataFrame, dim: str = "All", value=None) -> DataFrame:
    """Rows with ``value`` in ``dim``; ``All`` keeps every row."""
    if dim == "All" or value == "All":
        return df
    return df.where(F.col(dim) == value)


def grand_totals(df: DataFrame) -> DataFrame:
    return df.agg(total("qty").alias("total_qty"), total("revenue").alias("total_revenue"))
