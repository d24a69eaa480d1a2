"""Period slices. Bounds are one-row scalar subqueries on the data, so slices stay lazy and the
bound reaches the scan as a plain comparison on ``date``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.functions.calendar import (
    VIEWS, days_in_previous_month, month_key, shift, spine, start_of,
)
from shoptally.functions.columns import all_of


def anchor_row(df: DataFrame) -> DataFrame:
    """One row that describes the newest day of the data."""
    ends = df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))
    tail = F.col("max_date")
    return ends.select(
        F.date_format(tail, "MMMM").alias("this_month_name"),
        month_key(tail).alias("this_month_year"),
        days_in_previous_month(tail).alias("prev_month_count"),
        "min_date",
        "max_date",
    )


def _bound(df: DataFrame, made) -> Column:
    """Scalar ``made(newest day)``."""
    return df.agg(F.max("date").alias("tail")).select(made(F.col("tail")).alias("bound")).scalar()


def current(
    df: DataFrame,
    mode: str,
    *,
    x: int = 1,
    unit: str = "mo",
    head: bool = False,
    tail: bool = False,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Slice of ``df``: month_so_far, last_month_days, last_xy, all_time or custom.

    ``head`` snaps the start back to its period, ``tail`` drops the running period; neither
    applies to days. ``custom`` without bounds is the last seven days.
    """
    day = F.col("date")
    if mode == "month_so_far":
        keep = (day >= _bound(df, lambda t: F.trunc(t, "MM"))) & (
            day < _bound(df, lambda t: F.add_months(F.trunc(t, "MM"), 1))
        )
    elif mode == "last_month_days":
        keep = day > _bound(df, lambda t: F.date_sub(t, days_in_previous_month(t)))
    elif mode == "last_xy":
        if head and unit != "d":
            keep = day >= _bound(df, lambda t: start_of(shift(t, -x, unit), unit))
        else:
            keep = day > _bound(df, lambda t: shift(t, -x, unit))
        if tail and unit != "d":
            keep = keep & (day < _bound(df, lambda t: start_of(t, unit)))
    elif mode == "all_time":
        keep = day.isNotNull()
    elif mode == "custom":
        low = F.lit(start) if start else _bound(df, lambda t: F.date_sub(t, 6))
        high = F.lit(end) if end else _bound(df, lambda t: t)
        keep = day.between(low, high)
    else:
        raise ValueError(f"unknown period mode {mode!r}")
    return df.where(keep)


def bounds(cur: DataFrame) -> DataFrame:
    """One row: start of the previous period, the split, the end of the current one."""
    ends = cur.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = F.datediff("hi", "lo") + 1
    return ends.select(
        F.date_sub("lo", days).alias("prev_start"), F.col("lo").alias("split"),
        F.col("hi").alias("current_end"),
    )


def previous(df: DataFrame, cur: DataFrame) -> DataFrame:
    """Equally long stretch right before ``cur``, measured on the days ``cur`` holds."""
    b = bounds(cur)
    return df.where(
        (F.col("date") >= b.select("prev_start").scalar())
        & (F.col("date") < b.select("split").scalar())
    )


def where_dims(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Equality on each dimension; a value that starts with ``All`` and a blank is no filter."""
    return df.where(
        all_of(F.col(c) == v for c, v in wanted.items() if not v.startswith("All "))
    )


def choices(df: DataFrame, dims: list[str]) -> DataFrame:
    """Distinct non-null values per dimension, as rows (dim, choice)."""
    pairs = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("choice")) for d in dims
        ])).alias("p")
    ).select("p.*")
    return pairs.where(F.col("choice").isNotNull()).distinct()


def period_spine(cur: DataFrame, view: str = "1d") -> DataFrame:
    """One row per bucket between the first and last day of ``cur``."""
    ends = cur.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return ends.select(F.explode(spine(F.col("lo"), F.col("hi"), view)).alias("date"))


def bucket(df: DataFrame, cur: DataFrame, view: str, index: int) -> DataFrame:
    """Rows of ``df`` inside the ``index``-th bucket of ``cur``; the first if there is none."""
    unit = VIEWS[view]
    ends = cur.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    starts = ends.select(spine(F.col("lo"), F.col("hi"), view).alias("starts"))
    first = F.coalesce(F.get("starts", F.lit(index)), F.get("starts", F.lit(0)))
    return df.where(
        (F.col("date") >= starts.select(first.alias("b")).scalar())
        & (F.col("date") < starts.select(shift(first, 1, unit).alias("b")).scalar())
    )
