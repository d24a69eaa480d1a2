"""Day, week (Monday) and month buckets, offsets and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# unit -> name understood by trunc; a day needs no truncation
_TRUNC = {"w": "week", "mo": "month"}
VIEWS = {"1d": "d", "1w": "w", "1mo": "mo"}


def start_of(day: Column, unit: str) -> Column:
    return day if unit == "d" else F.trunc(day, _TRUNC[unit])


def shift(day: Column, n: int, unit: str) -> Column:
    """``n`` units later (earlier when negative); month ends are clamped."""
    if unit == "mo":
        return F.add_months(day, n)
    return F.date_add(day, n * (7 if unit == "w" else 1))


def days_in_previous_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(F.add_months(day, -1)))


def week_label(day: Column) -> Column:
    """Two-digit calendar year, ISO week and its Monday: ``24-W9 (26 Feb)``."""
    return F.concat(
        F.date_format(day, "yy"),
        F.lit("-W"),
        F.weekofyear(day).cast("string"),
        F.date_format(F.trunc(day, "week"), " (dd MMM)"),
    )


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def axis_label(day: Column, view: str) -> Column:
    if view == "1w":
        return week_label(day)
    return F.date_format(day, "EEE dd\nMMM" if view == "1d" else "MMM yyyy")


def spine(first: Column, last: Column, view: str = "1d") -> Column:
    """Array of bucket starts that cover ``first`` to ``last``."""
    step = {"1d": "interval 1 day", "1w": "interval 7 days", "1mo": "interval 1 month"}[view]
    unit = VIEWS[view]
    return F.sequence(start_of(first, unit), start_of(last, unit), F.expr(step))
