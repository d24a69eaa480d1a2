"""KPI cards: daily base aggregates, summed over the slice, against the previous slice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import humanise, ratio, round_even, total
from shoptally.operators import periods
from shoptally.session import use_checkpoints

CARDS = ("Revenue", "Transaction", "Conversion", "UPT", "ATV", "Traffic", "Unit", "Device")


def daily(df: DataFrame) -> DataFrame:
    """Per day: revenue, quantity, invoices, traffic and devices. NULL ids are not counted."""
    return df.groupBy("date").agg(
        total("revenue").alias("revenue"),
        total("qty").alias("qty"),
        F.count_distinct("invoice").alias("invoices"),
        F.coalesce(F.max("date_traffic"), F.lit(0)).alias("traffic"),
        F.count_distinct("lot_number").alias("lots"),
    )


def totals(days: DataFrame) -> DataFrame:
    """One row with the number of days and the eight cards of a slice, from its daily figures."""
    sums = days.agg(
        *[total(c).alias(c) for c in ("revenue", "qty", "invoices", "traffic", "lots")],
        F.count("*").alias("n_days"),
    )
    c = F.col
    values = {
        "Revenue": c("revenue").cast("double"),
        "Transaction": c("invoices").cast("double"),
        "Conversion": ratio(c("invoices"), c("traffic")),
        "UPT": ratio(c("qty"), c("invoices")),
        "ATV": ratio(c("revenue"), c("invoices")),
        "Traffic": c("traffic").cast("double"),
        "Unit": c("qty").cast("double"),
        "Device": c("lots").cast("double"),
    }
    return sums.select("n_days", *[v.alias(k) for k, v in values.items()])


def _long(one_row: DataFrame, value: str) -> DataFrame:
    cards = [F.struct(F.lit(k).alias("metric"), F.col(k).alias(value)) for k in CARDS]
    return one_row.select(F.col("n_days").alias(f"{value}_days"), F.explode(F.array(*cards)).alias(
        "c")).select(f"{value}_days", "c.*")


def cards(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Cards of two slices of the facts; see ``cards_of_days``."""
    return cards_of_days(daily(cur), daily(prev))


def period_cards(facts: DataFrame, mode: str, **period) -> DataFrame:
    """Cards of a period of ``facts`` against the stretch before it, in two reads: one of the dates
    alone, which sets the bounds, and one of the days between them."""
    use_checkpoints(facts.sparkSession)
    dates = facts.select("date").distinct().checkpoint()
    bounds = periods.bounds(periods.current(dates, mode, **period)).checkpoint()
    first, split, last = (bounds.select(c).scalar() for c in ("prev_start", "split", "current_end"))
    day = F.col("date")
    days = daily(facts.where((day >= first) & (day <= last))).checkpoint()
    return cards_of_days(days.where(day >= split), days.where(day < split))


def cards_of_days(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """(metric, curr, prev, delta_pct, shown): delta is 0 where the previous value is 0 or
    missing, and NULL if there is no previous data at all."""
    both = _long(totals(cur), "curr").join(_long(totals(prev), "prev"), "metric")
    change = (F.col("curr") / F.nullif("prev", F.lit(0.0)) - 1) * F.lit(100.0)
    return both.select(
        "metric",
        "curr",
        "prev",
        F.when(F.col("prev_days") > 0, F.coalesce(round_even(change, 1), F.lit(0.0))).alias("delta_pct"),
        F.when(F.col("metric") == "Conversion", humanise(F.col("curr"), pct=True))
        .otherwise(humanise(F.col("curr"))).alias("shown"),
    )


def slice_facts(df: DataFrame) -> DataFrame:
    """Number of days with data and the last of them."""
    return df.agg(F.count_distinct("date").alias("n_days"), F.max("date").alias("last_date"))
