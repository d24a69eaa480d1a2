"""Formula metrics over daily aggregates, by store or staff and by day, week or month.

A metric is data: which columns to aggregate per day and how, and a formula over the sums of
those daily figures. Formulas take and return ``Column``s, so they stay in the query plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.functions.calendar import VIEWS, axis_label, start_of
from shoptally.functions.columns import distinct_with_null, ratio, round_even, total
from shoptally.operators.periods import period_spine

DAILY: dict[str, Callable[[str], Column]] = {
    "sum": total,
    "mean": lambda c: F.avg(c),
    # traffic-like columns hold one value per day
    "first": lambda c: F.max(c),
    "n_unique": distinct_with_null,
}


@dataclass(frozen=True)
class Metric:
    daily: dict[str, str]
    formula: Callable[..., Column]
    digits: int = 0
    unit: str = "qty"
    group: str = "store_id"


# --- fixed values: the metric catalogue (columns, daily aggregates, formula, digits, unit) ---
STORE = {
    "average_ticket_value": Metric({"revenue": "sum", "invoice": "n_unique"}, ratio, 0, "VNĐ"),
    "units_per_ticket": Metric({"qty": "sum", "invoice": "n_unique"}, ratio, 2, "decimal"),
    "conversion_rate": Metric(
        {"invoice": "n_unique", "date_traffic": "first"}, ratio, 3, "pct"),
    "visitors_per_ticket": Metric(
        {"date_traffic": "first", "invoice": "n_unique"}, ratio, 2, "Visits"),
    "revenue_per_visitor": Metric({"revenue": "sum", "date_traffic": "first"}, ratio, 0, "VNĐ"),
    "average_selling_price": Metric({"revenue": "sum", "qty": "sum"}, ratio, 0, "VNĐ"),
    "devices_per_transaction": Metric(
        {"lot_number": "n_unique", "invoice": "n_unique"}, ratio, 2, "decimal"),
}
STAFF = {
    "staff_performance": Metric({"revenue": "sum"}, lambda r: r, 0, "VNĐ", "staff"),
    "staff_devices_sold": Metric({"lot_number": "n_unique"}, lambda n: n, 0, "Pcs", "staff"),
    "staff_transactions": Metric({"invoice": "n_unique"}, lambda n: n, 0, "Invoice", "staff"),
    "staff_attachment_rate": Metric(
        {"qty": "sum", "lot_number": "n_unique"},
        lambda qty, lots: ratio(qty - lots, lots), 3, "pct", "staff"),
    "staff_average_ticket_value": Metric(
        {"revenue": "sum", "invoice": "n_unique"}, ratio, 0, "VNĐ", "staff"),
    "staff_units_per_transaction": Metric(
        {"qty": "sum", "invoice": "n_unique"}, ratio, 2, "decimal", "staff"),
    "staff_revenue_per_unit": Metric(
        {"revenue": "sum", "qty": "sum"}, ratio, 0, "VNĐ", "staff"),
}
CATALOGUE = STORE | STAFF


def by_day(df: DataFrame, keys: list[str], daily: dict[str, str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[DAILY[how](c).alias(c) for c, how in daily.items()])


def by_group(df: DataFrame, metric: Metric, view: str) -> DataFrame:
    """Long form (period, label, grp, value). Daily figures are summed over the view first, then
    the formula is applied, so a weekly invoice count is the sum of the daily distinct counts."""
    days = by_day(df, ["date", metric.group], metric.daily)
    views = days.groupBy(
        start_of(F.col("date"), VIEWS[view]).alias("period"), F.col(metric.group).alias("grp")
    ).agg(*[total(c).alias(c) for c in metric.daily])
    value = metric.formula(*[F.col(c) for c in metric.daily]).cast("double")
    return views.where(F.col("grp").isNotNull()).select(
        "period",
        axis_label(F.col("period"), view).alias("label"),
        "grp",
        F.coalesce(round_even(value, metric.digits), F.lit(0.0)).alias("value"),
    )


def staff_view(view: str) -> str:
    """Staff charts have no daily view."""
    return "1w" if view == "1d" else view


def trend(df: DataFrame, view: str, daily: dict[str, str]) -> DataFrame:
    """Gap-free series over the days of ``df``: daily figures joined to the day spine, summed by
    view. Empty periods are 0."""
    days = by_day(df, ["date"], daily)
    filled = period_spine(df).join(days, "date", "left")
    series = filled.groupBy(start_of(F.col("date"), VIEWS[view]).alias("period")).agg(
        *[total(c).cast("double").alias(c) for c in daily]
    )
    return series.select("period", axis_label(F.col("period"), view).alias("label"), *daily)


REVENUE_TRAFFIC = {
    "revenue": "sum", "date_traffic": "first", "qty": "sum", "invoice": "n_unique",
}
PROMO_INVOICE = {"mkt_promo": "sum", "invoice": "n_unique"}
