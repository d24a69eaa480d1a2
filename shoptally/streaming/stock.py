"""Stock balances kept up to date from ledger appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.rules import signed_quantity


def balances(appends: DataFrame) -> DataFrame:
    """Running stock per product; state holds one number per product."""
    signed = signed_quantity(F.col("type"), F.col("quantity"), unknown="zero")
    return appends.groupBy("product_id").agg(F.sum(signed).alias("stock"))
