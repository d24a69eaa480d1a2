"""An upload applied in order: products first, stock movements only if that went through."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.operators import ledger, upload, upsert
from shoptally.session import use_checkpoints


@dataclass(frozen=True)
class Applied:
    """What to write, and why. ``outcome`` is one row: needed, status, moves, applied."""

    products: DataFrame
    prices_before: DataFrame
    prices: DataFrame
    moves: DataFrame
    conflicts: DataFrame
    outcome: DataFrame


def apply(rows: DataFrame, product: DataFrame, price: DataFrame, stock_ledger: DataFrame,
          inventory: DataFrame) -> Applied:
    """``rows`` passed the guard. Products are touched only if an id or a price is new; movements
    follow if they are not, or if every product and price of the upload was inserted."""
    # both feed half a dozen counts and checks: written once, read from there
    use_checkpoints(rows.sparkSession)
    products = upload.checked_products(upload.consolidate(rows)).checkpoint()
    moves = upload.ledger_rows(rows).checkpoint()
    changes = upload.new_ids(products, inventory).select("id").unionByName(
        upload.new_prices(products, inventory).select("id"))
    needed = changes.agg((F.count("*") > 0).alias("needed")).scalar()
    fresh, retired, added, report = upsert.products(products, product, price)
    status = report.select("status").scalar()
    booked, conflicts = ledger.admit(moves, stock_ledger)
    booked = booked.where(~needed | (status == "success"))
    applied = booked.agg(F.count("*").alias("n")).scalar()
    outcome = moves.agg(F.count("*").alias("moves")).select(
        needed.alias("needed"), F.when(needed, status).otherwise("not needed").alias("status"),
        "moves", applied.alias("applied"))
    return Applied(fresh.where(needed), retired, added.where(needed), booked, conflicts, outcome)
