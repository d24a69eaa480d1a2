"""Ledger batches: row validity, stock and serial checks, all-or-nothing booking, cancellation.

Checks are flags on rows; the all-or-nothing decision is a one-row scalar subquery over them.
Rows of a batch are judged one by one against the stock before the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import join_key
from shoptally.functions.rules import signed_quantity
from shoptally.functions.running import running
from shoptally.operators.inventory import serial_balance, serial_modes
from shoptally.session import use_checkpoints


def validity(batch: DataFrame) -> DataFrame:
    """Adds ``problem``: the first rule a row breaks, NULL for a valid row."""
    modes = serial_modes(batch).select("product_id", "mixed")
    rows = batch if "order_id" in batch.columns else batch.withColumn(
        "order_id", F.lit(None).cast("bigint"))
    kind, c = F.col("type"), F.col
    problem = (
        F.when(c("product_id").isNull() | kind.isNull() | c("quantity").isNull(), "missing value")
        .when(~kind.isin(*K.MANUAL_TYPES), "type")
        .when(c("quantity") <= 0, "quantity")
        .when(c("order_id").isNotNull(), "order id")
        .when(c("serial").isNotNull() & (c("quantity") != 1), "serial quantity")
        .when(F.coalesce("mixed", F.lit(False)), "mixed serials")
    )
    return rows.join(modes, "product_id", "left").withColumn("problem", problem).drop("mixed")


def no_problem(checked: DataFrame) -> Column:
    """Scalar: is every row of the batch valid?"""
    return checked.agg(
        F.coalesce(F.every(F.col("problem").isNull()), F.lit(True)).alias("ok")).scalar()


def judge(batch: DataFrame, ledger: DataFrame, cumulative: str | None = None) -> DataFrame:
    """Adds stock_ok, serial_ok, cap_ok and accepted to the batch rows.

    The ledger is cut to the batch's products and summed to one row per (product, serial)
    before any join with the batch.
    """
    concerned = ledger.join(batch.select("product_id").distinct(), "product_id", "left_semi")
    return judge_held(batch, serial_balance(concerned), cumulative)


def judge_held(batch: DataFrame, held: DataFrame, cumulative: str | None = None) -> DataFrame:
    """``judge`` against known stock, one row per (product, serial) of the batch's products.

    What is known is gathered per (product, serial) of the batch first, so its rows, with all their
    columns, are moved once. Rows are judged one by one. With ``cumulative``, a unique column that orders the batch, stock is
    what the rows before it in the batch leave; a hot product's rows are spread over tasks.
    """
    rows = batch.withColumn("serial", F.nullif("serial", F.lit(""))).withColumn(
        "signed", signed_quantity(F.col("type"), F.col("quantity")))
    by_row = held.select(F.col("product_id").alias("p"), F.col("serial").alias("s"), "stock")
    loose = held.groupBy("product_id").agg(
        F.bool_or(F.col("serial").isNull()).alias("had_loose"))
    by_serial = held.where(F.col("serial").isNotNull()).groupBy(F.col("serial").alias("sn")).agg(
        F.sum("stock").alias("serial_stock"))
    known = (
        rows.select("product_id", "serial").distinct()
        .join(by_row, (F.col("product_id") == F.col("p")) & F.col("serial").eqNullSafe(
            F.col("s")), "left").drop("p", "s")
        .join(loose, "product_id", "left")
        .join(by_serial, join_key("serial", "product_id") == F.col("sn"), "left")
        .select(F.col("product_id").alias("p"), F.col("serial").alias("s"), "stock", "had_loose", "serial_stock")
    )
    seen = rows.join(
        known, F.col("product_id").eqNullSafe(F.col("p")) & F.col("serial").eqNullSafe(F.col("s")), "left").drop("p", "s")
    is_loose = F.col("serial").isNull()
    zero = F.lit(0)
    moved = F.col("signed")
    if cumulative:
        seen = running(seen, ["product_id", "serial"], [cumulative], {"moved": F.col("signed")})
        moved = F.col("moved")
    return (
        seen.withColumn("stock_ok", moved + F.coalesce("stock", zero) >= 0)
        .withColumn("serial_ok", is_loose == F.coalesce(F.col("had_loose"), is_loose))
        .withColumn("cap_ok",
                    is_loose | (F.coalesce("serial_stock", zero) + F.col("signed") <= 1))
        .withColumn("accepted", F.col("stock_ok") & F.col("serial_ok") & F.col("cap_ok"))
        .drop("stock", "had_loose", "serial_stock", "signed", "moved")
    )


def all_accepted(judged: DataFrame) -> Column:
    return judged.agg(F.coalesce(F.every("accepted"), F.lit(True)).alias("ok")).scalar()


def bookable(judged: DataFrame) -> DataFrame:
    """The whole batch if every row was accepted, otherwise nothing."""
    return judged.where(all_accepted(judged)).drop("stock_ok", "serial_ok", "cap_ok", "accepted")


def outcome(judged: DataFrame) -> DataFrame:
    """One row: rows submitted, accepted, and booked (all or none), from one pass."""
    whole = F.coalesce(F.every("accepted"), F.lit(True))
    return judged.agg(
        F.count("*").alias("submitted"), F.count_if("accepted").alias("accepted"),
        F.when(whole, F.count("*")).otherwise(0).cast("bigint").alias("booked"))


def conflicts(judged: DataFrame) -> DataFrame:
    """(field, value): products and serials none of whose rows was accepted."""
    pairs = judged.select(
        F.explode(F.array(
            F.struct(F.lit("product_id").alias("field"), F.col("product_id").alias("value"),
                     "accepted"),
            F.struct(F.lit("serial").alias("field"), F.col("serial").alias("value"), "accepted"),
        )).alias("p")).select("p.*")
    return (
        pairs.groupBy("field", "value").agg(F.bool_or("accepted").alias("any_accepted"))
        .where(~F.col("any_accepted")).select("field", "value")
    )


def admit(batch: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts). An invalid row, or a refused one, empties the first."""
    use_checkpoints(batch.sparkSession)
    # read by the gate, the bookings and the conflicts: judged once
    judged = judge(validity(batch), ledger).checkpoint()
    booked = bookable(judged).where(no_problem(judged)).select(*batch.columns)
    return booked, conflicts(judged)


def cancel(requested: DataFrame, orders: DataFrame, ledger: DataFrame
           ) -> tuple[DataFrame, DataFrame]:
    """(orders after, ledger rows to append) for the requested order ids (column ``id``).

    Only completed orders change, so a second run appends nothing.
    """
    ids = requested.select("id").distinct()
    hit = orders.where(F.col("status") == "completed").join(ids, "id", "left_semi").select("id")
    after = orders.join(hit.withColumn("_hit", F.lit(True)), "id", "left").withColumn(
        "status", F.when(F.col("_hit"), "cancelled").otherwise(F.col("status"))).drop("_hit")
    sold = ledger.where(F.col("type") == "sell").join(
        hit.withColumnRenamed("id", "order_id"), "order_id", "left_semi")
    mirror = sold.select("product_id", F.lit("return").alias("type"), "serial", "quantity",
                         "order_id")
    return after, mirror
