"""Stock derived from the append-only ledger: by product, by serial, and joined to products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import total
from shoptally.functions.parts import PART_ROWS, with_parts
from shoptally.functions.rules import signed_quantity


def balance(ledger: DataFrame) -> DataFrame:
    """Stock per product; a type that is not known moves nothing."""
    signed = signed_quantity(F.col("type"), F.col("quantity"), unknown="zero")
    return ledger.groupBy("product_id").agg(F.sum(signed).alias("stock"))


def serial_balance(ledger: DataFrame) -> DataFrame:
    """Stock per (product, serial); NULL serial is the product's loose stock."""
    signed = signed_quantity(F.col("type"), F.col("quantity"))
    return ledger.groupBy("product_id", "serial").agg(F.sum(signed).alias("stock"))


def priced_products(product: DataFrame, price: DataFrame) -> DataFrame:
    """Products with their active price; those without one are left out."""
    active = price.where("is_active").select(F.col("product_id").alias("id"), "price")
    return product.join(active, "id")


def stock(product: DataFrame, price: DataFrame, ledger: DataFrame) -> DataFrame:
    """Inventory list: priced products with their stock, 0 where nothing moved."""
    moved = balance(ledger).withColumnRenamed("product_id", "id")
    return (
        priced_products(product, price).join(moved, "id", "left")
        .withColumn("stock", F.coalesce("stock", F.lit(0)).cast("bigint"))
        .select("ean", "id", "cat", "subcat", "name", "price", "stock")
        .orderBy("id")
    )


def serials(ledger: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(product_id, part, serial_list): serials in stock in order, ``part_rows`` to a row."""
    held = serial_balance(ledger.where(F.col("serial").isNotNull())).where(F.col("stock") > 0)
    return (
        with_parts(held, ["product_id"], "serial", part_rows)
        .groupBy("product_id", "part")
        .agg(F.sort_array(F.collect_list("serial")).alias("serial_list"))
    )


def type_totals(ledger: DataFrame) -> DataFrame:
    """Lines and pieces per ledger type."""
    return ledger.groupBy("type").agg(
        F.count("*").alias("lines"), total("quantity").alias("total"))


def serial_modes(ledger: DataFrame) -> DataFrame:
    """Per product: does it have loose rows, serial rows, or both?"""
    loose = F.col("serial").isNull()
    return ledger.groupBy("product_id").agg(
        F.bool_or(loose).alias("has_loose"),
        F.bool_or(~loose).alias("has_serial"),
        (F.bool_or(loose) & F.bool_or(~loose)).alias("mixed"),
    )
