"""Table profiles and the integrity rules of the store tables, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import total
from shoptally.functions.rules import valid_email
from shoptally.operators.copies import repeated_keys


def profile(df: DataFrame) -> DataFrame:
    """(column_name, dtype, nulls, n_rows) for every column, in one pass."""
    one = df.agg(F.count("*").alias("n_rows"), *[
        F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
                 F.col(f"null_{i}").alias("nulls"), F.col("n_rows"))
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _rows(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules of a table in one pass."""
    counts = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(broken.values())])
    lines = [F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations"))
             for i, rule in enumerate(broken)]
    return counts.select(F.explode(F.array(*lines)).alias("r")).select("r.*")


def _count(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def _orphans(name: str, child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Child rows whose key the parent lacks. Rows are counted per key before the join."""
    known = parent.select(F.col("id").alias(key))
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return keys.join(known, key, "left_anti").agg(total("n").alias("violations")).select(
        F.lit(name).alias("rule"), "violations")


def integrity(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) over customer, product, orders, item, price, payment, staff and
    stock_ledger; every rule is listed, kept ones with 0."""
    c = F.col
    checks = [
        _rows(t["customer"], {
            "customer email form": ~F.coalesce(valid_email(c("email")), F.lit(True))}),
        _rows(t["orders"], {
            "orders discount": c("discount") < 0,
            "orders status": ~c("status").isin(*K.ORDER_STATUSES)}),
        _rows(t["item"], {
            "item quantity": c("quantity") <= 0, "item price": c("price") < 0,
            "item discount": c("discount") < 0}),
        _rows(t["price"], {"price positive": c("price") <= 0}),
        _rows(t["payment"], {
            "payment amount": c("amount") <= 0,
            "payment method": ~c("method").isin(*K.PAYMENT_METHODS)}),
        _rows(t["stock_ledger"], {
            "ledger quantity": c("quantity") <= 0,
            "ledger type": ~c("type").isin(*K.INBOUND_TYPES, *K.OUTBOUND_TYPES)}),
        _count("customer id unique", repeated_keys(t["customer"], "id")),
        _count("customer email unique", repeated_keys(t["customer"], "email")),
        _count("product id unique", repeated_keys(t["product"], "id")),
        _count("product ean unique", repeated_keys(t["product"], "ean")),
        _count("price one active", repeated_keys(t["price"].where("is_active"), "product_id")),
        _count("ledger serial of one product", _shared_serials(t["stock_ledger"])),
        _orphans("payment of an order", t["payment"], "order_id", t["orders"]),
        _orphans("item of an order", t["item"], "order_id", t["orders"]),
        _orphans("item of a product", t["item"], "product_id", t["product"]),
        _orphans("order of a customer", t["orders"], "customer_id", t["customer"]),
        _orphans("order of a staff member", t["orders"], "staff_id", t["staff"]),
        _orphans("price of a product", t["price"], "product_id", t["product"]),
        _orphans("ledger row of an order", t["stock_ledger"], "order_id", t["orders"]),
        _orphans("ledger row of a product", t["stock_ledger"], "product_id", t["product"]),
    ]
    return reduce(DataFrame.unionByName, checks)


def _shared_serials(ledger: DataFrame) -> DataFrame:
    """Serials seen with more than one product; min and max tell without a distinct count."""
    return (
        ledger.where(F.col("serial").isNotNull()).groupBy("serial")
        .agg(F.min("product_id").alias("a"), F.max("product_id").alias("b"))
        .where(F.col("a") != F.col("b"))
    )
