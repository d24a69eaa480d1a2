"""Product, price and customer batches: tidy, set duplicates aside, insert what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import any_of, join_key, tidy_strings
from shoptally.functions.rules import valid_email
from shoptally.operators.copies import mark_all_copies
from shoptally.session import use_checkpoints

PRODUCT = ("id", "ean", "cat", "subcat", "name")


def checked_products(batch: DataFrame) -> DataFrame:
    """Tidied batch with ``invalid``: a missing required value, or any copy of a repeated id or
    ean."""
    rows = tidy_strings(batch)
    rows = mark_all_copies(rows, "id", "dup_id").transform(
        mark_all_copies, "ean", "dup_ean")
    missing = any_of(F.col(c).isNull() for c in ("id", "ean", "cat", "name"))
    return rows.withColumn("invalid", missing | F.col("dup_id") | F.col("dup_ean")).drop(
        "dup_id", "dup_ean")


def valid_products(batch: DataFrame) -> DataFrame:
    return checked_products(batch).where(~F.col("invalid")).drop("invalid")


def new_products(valid: DataFrame, product: DataFrame) -> DataFrame:
    """Rows whose id the master does not hold; known products stay as they are."""
    return valid.select(*PRODUCT).join(product.select("id"), "id", "left_anti")


def priced(valid: DataFrame) -> DataFrame:
    return valid.where(F.col("price") > 0).select(
        F.col("id").alias("product_id"), F.col("price").alias("new_price"))


def retire_prices(price: DataFrame, prices: DataFrame) -> DataFrame:
    """Price history with every active price that differs from the new one made inactive."""
    changed = F.col("new_price").isNotNull() & (F.col("price") != F.col("new_price"))
    return (
        price.join(prices, "product_id", "left")
        .withColumn("is_active", F.col("is_active") & ~changed)
        .select(*price.columns)
    )


def added_prices(price: DataFrame, prices: DataFrame) -> DataFrame:
    """New active prices: products that keep no active price after ``retire_prices``."""
    kept = price.where("is_active").join(
        prices, (price["product_id"] == prices["product_id"])
        & (price["price"] == prices["new_price"]), "left_semi").select("product_id")
    return prices.join(kept, "product_id", "left_anti").select(
        "product_id", F.col("new_price").alias("price"), F.lit(True).alias("is_active"))


def products(batch: DataFrame, product: DataFrame, price: DataFrame
             ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(products to insert, price history after retiring, prices to insert, one-row report)."""
    use_checkpoints(batch.sparkSession)
    checked = checked_products(batch).checkpoint()  # read by the inserts and by each count
    valid = checked.where(~F.col("invalid")).drop("invalid")
    prices = priced(valid)
    fresh, added = new_products(valid, product).checkpoint(), added_prices(price, prices).checkpoint()
    return fresh, retire_prices(price, prices), added, product_report(checked, fresh, prices, added)


def product_report(checked: DataFrame, fresh: DataFrame, prices: DataFrame, added: DataFrame
                   ) -> DataFrame:
    """status, input, invalid, product, price: ``success`` needs every row to be inserted."""
    def size(df: DataFrame):
        return df.agg(F.count("*").alias("n")).scalar()

    report = checked.agg(
        F.count("*").alias("input"), F.count_if("invalid").alias("invalid")
    ).withColumns({"product": size(fresh), "price": size(added), "_prices": size(prices)})
    whole = (
        (F.col("invalid") == 0) & (F.col("product") == F.col("input"))
        & (F.col("price") == F.col("_prices"))
    )
    return report.select(
        F.when(F.col("input") == F.col("invalid"), "nothing").when(whole, "success")
        .otherwise("partial").alias("status"), "input", "invalid", "product", "price")


def checked_customers(batch: DataFrame) -> DataFrame:
    """Batch with ``duplicate``: any copy of a repeated id or of a repeated e-mail."""
    rows = mark_all_copies(batch, "id", "dup_id").transform(mark_all_copies, "email", "dup_email")
    return rows.withColumn("duplicate", F.col("dup_id") | F.col("dup_email")).drop(
        "dup_id", "dup_email")


def new_customers(batch: DataFrame, customer: DataFrame) -> DataFrame:
    return _unknown(checked_customers(batch), customer)


def _unknown(checked: DataFrame, customer: DataFrame) -> DataFrame:
    unique = checked.where(~F.col("duplicate")).drop("duplicate")
    return unique.join(customer.select("id"), "id", "left_anti")


def blocked_customers(fresh: DataFrame, customer: DataFrame) -> DataFrame:
    """New rows the table's own rules refuse: a malformed e-mail, or one another customer has.
    One such row keeps the whole batch out."""
    taken = customer.where(F.col("email").isNotNull()).select(
        F.col("email").alias("_taken")).distinct()
    return fresh.join(taken, join_key("email", "id") == F.col("_taken"), "left").where(
        F.col("_taken").isNotNull() | ~F.coalesce(valid_email(F.col("email")), F.lit(True))
    ).drop("_taken")


def customers(batch: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, one-row report). Codes: 00 nothing usable, 01 inserted, 02 all known."""
    use_checkpoints(batch.sparkSession)
    checked = checked_customers(batch).checkpoint()  # read by the inserts and by each count
    fresh = _unknown(checked, customer).checkpoint()
    stop = blocked_customers(fresh, customer).agg(F.count("*").alias("n")).scalar()
    n_fresh = fresh.agg(F.count("*").alias("n")).scalar()
    report = checked.agg(
        F.count("*").alias("input"), F.count_if("duplicate").alias("duplicates")
    ).withColumns({"blocked": stop, "fresh": n_fresh})
    inserted = F.when(F.col("blocked") == 0, F.col("fresh")).otherwise(0)
    code = (
        F.when(F.col("input") == F.col("duplicates"), "00").when(F.col("blocked") > 0, "error")
        .when(F.col("fresh") > 0, "01").otherwise("02")
    )
    return fresh.where(stop == 0), report.select(
        "input", "duplicates", "blocked", inserted.alias("inserted"), code.alias("code"))
