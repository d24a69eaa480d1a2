"""Bulk upload sheet: guard, product consolidation, change summary, ledger extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import tidy_strings, total
from shoptally.operators.copies import repeated_keys
from shoptally.session import use_checkpoints

COLUMNS = K.UPLOAD_PRODUCT_COLUMNS + K.UPLOAD_LEDGER_COLUMNS
# batch rules in the order they are reported
RULES = ("type", "duplicate serial", "mixed serials", "quantity", "type without quantity")


LINE = "line"  # position of a row in its sheet, given by the reader


def check_columns(sheet: DataFrame) -> None:
    if set(sheet.columns) - {LINE} != set(COLUMNS):
        raise ValueError(f"the sheet needs exactly these columns: {', '.join(COLUMNS)}")


def usable_rows(sheet: DataFrame) -> DataFrame:
    """Rows with an id and an ean; a serial row counts one piece."""
    check_columns(sheet)
    rows = tidy_strings(sheet).where(F.col("id").isNotNull() & F.col("ean").isNotNull())
    return rows.withColumn(
        "quantity", F.when(F.col("serial").isNotNull(), 1).otherwise(F.col("quantity"))
        .cast("bigint"))


def violations(rows: DataFrame) -> DataFrame:
    """(rule, n): how often each batch rule is broken, zero included."""
    kind, qty = F.col("type"), F.col("quantity")
    by_row = rows.agg(
        F.count_if(~kind.isin(*K.MANUAL_TYPES)).alias("type"),
        F.count_if(qty <= 0).alias("quantity"),
        F.count_if(qty.isNull() & kind.isNotNull()).alias("type without quantity"),
    )
    copies = repeated_keys(rows, "serial").agg(F.count("*").alias("n")).scalar()
    loose = F.col("serial").isNull()
    mixed = (
        rows.groupBy("id").agg((F.bool_or(loose) & F.bool_or(~loose)).alias("mixed"))
        .agg(F.count_if("mixed").alias("n")).scalar()
    )
    one = by_row.withColumns({"duplicate serial": copies, "mixed serials": mixed})
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("n")) for r in RULES
    ])).alias("v")).select("v.*")


def refused(rows: DataFrame) -> Column:
    """Scalar: does the batch break any rule?"""
    return violations(rows).agg(F.bool_or(F.col("n") > 0).alias("bad")).scalar()


def guard(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, or none if the batch is refused; violations per rule)."""
    rows = usable_rows(sheet)
    return rows.where(~refused(rows)), violations(rows)


def consolidate(rows: DataFrame, order: str = LINE) -> DataFrame:
    """One row per (id, ean): first known cat, subcat and name in ``order``, highest price."""
    firsts = [
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
        for c in ("cat", "subcat", "name")
    ]
    return rows.groupBy("id", "ean").agg(*firsts, F.max("price").alias("price"))


def product_check(products: DataFrame) -> DataFrame:
    """One row: rows without a usable price, repeats of an id, repeats of an ean. A repeat is
    every row after the first, counted before priceless rows are dropped."""
    ids = products.groupBy("id").agg((F.count("*") - 1).alias("extra"))
    eans = products.groupBy("ean").agg((F.count("*") - 1).alias("extra"))
    return products.agg(
        F.count_if(F.coalesce(F.col("price") <= 0, F.lit(True))).alias("no_price"),
    ).withColumns({
        "dup_id": ids.agg(total("extra").alias("n")).scalar(),
        "dup_ean": eans.agg(total("extra").alias("n")).scalar(),
    })


def checked_products(products: DataFrame) -> DataFrame:
    """Products with a price, or none if an id or ean repeats."""
    fine = product_check(products).select(
        ((F.col("dup_id") == 0) & (F.col("dup_ean") == 0)).alias("ok")).scalar()
    return products.where((F.col("price") > 0) & fine)


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Rows that move stock."""
    return rows.where(F.col("type").isNotNull()).select(
        F.col("id").alias("product_id"), *K.UPLOAD_LEDGER_COLUMNS)


def new_ids(products: DataFrame, inventory: DataFrame) -> DataFrame:
    return products.join(inventory.select("id"), "id", "left_anti")


def new_prices(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products whose price differs from the stock list's, or that it does not hold."""
    old = inventory.select("id", F.col("price").alias("old_price"))
    return products.join(old, "id", "left").where(~F.col("price").eqNullSafe(F.col("old_price")))


def summary(products: DataFrame, moves: DataFrame, inventory: DataFrame) -> DataFrame:
    """(figure, value): records, new products, new prices, ledger lines, pieces per type."""
    use_checkpoints(products.sparkSession)
    products = products.checkpoint()  # three counts read it
    moves = moves.groupBy("type").agg(F.count("*").alias("lines"), total("quantity").alias("pieces")).checkpoint()

    def count(df: DataFrame, figure: str, value: Column | None = None) -> DataFrame:
        return df.agg((F.count("*") if value is None else value).alias("value")).select(
            F.lit(figure).alias("figure"), F.col("value").cast("bigint"))

    types = moves.select(F.col("type").alias("figure"), F.col("pieces").cast("bigint").alias("value"))
    return (
        count(products, "Records", F.count_distinct("id"))
        .unionByName(count(new_ids(products, inventory), "New Product"))
        .unionByName(count(new_prices(products, inventory), "New Price"))
        .unionByName(count(moves, "Lines", total("lines")))
        .unionByName(types)
    )
