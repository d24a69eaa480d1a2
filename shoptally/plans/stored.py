"""Stored tables: changed in place by bucket, following a folder, searched by ending, bitmaps of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.operators import uniques
from shoptally.plans import views as V
from shoptally.plans.pos import ASKED
from shoptally.plans.registry import query
from shoptally.plans.stock import money
from shoptally.session import shared_folder, stored
from shoptally.sources import endings, keyed, ledger_log, mirror
from shoptally.sources import warehouse as W


# --- cancellations and prices applied to stored tables -----------------------------------------------
@query("L9 L12 J15", V.sql("shop_orders ledger", """
SELECT o.id, CASE WHEN o.status = 'completed' AND a.id IS NOT NULL THEN 'cancelled' ELSE o.status END AS status,
       CAST(coalesce(sum(l.quantity), 0) AS BIGINT) AS returned
FROM shop_orders o LEFT JOIN asked a ON a.id = o.id
LEFT JOIN ledger l ON l.order_id = o.id AND l.type = 'sell' AND o.status = 'completed' AND a.id IS NOT NULL
GROUP BY ALL""", asked=ASKED))
def cancelled_in_stored_tables(spark, d):
    """Urgent orders are cancelled in the stored tables, twice under one token; then both are read."""
    orders, log = shared_folder(spark, "orders"), shared_folder(spark, "log")
    keyed.create(W.orders(spark, d).select("id", "status"), orders, "id")
    ledger_log.append(
        W.ledger(spark, d).select("product_id", "type", "serial", "quantity", "order_id"), log, "opening")
    asked = W.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("id"))
    for _ in range(2):
        keyed.cancel_orders(asked, orders, log, "urgent")
    back = ledger_log.read(spark, log).where(F.col("token") == "urgent").groupBy(
        F.col("order_id").alias("id")).agg(F.sum("quantity").alias("returned"))
    return keyed.whole(spark, orders).join(back, "id", "left").select(
        "id", "status", F.coalesce("returned", F.lit(0)).alias("returned"))


NEW_PRICES = """SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_retailprice AS DECIMAL(18,2)) AS new_price
FROM part WHERE p_type LIKE 'P%' AND p_size > 20"""


@query("L12 J14", V.sql("price", """
SELECT p.product_id, CAST(price AS DOUBLE) AS price, is_active AND coalesce(price = new_price, TRUE) AS is_active
FROM price p LEFT JOIN asked a ON a.product_id = p.product_id
UNION ALL
SELECT product_id, CAST(new_price AS DOUBLE), TRUE FROM asked a WHERE NOT EXISTS (
  SELECT * FROM price p WHERE p.product_id = a.product_id AND p.is_active AND p.price = a.new_price)""",
    asked=NEW_PRICES.replace("AS DECIMAL(18,2))", "AS DECIMAL(18,2)) + p_size % 2")))
def prices_in_stored_table(spark, d):
    """A price list: part of it changes the active price, part confirms it."""
    folder = shared_folder(spark, "prices")
    keyed.create(W.price(spark, d), folder, "product_id")
    part = W.table(spark, d, "part").where(F.col("p_type").startswith("P") & (F.col("p_size") > 20))
    asked = part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        (F.col("p_retailprice").cast("decimal(18,2)") + (F.col("p_size") % 2).cast("decimal(18,2)"))
        .cast("decimal(18,2)").alias("new_price"))
    keyed.set_prices(asked, folder)
    return money(keyed.whole(spark, folder), "price").select("product_id", "price", "is_active")


# --- a folder that changes -------------------------------------------------------------------------------
def _state_sql(state: int, rows: str) -> str:
    return (f"SELECT {state} AS state, o_orderstatus AS status, count(*) AS n_rows, "
            f"CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE {rows} GROUP BY 2")


@query("S7", " UNION ALL ".join([
    _state_sql(1, "o_orderstatus <> 'P'"), _state_sql(2, "o_orderstatus <> 'O' OR o_orderpriority <> '1-URGENT'"),
    _state_sql(3, "o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT')")]))
def folder_states(spark, d):
    """Three states of a folder of orders: two files' worth; one written anew and one added; one emptied."""
    folder, table = shared_folder(spark, "inbox"), shared_folder(spark, "mirror")
    rows = W.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    status, calm = F.col("o_orderstatus"), F.col("o_orderpriority") != "1-URGENT"

    def put(name: str, part: DataFrame) -> None:
        part.write.mode("overwrite").parquet(f"{folder}/{name}")

    steps = [
        {"F": status == "F", "O": status == "O"},
        {"O": (status == "O") & calm, "P": status == "P"},
        {"F": F.lit(False)},
    ]
    seen = []
    for number, step in enumerate(steps, 1):
        for name, kept in step.items():
            put(name, rows.where(kept))
        mirror.refresh(spark, folder, table, rows.schema)
        seen.append(stored(mirror.rows(spark, table, rows.schema).groupBy(status.alias("status")).agg(
            F.lit(number).alias("state"), F.count("*").alias("n_rows"),
            F.sum("o_orderkey").alias("keys")), "state"))
    return reduce(DataFrame.unionByName, seen).select("state", "status", "n_rows", "keys")


# --- search by ending ------------------------------------------------------------------------------------
@query("F14", V.sql("shop_orders", "SELECT id, status FROM shop_orders WHERE CAST(id AS VARCHAR) LIKE '%77'"))
def invoice_search_by_ending_index(spark, d):
    folder = shared_folder(spark, "endings")
    endings.write(W.orders(spark, d).select("id", "status"), "id", folder)
    return endings.search(spark, folder, "77")


# --- distinct counts -----------------------------------------------------------------------------------------
@query("A1 A4 X4", V.sql("sales", " UNION ALL ".join(
    f"SELECT '{g}' AS grain, CAST(date_trunc('{g}', date) AS DATE) AS start, count(DISTINCT invoice) AS invoice, "
    f"count(DISTINCT sku) AS sku FROM sales GROUP BY 2" for g in ("day", "week", "month"))))
def unique_invoices_and_products(spark, d):
    """Invoices and products sold per day, week and month, from one set of daily bitmaps."""
    ids = ["invoice", "sku"]
    daily = stored(uniques.daily_bitmaps(W.sales(spark, d, "date", *ids), ids), "bitmaps")
    return uniques.by_grain(daily, ids)
