"""Stock control: balances, inventory, serials, ledger batches and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.parts import with_parts
from shoptally.operators import inventory, ledger
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.session import shared_folder, stored
from shoptally.sources import ledger_log, warehouse as W

IN_SQL = "('import_po', 'import_do', 'adjust_in', 'return')"
SIGNED = f"CASE WHEN type IN {IN_SQL} THEN quantity ELSE -quantity END"
STRICT = (f"CASE WHEN type IN {IN_SQL} THEN quantity "
          "WHEN type IN ('adjust_out', 'transfer', 'sell', 'rtv') THEN -quantity ELSE 0 END")


def joined(c: str, sep: str = "|") -> Column:
    """A list as text, NULL members as ``~``."""
    return F.array_join(
        F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("~"))), sep).alias(c)


def money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# --- balances ------------------------------------------------------------------------------
@query("A7", V.sql("ledger", f"SELECT product_id, CAST(sum({STRICT}) AS BIGINT) AS stock "
                   "FROM ledger GROUP BY product_id"))
def stock_by_product(spark, d):
    return inventory.balance(W.ledger(spark, d))


@query("A8", V.sql("ledger", f"SELECT product_id, serial, CAST(sum({SIGNED}) AS BIGINT) AS stock "
                   "FROM ledger GROUP BY ALL"))
def stock_by_product_and_serial(spark, d):
    return inventory.serial_balance(W.ledger(spark, d))


@query("J3", V.sql("product price", "SELECT ean, p.id, cat, subcat, name, CAST(price AS DOUBLE) AS price "
                   "FROM product p JOIN price r ON p.id = r.product_id AND r.is_active"))
def products_with_active_price(spark, d):
    return money(inventory.priced_products(W.product(spark, d), W.price(spark, d)), "price")


@query("J4", V.sql("product history", f"""
SELECT p.id, CAST(coalesce(s.stock, 0) AS BIGINT) AS stock FROM product p LEFT JOIN
(SELECT product_id, sum({STRICT}) AS stock FROM history WHERE type = 'sell' GROUP BY 1) s
ON p.id = s.product_id"""))
def product_left_join_sold(spark, d):
    sold = W.history(spark, d).where(F.col("type") == "sell")
    moved = inventory.balance(sold).withColumnRenamed("product_id", "id")
    return W.product(spark, d).select("id").join(moved, "id", "left").withColumn(
        "stock", F.coalesce("stock", F.lit(0)))


@query("V1 J3 J4 A7 O2 S6", V.sql("product price ledger", f"""
SELECT ean, p.id, cat, subcat, name, CAST(price AS DOUBLE) AS price,
       CAST(coalesce(s.stock, 0) AS BIGINT) AS stock
FROM product p JOIN price r ON p.id = r.product_id AND r.is_active
LEFT JOIN (SELECT product_id, sum({STRICT}) AS stock FROM ledger GROUP BY 1) s
ON p.id = s.product_id"""))
def inventory_list(spark, d):
    listed = inventory.stock(W.product(spark, d), W.price(spark, d), W.ledger(spark, d))
    return money(listed, "price")


@query("V3 A9", V.sql("ledger", f"""
SELECT product_id, part, string_agg(serial, '|' ORDER BY serial) AS serial_list
FROM (SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY serial) - 1) // 3 AS part
      FROM (SELECT product_id, serial FROM ledger WHERE serial IS NOT NULL GROUP BY ALL
            HAVING sum({SIGNED}) > 0)) GROUP BY ALL"""))
def serials_in_stock(spark, d):
    return inventory.serials(W.ledger(spark, d), 3).select(
        "product_id", "part", joined("serial_list"))


@query("A13", V.sql("ledger", "SELECT type, count(*) AS lines, CAST(sum(quantity) AS BIGINT) AS total "
                    "FROM ledger GROUP BY type"))
def ledger_totals_by_type(spark, d):
    return inventory.type_totals(W.ledger(spark, d))


@query("A11 W2 W5", V.sql("ledger", """
SELECT product_id, bool_or(serial IS NULL) AS has_loose, bool_or(serial IS NOT NULL) AS has_serial,
       bool_or(serial IS NULL) AND bool_or(serial IS NOT NULL) AS mixed
FROM ledger GROUP BY product_id"""))
def products_with_mixed_serials(spark, d):
    return inventory.serial_modes(W.ledger(spark, d))


# --- ledger batch ------------------------------------------------------------------------------
@query("J10", V.sql("history incoming", """
SELECT product_id, type, count(*) AS n FROM history
WHERE product_id IN (SELECT product_id FROM incoming WHERE type = 'rtv') GROUP BY ALL"""))
def history_of_returned_products(spark, d):
    payload = W.incoming(spark, d).where(F.col("type") == "rtv").select("product_id").distinct()
    return W.history(spark, d).join(payload, "product_id", "left_semi").groupBy(
        "product_id", "type").agg(F.count("*").alias("n"))


@query("J11", V.sql("history incoming", """
SELECT u.product_id, u.serial, u.type, u.quantity, CAST(h.n AS BIGINT) AS n
FROM incoming u LEFT JOIN (SELECT product_id, serial, count(*) AS n FROM history GROUP BY ALL) h
ON u.product_id = h.product_id AND u.serial IS NOT DISTINCT FROM h.serial"""))
def incoming_with_null_safe_history(spark, d):
    seen = W.history(spark, d).groupBy(F.col("product_id").alias("p"), F.col("serial").alias("s")
                                       ).agg(F.count("*").alias("n"))
    return W.incoming(spark, d).join(
        seen, (F.col("product_id") == F.col("p")) & F.col("serial").eqNullSafe(F.col("s")), "left"
    ).select("product_id", "serial", "type", "quantity", "n")


RAW_BATCH = f"""
SELECT product_id, serial, CASE WHEN quantity = 50 THEN NULL ELSE type END AS type,
       CASE WHEN type = 'rtv' AND serial IS NULL AND quantity < 5 THEN 0
            WHEN type = 'transfer' AND serial IS NOT NULL THEN 2 ELSE quantity END AS quantity,
       CASE WHEN type = 'adjust_out' AND quantity > 45 THEN order_id END AS order_id FROM ledger"""


def raw_batch(spark, d) -> DataFrame:
    """The ledger as a faulty batch: no type, no pieces, an order id, a serial with two pieces."""
    kind, qty, serial = F.col("type"), F.col("quantity"), F.col("serial")
    return W.ledger(spark, d).select(
        "product_id", "serial",
        F.when(qty != 50, kind).alias("type"),
        F.when((kind == "rtv") & serial.isNull() & (qty < 5), 0)
        .when((kind == "transfer") & serial.isNotNull(), 2).otherwise(qty)
        .cast("bigint").alias("quantity"),
        F.when((kind == "adjust_out") & (qty > 45), F.col("order_id")).alias("order_id"))


@query("L1 W2", V.sql("ledger", f"""
SELECT coalesce(problem, 'valid') AS problem, count(*) AS n FROM (
  SELECT CASE WHEN b.product_id IS NULL OR type IS NULL OR quantity IS NULL THEN 'missing value'
              WHEN type NOT IN ('import_po', 'import_do', 'adjust_in', 'adjust_out', 'transfer', 'rtv')
              THEN 'type' WHEN quantity <= 0 THEN 'quantity' WHEN order_id IS NOT NULL THEN 'order id'
              WHEN serial IS NOT NULL AND quantity <> 1 THEN 'serial quantity'
              WHEN mixed THEN 'mixed serials' END AS problem
  FROM b JOIN (SELECT product_id, bool_or(serial IS NULL) AND bool_or(serial IS NOT NULL) AS mixed
               FROM b GROUP BY 1) m ON b.product_id = m.product_id) GROUP BY 1""", b=RAW_BATCH))
def ledger_row_problems(spark, d):
    return ledger.validity(raw_batch(spark, d)).groupBy(
        F.coalesce("problem", F.lit("valid")).alias("problem")).agg(F.count("*").alias("n"))


JUDGED = {
    "held": f"""SELECT product_id, serial, sum({SIGNED}) AS stock FROM history
 WHERE product_id IN (SELECT product_id FROM incoming) GROUP BY ALL""",
    "judged": f"""
SELECT u.product_id, u.serial, u.type, u.quantity, u.id,
 ({SIGNED}) + coalesce(h.stock, 0) >= 0 AS stock_ok,
 (u.serial IS NULL) = coalesce(l.had_loose, u.serial IS NULL) AS serial_ok,
 u.serial IS NULL OR coalesce(s.stock, 0) + ({SIGNED}) <= 1 AS cap_ok
FROM incoming u
LEFT JOIN held h ON h.product_id = u.product_id AND h.serial IS NOT DISTINCT FROM u.serial
LEFT JOIN (SELECT product_id, bool_or(serial IS NULL) AS had_loose FROM held GROUP BY 1) l
  ON l.product_id = u.product_id
LEFT JOIN (SELECT serial, sum(stock) AS stock FROM held WHERE serial IS NOT NULL GROUP BY 1) s
  ON s.serial = u.serial""",
}


def judged_batch(spark, d) -> DataFrame:
    return ledger.judge(W.incoming(spark, d), W.history(spark, d))


@query("L2 L3 L4 J11 J13", V.sql("history incoming", """
SELECT product_id, serial, type, quantity, id, stock_ok, serial_ok, cap_ok,
       stock_ok AND serial_ok AND cap_ok AS accepted FROM judged""", **JUDGED))
def ledger_batch_judged(spark, d):
    return judged_batch(spark, d)


@query("L5 A18", V.sql("history incoming", """
SELECT count(*) AS submitted, count(*) FILTER (WHERE stock_ok AND serial_ok AND cap_ok) AS accepted,
       CASE WHEN bool_and(stock_ok AND serial_ok AND cap_ok) THEN count(*) ELSE 0 END AS booked
FROM judged""", **JUDGED))
def ledger_batch_outcome(spark, d):
    return ledger.outcome(judged_batch(spark, d))


@query("L5 U3", V.sql("history incoming", """
SELECT 'product_id' AS field, product_id AS value FROM judged GROUP BY product_id
HAVING NOT bool_or(stock_ok AND serial_ok AND cap_ok)
UNION ALL SELECT 'serial', serial FROM judged GROUP BY serial
HAVING NOT bool_or(stock_ok AND serial_ok AND cap_ok)""", **JUDGED))
def ledger_batch_conflicts(spark, d):
    return ledger.conflicts(judged_batch(spark, d))


def _accepted(spark, d) -> DataFrame:
    """The rows of the batch that pass: as a batch of their own they are booked as a whole."""
    return judged_batch(spark, d).where("accepted").select(
        "id", "product_id", "serial", "type", "quantity")


@query("S10 L5", V.sql("history incoming", f"""
SELECT id, product_id, serial, type, quantity, CAST({K.FIRST_SEQUENCE_ID} AS BIGINT) AS batch_id
FROM judged WHERE stock_ok AND serial_ok AND cap_ok""", **JUDGED))
def ledger_batch_stamped(spark, d):
    past = W.history(spark, d)
    # read twice by the judgement and twice by the gate: each written once
    batch = stored(_accepted(spark, d), "batch")
    booked = ledger.bookable(stored(ledger.judge(batch, past), "judged"))
    return ledger_log.stamp(booked, past.withColumn("batch_id", F.lit(None).cast("bigint")))


@query("S10 S3", V.sql("ledger", f"""
SELECT product_id, serial, type, quantity,
       CASE WHEN phase = 'F' THEN {K.FIRST_SEQUENCE_ID} ELSE {K.FIRST_SEQUENCE_ID + 1} END AS batch_id
FROM ledger"""))
def ledger_log_round_trip(spark, d):
    """Two batches appended to a log folder and read back."""
    folder = shared_folder(spark, "ledger-log")
    columns = ("product_id", "serial", "type", "quantity")
    ledger_log.append(W.history(spark, d).select(*columns), folder, "history")
    for _ in range(2):  # a repeated batch is there already
        ledger_log.append(W.incoming(spark, d).select(*columns), folder, "incoming")
    return ledger_log.read(spark, folder).drop("token")


# --- list payloads -------------------------------------------------------------------------------
LISTS = ["product_id", "serial", "quantity"]


def payload(spark, d) -> DataFrame:
    """Order lines packed into parallel lists of up to three."""
    rows = with_parts(W.item(spark, d), ["order_id"], "id", 3)
    return ledger_log.to_lists(rows, ["order_id", "part"], "id", LISTS)


@query("S9 A10", V.sql("item", """
SELECT order_id, part, string_agg(product_id, '|' ORDER BY id) AS product_id,
       string_agg(coalesce(serial, '~'), '|' ORDER BY id) AS serial,
       string_agg(CAST(quantity AS VARCHAR), '|' ORDER BY id) AS quantity
FROM (SELECT *, (row_number() OVER (PARTITION BY order_id ORDER BY id) - 1) // 3 AS part FROM item)
GROUP BY ALL"""))
def payload_lists(spark, d):
    return payload(spark, d).select("order_id", "part", *[joined(c) for c in LISTS])


@query("S8 X14", V.sql("item", """
SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY id) - 1 AS BIGINT) AS pos,
       product_id, serial, quantity FROM item"""))
def payload_rows(spark, d):
    rows = ledger_log.to_rows(payload(spark, d), LISTS, ["order_id", "part"])
    return rows.withColumn("pos", F.col("part") * 3 + F.col("pos")).drop("part")
