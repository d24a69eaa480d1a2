"""Streaming queries: each reads the table's files as a stream, runs until nothing is new, and
returns the final state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.operators import ledger
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.plans.stock import JUDGED, SIGNED, STRICT
from shoptally.session import shared_folder, shuffles_removed
from shoptally.sources import balances
from shoptally.sources import warehouse as W
from shoptally.sources.files import new_files
from shoptally.streaming import admission, events, stock, updates


def arriving(spark, d, name: str) -> DataFrame:
    """The files of one table as a stream."""
    schema = W.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _final(spark, changes: DataFrame, keys: list[str]) -> DataFrame:
    folder = shared_folder(spark, "stream")
    updates.start(changes, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return updates.latest(spark, f"{folder}/log", keys)


@query("T1 A7", V.sql("ledger", f"SELECT product_id, CAST(sum({STRICT}) AS BIGINT) AS stock FROM ledger "
                      "GROUP BY product_id"))
def stream_stock_balance(spark, d):
    moves = W.ledger(spark, d, arriving(spark, d, "lineitem"))
    return _final(spark, stock.balances(moves), ["product_id"])


def _events_sql(view: str) -> str:
    day = "CAST(ts AS DATE)"
    return (f"SELECT {V.trunc(day, view)} AS period, event_type, count(*) AS n, "
            "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY ALL")


def _events(spark, d, view: str) -> DataFrame:
    changes = events.tumbling(arriving(spark, d, "events"), view)
    final = _final(spark, changes, ["period", "event_type"])
    return final.withColumn("value", F.col("value").cast("double"))


@query("T2 X4", _events_sql("1d"))
def stream_daily_events(spark, d):
    return _events(spark, d, "1d")


@query("T2 X4", _events_sql("1w"))
def stream_weekly_events(spark, d):
    return _events(spark, d, "1w")


@query("T3 L1 L2 L3 L4 L5", V.sql("history incoming", """
SELECT 'product_id' AS field, product_id AS value FROM judged GROUP BY product_id
HAVING NOT bool_or(stock_ok AND serial_ok AND cap_ok)
UNION ALL SELECT 'serial', serial FROM judged GROUP BY serial
HAVING NOT bool_or(stock_ok AND serial_ok AND cap_ok)""", **JUDGED))
def stream_ledger_admission(spark, d):
    """The open movements arrive as a stream; the batch is refused and its conflicts are listed."""
    moves = W.ledger(spark, d, arriving(spark, d, "lineitem")).where(F.col("phase") == "O").drop(
        "phase", "created_at", "order_id")
    folder = shared_folder(spark, "stream")
    admission.start(moves, W.history(spark, d), f"{folder}/log", f"{folder}/refused",
                    f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/refused").select("field", "value")


@query("T3 L1 L2 L3 L4 L5", V.sql("history incoming", """
SELECT id, product_id, serial, type, quantity, 0 AS number FROM judged WHERE stock_ok AND serial_ok AND cap_ok""",
                                  **JUDGED))
def stream_ledger_booked(spark, d):
    """The booked log after three micro-batches: the rows that pass, all rows (refused as a whole),
    and one row with an order id (refused)."""
    folder = shared_folder(spark, "stream")
    history = W.history(spark, d)
    with shuffles_removed(spark):
        for arrivals in _three_batches(spark, d, folder):
            admission.start(arrivals, history, f"{folder}/log", f"{folder}/refused",
                            f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/log").select(
        "id", "product_id", "serial", "type", "quantity", F.col("number").cast("int").alias("number"))


def _three_batches(spark, d, folder: str) -> Iterator[DataFrame]:
    """The rows that pass, all rows, and one row with an order id, each written to the watched folder
    once the stream has taken what was there. Yields the folder's stream, to be run to its end with one
    checkpoint: what is new is one micro-batch, of as many files as its writing tasks."""
    rows = W.incoming(spark, d)
    passing = ledger.judge(rows, W.history(spark, d)).where("accepted").select(*rows.columns)
    none = F.lit(None).cast("bigint")
    batches = [passing.withColumn("order_id", none), rows.withColumn("order_id", none),
               spark.createDataFrame([("x", "new", None, "import_po", 1, 99)],
                                     "id string, product_id string, serial string, type string, "
                                     "quantity bigint, order_id bigint")]
    for number, batch in enumerate(batches):
        batch.write.parquet(f"{folder}/in/{number}")
        yield (spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", True)
               .parquet(f"{folder}/in"))


def _booked_with_stock(spark, d) -> str:
    folder = shared_folder(spark, "stream")
    with shuffles_removed(spark):
        balances.create(W.history(spark, d), f"{folder}/stock", 16)
        for arrivals in _three_batches(spark, d, folder):
            admission.start_with_stock(arrivals, f"{folder}/stock", f"{folder}/log",
                                       f"{folder}/refused", f"{folder}/checkpoint", "till", 1).awaitTermination()
    return folder


@query("T3 L1 L2 L3 L4 L5", V.sql("history incoming", """
SELECT id, product_id, serial, type, quantity, 0 AS number FROM judged WHERE stock_ok AND serial_ok AND cap_ok""",
                                  **JUDGED))
def stream_ledger_booked_with_stock(spark, d):
    """The same three micro-batches, judged against the stock table: no batch reads the history."""
    return spark.read.parquet(f"{_booked_with_stock(spark, d)}/log").select(
        "id", "product_id", "serial", "type", "quantity", F.col("number").cast("int").alias("number"))


@query("T3 A8 L2", V.sql("history incoming", f"""
SELECT product_id, serial, CAST(sum({SIGNED}) AS BIGINT) AS stock FROM (
  SELECT product_id, serial, type, quantity FROM history
  UNION ALL SELECT product_id, serial, type, quantity FROM judged WHERE stock_ok AND serial_ok AND cap_ok)
WHERE product_id IS NOT NULL GROUP BY ALL""", **JUDGED))
def stock_table_after_stream(spark, d):
    """The stock table once the stream has ended, changes and compacted buckets together."""
    return balances.whole(spark, f"{_booked_with_stock(spark, d)}/stock")


@query("A8 L2 J11", V.sql("history incoming", f"""
SELECT product_id, serial, CAST(sum({SIGNED}) AS BIGINT) AS stock FROM history
WHERE product_id IN (SELECT product_id FROM incoming WHERE type = 'rtv') GROUP BY ALL"""))
def stock_table_of_products(spark, d):
    """Balances of the returned products, from the buckets of a stock table that hold them."""
    folder = shared_folder(spark, "stock")
    balances.create(W.history(spark, d), folder)
    return balances.held(spark, folder, W.incoming(spark, d).where(F.col("type") == "rtv"))


@query("L2", V.sql("history ledger", f"""
SELECT u.id, u.product_id, u.serial, u.type, u.quantity,
       sum({SIGNED}) OVER (PARTITION BY u.product_id, u.serial ORDER BY u.id) + coalesce(h.stock, 0) >= 0 AS stock_ok
FROM (SELECT * REPLACE (concat(id, '-', CAST(order_id AS VARCHAR)) AS id) FROM ledger WHERE phase = 'O') u
LEFT JOIN (SELECT product_id, serial, sum({SIGNED}) AS stock FROM history GROUP BY ALL) h
ON h.product_id = u.product_id AND h.serial IS NOT DISTINCT FROM u.serial"""))
def ledger_batch_judged_in_order(spark, d):
    """Rows of a batch against what the rows before them leave."""
    rows = W.ledger(spark, d).where(F.col("phase") == "O").withColumn(
        "id", F.concat("id", F.lit("-"), F.col("order_id").cast("string"))).drop("order_id", "phase", "created_at")
    judged = ledger.judge(rows, W.history(spark, d), "id")
    return judged.select("id", "product_id", "serial", "type", "quantity", "stock_ok")


@query("S7", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def new_files_once(spark, d):
    """A folder watched twice: the second run finds nothing new, so every row is there once."""
    folder = shared_folder(spark, "watch")
    source = f"{folder}/incoming"
    W.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.parquet(
        source)
    schema = spark.read.parquet(source).schema
    for _ in range(2):
        (new_files(spark, source, schema).writeStream.format("parquet")
         .option("path", f"{folder}/taken").option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(f"{folder}/taken")
