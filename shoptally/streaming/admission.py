"""Ledger batches booked as they arrive: each micro-batch goes in as a whole or not at all."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.operators import ledger
from shoptally.session import stored_meanwhile, use_checkpoints
from shoptally.sources import balances
from shoptally.sources.ledger_log import exists

ROW = ("product_id", "serial", "type", "quantity")


def start(arrivals: DataFrame, booked: DataFrame, log: str, refused: str, checkpoint: str):
    """Judge every micro-batch against ``booked`` plus all that the log holds.

    Rows are judged and booked with all their columns. One stream at a time writes a log: that is
    what keeps two batches from taking the same stock. Output folders carry the stream's own id and
    the number of the micro-batch: a repeated micro-batch replaces its own rows, and a stream with
    a new checkpoint never touches what earlier ones booked.
    """
    spark = arrivals.sparkSession
    use_checkpoints(spark)
    own, known = [], Event()

    def book(batch: DataFrame, number: int) -> None:
        known.wait()
        past = booked.select(*ROW)
        if exists(spark, log):
            mine = (F.col("stream") == own[0]) & (F.col("number") >= number)
            past = past.unionByName(spark.read.parquet(log).where(~mine).select(*ROW))
        place = f"stream={own[0]}/number={number}"
        with stored_meanwhile(ledger.judge(ledger.validity(batch), past), "judged") as judged:
            fine = ledger.no_problem(judged)
            ledger.bookable(judged).where(fine).select(*batch.columns).write.mode("overwrite").parquet(
                f"{log}/{place}")
            ledger.conflicts(judged).write.mode("overwrite").parquet(f"{refused}/{place}")

    query = (
        arrivals.writeStream.foreachBatch(book).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    own.append(str(query.id))
    known.set()
    return query


def start_with_stock(arrivals: DataFrame, stock: str, log: str, refused: str, checkpoint: str, stream: str,
                     changes: int = balances.CHANGES):
    """Judge every micro-batch against the stock table in ``stock`` (``sources.balances``), of which it
    reads the buckets of its own products: neither the history nor the log is summed again.

    ``stream`` names this stream for good, also after its checkpoint moved. A micro-batch is written
    to its own folder of the log first and then booked in the table; one that was booked already is
    passed over, one that was cut off before is judged anew against the same stock.
    """
    spark = arrivals.sparkSession
    use_checkpoints(spark)

    def book(batch: DataFrame, number: int) -> None:
        if balances.applied(spark, stock, stream) >= number:
            return
        place = f"stream={stream}/number={number}"
        with stored_meanwhile(batch, "arrived") as rows:
            held = balances.held(spark, stock, rows)
            with stored_meanwhile(ledger.judge_held(ledger.validity(rows), held), "judged") as judged:
                passed = ledger.bookable(judged).where(ledger.no_problem(judged)).select(*batch.columns)
                passed.write.mode("overwrite").parquet(f"{log}/{place}")
                ledger.conflicts(judged).write.mode("overwrite").parquet(f"{refused}/{place}")
        balances.add(spark.read.schema(batch.schema).parquet(f"{log}/{place}"), stock, stream, number)
        balances.compact(spark, stock, changes)

    return (
        arrivals.writeStream.foreachBatch(book).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
