"""A table in hash buckets of its key, of which a change rewrites only the buckets it touches.

The manifest names one folder per bucket. ``change`` reads the buckets of the asked keys, edits them,
writes them beside the old ones and commits a manifest that names the new; a reader sees all of a change
or nothing of it, and an attempt that fails leaves the old version in force. ``hint("rebalance")`` lets
AQE split a large bucket over several files and tasks.

Rows with a NULL key form a bucket of their own, which no change reaches. The number of buckets is set
when the table is made, so that a bucket is a small multiple of what a task can hold; the manifest has
a row per bucket, and that is what reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.operators import ledger, upsert
from shoptally.session import use_checkpoints
from shoptally.sources import ledger_log, versions

BUCKETS = 64
_ENTRY = "bucket int, path string, key string, buckets int"


def _bucket(key: str, count: int) -> Column:
    number = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(count)).cast("int")
    return F.when(F.col(key).isNull(), count).otherwise(number)


def _written(rows: DataFrame, folder: str, key: str, count: int) -> dict[int, str]:
    """Writes rows by bucket; the folder of each bucket that got rows."""
    path = f"{folder}/rows/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(key, count)).hint("rebalance", F.col("_bucket")).write.partitionBy(
        "_bucket").parquet(path)
    names = [n for n in versions.listed(rows.sparkSession, path) if n.startswith("_bucket=")]
    return {int(n.removeprefix("_bucket=")): f"{path}/{n}" for n in names}


def _commit(spark: SparkSession, folder: str, places: dict[int, str], key: str, count: int) -> None:
    entries = [(b, p, key, count) for b, p in sorted(places.items())] or [(None, None, key, count)]
    versions.commit(spark.createDataFrame(entries, _ENTRY).coalesce(1), folder)


def _manifest(spark: SparkSession, folder: str) -> tuple[dict[int, str], str, int]:
    entries = versions.entries(spark, folder, _ENTRY).collect()
    if not entries:
        raise ValueError(f"no table in {folder}")
    return ({e["bucket"]: e["path"] for e in entries if e["bucket"] is not None},
            entries[0]["key"], entries[0]["buckets"])


def create(rows: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> None:
    """A new table of ``rows``, or a new version of the whole table."""
    spark = rows.sparkSession
    # the schema outlives a table without rows
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
    _commit(spark, folder, _written(rows, folder, key, buckets), key, buckets)


def _read(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/schema").schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def whole(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, [p for _, p in sorted(_manifest(spark, folder)[0].items())])


def _touched(keys: DataFrame, key: str, count: int) -> set[int]:
    found = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull())
    return {r[0] for r in found.select(_bucket(key, count)).distinct().collect()}


def held(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """All rows of the buckets that hold ``keys`` (a frame whose first column is the key)."""
    places, key, count = _manifest(spark, folder)
    asked = _touched(keys, key, count)
    return _read(spark, folder, [p for b, p in sorted(places.items()) if b in asked])


def change(spark: SparkSession, folder: str, keys: DataFrame, edit: Callable[[DataFrame], DataFrame]
           ) -> list[int]:
    """Replaces the buckets of ``keys`` by ``edit`` of their rows; returns their numbers. ``edit`` must
    keep the columns, and may add or drop rows with keys among ``keys`` only."""
    places, key, count = _manifest(spark, folder)
    asked = _touched(keys, key, count)
    if not asked:
        return []
    old = _read(spark, folder, [p for b, p in sorted(places.items()) if b in asked])
    new = _written(edit(old).select(*old.columns), folder, key, count)
    beyond = set(new) - asked
    if beyond:
        raise ValueError(f"the edit made rows of other keys (buckets {sorted(beyond)})")
    _commit(spark, folder, {b: p for b, p in places.items() if b not in asked} | new, key, count)
    return sorted(asked)


def cancel_orders(requested: DataFrame, orders: str, log: str, token: str) -> list[int]:
    """Cancels the requested orders (column ``id``) in the stored table ``orders``, and books what they
    sold back as a batch of the ledger ``log``.

    The batch is written first, under ``token``: if the attempt fails between the two, the repeated one
    finds the batch and only changes the orders."""
    spark = requested.sparkSession
    use_checkpoints(spark)
    ids = requested.select("id").distinct().checkpoint()
    _, back = ledger.cancel(ids, held(spark, orders, ids), ledger_log.read(spark, log))
    ledger_log.append(back, log, token)
    return change(spark, orders, ids, lambda rows: ledger.cancel(ids, rows, ledger_log.read(spark, log))[0])


def set_prices(prices: DataFrame, table: str) -> list[int]:
    """Applies new prices (``product_id``, ``new_price``; one row a product) to the stored price history:
    differing active prices retire, and products left without one get the new one. Columns a new row does not
    have are NULL."""
    spark = prices.sparkSession
    use_checkpoints(spark)
    asked = prices.checkpoint()

    def edit(rows: DataFrame) -> DataFrame:
        added = upsert.added_prices(rows, asked)
        return upsert.retire_prices(rows, asked).unionByName(added.select(*[
            F.col(c).cast(rows.schema[c].dataType) for c in added.columns]), allowMissingColumns=True)

    return change(spark, table, asked.select("product_id"), edit)
