"""Stock per (product, serial) kept as a table, so a batch need not sum the ledger.

The table is a base snapshot and the changes booked since, both divided into hash buckets of the
product. A manifest names the valid files of every bucket, and how far each stream has been applied;
a change counts from the moment its manifest is written, and an attempt that fails before leaves the
old version in force. A batch reads the buckets of its own products only. Buckets with many changes
are compacted into a new base; no other bucket is rewritten.

One writer at a time: of two that write the next manifest at once, one fails. Rows without a product
are not kept. A manifest holds at most a row per bucket and change since its compaction, and a row per
stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.operators.inventory import serial_balance
from shoptally.sources import versions

BUCKETS = 64
#: changes of one bucket before it is compacted
CHANGES = 8
_ENTRY = "kind string, bucket int, path string, stream string, number bigint"
_STOCK = "product_id string, serial string, stock bigint"


def manifest(spark: SparkSession, folder: str) -> tuple[int, list]:
    """Number and entries of the newest complete version."""
    version = versions.newest(spark, folder)
    if version is None:
        raise ValueError(f"no stock table in {folder}")
    return version, [tuple(r) for r in versions.entries(spark, folder, _ENTRY).collect()]


def _commit(spark: SparkSession, folder: str, entries: list) -> None:
    versions.commit(spark.createDataFrame(entries, _ENTRY).coalesce(1), folder)


def _buckets(spark: SparkSession, folder: str) -> int:
    return next(e[4] for e in manifest(spark, folder)[1] if e[0] == "buckets")


def _bucket(count: int):
    return F.pmod(F.xxhash64("product_id"), F.lit(count)).cast("int")


def _written(stock: DataFrame, folder: str, name: str, count: int) -> list:
    """Writes stock by bucket; the entries of the buckets that got rows."""
    spark, path = stock.sparkSession, f"{folder}/{name}-{uuid.uuid4().hex}"
    rows = stock.where(F.col("product_id").isNotNull()).select(
        F.col("product_id").cast("string"), F.col("serial").cast("string"), F.col("stock").cast("bigint"))
    rows.withColumn("bucket", _bucket(count)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    found = [int(n.removeprefix("bucket=")) for n in versions.listed(spark, path) if n.startswith("bucket=")]
    return [(name, b, f"{path}/bucket={b}", None, None) for b in sorted(found)]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], _STOCK)
    return spark.read.schema(_STOCK).parquet(*paths).groupBy("product_id", "serial").agg(F.sum("stock").alias("stock"))


def create(ledger: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """A table from a whole ledger: its first base."""
    base = _written(serial_balance(ledger), folder, "base", buckets)
    _commit(ledger.sparkSession, folder, [("buckets", None, None, None, buckets), *base])


def held(spark: SparkSession, folder: str, products: DataFrame) -> DataFrame:
    """Stock per (product, serial) of ``products`` (column ``product_id``), from their buckets. What
    reaches the driver is the numbers of the buckets."""
    _, entries = manifest(spark, folder)
    count = next(e[4] for e in entries if e[0] == "buckets")
    asked = products.where(F.col("product_id").isNotNull()).select("product_id").distinct()
    wanted = {r[0] for r in asked.select(_bucket(count)).distinct().collect()}
    stock = _read(spark, [e[2] for e in entries if e[0] in ("base", "change") and e[1] in wanted])
    return stock.join(asked, "product_id", "left_semi")


def whole(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, [e[2] for e in manifest(spark, folder)[1] if e[0] in ("base", "change")])


def applied(spark: SparkSession, folder: str, stream: str) -> int:
    """Number of the newest batch of a stream that the table holds; -1 for none."""
    return max((e[4] for e in manifest(spark, folder)[1] if e[0] == "applied" and e[3] == stream), default=-1)


def add(moves: DataFrame, folder: str, stream: str, number: int) -> bool:
    """Books batch ``number`` of a stream. A batch that the table holds already changes nothing."""
    spark = moves.sparkSession
    if applied(spark, folder, stream) >= number:
        return False
    _, entries = manifest(spark, folder)
    changes = _written(serial_balance(moves), folder, "change", _buckets(spark, folder))
    kept = [e for e in entries if (e[0], e[3]) != ("applied", stream)]
    _commit(spark, folder, [*kept, *changes, ("applied", None, None, stream, number)])
    return True


def compact(spark: SparkSession, folder: str, most: int = CHANGES) -> list[int]:
    """Gives every bucket with more than ``most`` changes a new base; returns those buckets."""
    _, entries = manifest(spark, folder)
    changes = [e[1] for e in entries if e[0] == "change"]
    full = sorted({b for b in changes if changes.count(b) > most})
    if full:
        mine = [e for e in entries if e[1] in full]
        base = _written(_read(spark, [e[2] for e in mine]), folder, "base", _buckets(spark, folder))
        _commit(spark, folder, [*[e for e in entries if e[1] not in full], *base])
    return full
