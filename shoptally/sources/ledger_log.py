"""The ledger as an append-only folder, one sub-folder per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally import constants as K


def next_batch_id(log: DataFrame) -> Column:
    """Scalar: one above the newest batch, or the first id of the sequence."""
    return log.agg(F.coalesce(F.max("batch_id") + 1, F.lit(K.FIRST_SEQUENCE_ID)).alias("id")
                   ).scalar()


def stamp(rows: DataFrame, log: DataFrame) -> DataFrame:
    return rows.withColumn("batch_id", next_batch_id(log).cast("bigint"))


def append(rows: DataFrame, folder: str, token: str) -> int:
    """Write one batch under the next free id, which is returned. ``token`` names the batch: a batch
    whose token is there already is not written again. Nothing is ever overwritten: of two writers
    that take the same id at once, one fails and may try again."""
    spark = rows.sparkSession
    newest = K.FIRST_SEQUENCE_ID - 1
    if exists(spark, folder):
        seen = read(spark, folder)
        row = seen.agg(F.max("batch_id").alias("newest"),
                       F.max(F.when(F.col("token") == token, F.col("batch_id"))).alias("mine")).first()
        if row["mine"] is not None:
            return row["mine"]
        newest = row["newest"] or newest
    batch_id = newest + 1
    rows.drop("batch_id", "token").withColumn("token", F.lit(token)).write.mode("errorifexists").parquet(
        f"{folder}/batch_id={batch_id}")
    return batch_id


def exists(spark: SparkSession, folder: str) -> bool:
    """Is there a batch in ``folder``, on whatever file system it lies?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(path) and len(files.listStatus(path)) > 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).withColumn("batch_id", F.col("batch_id").cast("bigint"))


def to_rows(payload: DataFrame, lists: list[str], keep: list[str]) -> DataFrame:
    """Parallel list columns to one row per position; ``keep`` columns are repeated."""
    zipped = payload.select(*keep, F.posexplode(F.arrays_zip(*lists)).alias("pos", "r"))
    return zipped.select(*keep, "pos", *[F.col(f"r.{c}").alias(c) for c in lists])


def to_lists(rows: DataFrame, keys: list[str], order: str, lists: list[str]) -> DataFrame:
    """Rows to parallel list columns per key, in ``order``, NULLs in place. The keys must bound
    the group (a cart, or a part from ``functions.parts``)."""
    packed = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(order, *lists))).alias("r"))
    return packed.select(*keys, *[f"r.{c}" for c in lists])
