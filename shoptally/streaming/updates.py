"""Sink and read-back for streams in update mode: each micro-batch writes the rows it changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def start(changes: DataFrame, folder: str, checkpoint: str):
    """Process what is there and stop. A repeated micro-batch replaces its own folder, so the log
    holds every change exactly once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _compacted(spark: SparkSession, folder: str) -> int:
    """The batch up to which the log is compacted; -1 for none."""
    root = f"{folder}/_compact"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    upto = [s.getPath().getName().removeprefix("upto=") for s in files.listStatus(path)] if files.exists(path) else []
    done = [int(u) for u in upto if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/upto={u}/_SUCCESS"))]
    return max(done, default=-1)


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Newest version of every key in the change log: its newest compaction and the batches since."""
    upto = _compacted(spark, folder)
    log = spark.read.parquet(folder).where(F.col("batch") > upto)
    if upto >= 0:
        log = log.unionByName(spark.read.parquet(f"{folder}/_compact/upto={upto}").withColumn("batch", F.lit(upto)))
    values = [c for c in log.columns if c not in (*keys, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def compact(spark: SparkSession, folder: str, keys: list[str]) -> int:
    """Writes the newest versions beside the log, so that ``latest`` reads no batch before; returns
    the batch up to which it goes. The folder's name starts with ``_``: readers of the log pass it."""
    upto = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    if upto is None or upto <= _compacted(spark, folder):
        return _compacted(spark, folder)
    latest(spark, folder, keys).write.mode("overwrite").parquet(f"{folder}/_compact/upto={upto}")
    return upto
