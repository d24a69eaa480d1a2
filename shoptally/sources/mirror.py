"""A table that follows a folder of files: what was added, replaced or removed there since the last
look is added, replaced or removed here, and unchanged files are not opened again.

The manifest holds path, size and time of change of every file the table took, and the load that took
it. Rows lie in one folder per load with the file they came from. A look lists the folder (no content
is read), compares the lists in a join, reads the changed files only, and then commits a new manifest;
until then readers see the table as it was. A replaced or removed file leaves its rows in their old
load, where the manifest no longer names them. ``compact`` writes the valid rows anew.

What reaches the driver: the paths of changed files, which Spark's reader takes as a list, and the
names of loads. A file counts as replaced if its size or its time (in milliseconds) differs. An empty
or missing folder gives an empty table. Files of no bytes count as none, as Spark lists no such file. Paths must be free of the signs of path patterns (``*?[]{}``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptally.session import use_checkpoints
from shoptally.sources import versions

_STATE = "path string, uri string, length bigint, changed timestamp"
_ENTRY = f"{_STATE}, load string"
SOURCE = "source_file"


def state(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of every file below ``folder``."""
    if not versions.listed(spark, folder):
        return spark.createDataFrame([], _STATE)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return found.select(
        "path", F.col("_metadata.file_path").alias("uri"), "length", F.col("modificationTime").alias("changed"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Per path ``change``: new, replaced, vanished or same; ``length`` and ``changed`` as they are
    now, ``load`` as it was."""
    old = before.select("path", F.struct("length", "changed").alias("was"), "load")
    new = now.select("path", "uri", F.struct("length", "changed").alias("is"))
    kind = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "vanished")
        .when(F.col("was") == F.col("is"), "same").otherwise("replaced"))
    return old.join(new, "path", "full").select("path", "uri", "is.*", "load", kind.alias("change"))


def refresh(spark: SparkSession, folder: str, table: str, schema: T.StructType, fmt: str = "parquet"
            ) -> dict[str, int]:
    """Brings ``table`` up to date with ``folder``; the number of files per change. Without a change
    nothing is written."""
    use_checkpoints(spark)
    seen = changes(versions.entries(spark, table, _ENTRY), state(spark, folder)).checkpoint()
    counts = {r["change"]: r["count"] for r in seen.groupBy("change").count().collect()}
    if not set(counts) - {"same"}:
        return counts
    load = uuid.uuid4().hex
    stale = seen.where(F.col("change").isin("new", "replaced"))
    paths = [r["path"] for r in stale.select("path").toLocalIterator()]
    if paths:
        rows = spark.read.format(fmt).schema(schema).load(paths)
        rows.select("*", F.col("_metadata.file_path").alias(SOURCE)).write.parquet(f"{table}/rows/{load}")
    kept = seen.where(F.col("change") != "vanished")
    versions.commit(kept.select(
        "path", "uri", "length", "changed",
        F.when(F.col("change") == "same", F.col("load")).otherwise(load).alias("load")), table)
    return counts


def rows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table's valid rows, with ``source_file``: of every load the rows of files that the manifest
    names under it."""
    full = T.StructType([*schema.fields, T.StructField(SOURCE, T.StringType())])
    valid = versions.entries(spark, table, _ENTRY)
    out = spark.createDataFrame([], full)
    loads = [r["load"] for r in valid.select("load").distinct().collect()]
    for load in sorted(loads):
        mine = valid.where(F.col("load") == load).select(F.col("uri").alias(SOURCE))
        read = spark.read.schema(full).parquet(f"{table}/rows/{load}")
        out = out.unionByName(read.join(mine, SOURCE, "left_semi").select(*full.names))
    return out


def compact(spark: SparkSession, table: str, schema: T.StructType) -> str:
    """Writes the valid rows as one load, for tables of many loads; returns its name."""
    load = uuid.uuid4().hex
    rows(spark, table, schema).write.parquet(f"{table}/rows/{load}")
    versions.commit(versions.entries(spark, table, _ENTRY).withColumn("load", F.lit(load)), table)
    return load
