"""Numbered versions of a table's manifest: a version counts from the moment it is complete.

One writer at a time. A writer takes the number above every version that was begun, so an attempt
that fails half-way leaves the version before it in force and blocks nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``, on whatever file system it lies; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def begun(spark: SparkSession, folder: str) -> list[int]:
    names = listed(spark, f"{folder}/manifest")
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def newest(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version, None without one."""
    for version in reversed(begun(spark, folder)):
        if "_SUCCESS" in listed(spark, place(folder, version)):
            return version
    return None


def place(folder: str, version: int) -> str:
    return f"{folder}/manifest/version={version}"


def following(spark: SparkSession, folder: str) -> int:
    return max(begun(spark, folder), default=-1) + 1


def commit(entries: DataFrame, folder: str) -> int:
    """Writes ``entries`` as the next version and returns its number; fails if another writer took it."""
    version = following(entries.sparkSession, folder)
    entries.write.mode("errorifexists").json(place(folder, version))
    return version


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Entries of the newest complete version; none without one."""
    version = newest(spark, folder)
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(place(folder, version))
