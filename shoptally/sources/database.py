"""Reads of the store tables over JDBC, split by a numeric key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "product", "orders", "staff", "item", "price", "payment", "stock_ledger")


def read_table(spark: SparkSession, url: str, name: str, *, split_on: str | None = None,
               low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """``low`` and ``high`` only set the stride of the split; rows outside are read as well."""
    if name not in TABLES:
        raise ValueError(f"no store table {name!r}")
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if split_on:
        reader = reader.options(partitionColumn=split_on, lowerBound=str(low),
                                upperBound=str(high), numPartitions=str(parts))
    return reader.load()
