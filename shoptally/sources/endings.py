"""An index for searches by the ending of an id.

An ending is the beginning of the reversed id. The index keeps every row under its reversed id, in
ranges and sorted within each file, so a search is a prefix filter that the scan gets: files, row groups
and pages whose least and greatest value lie elsewhere are not read, where a filter on the id's ending
reads every row.

Rows with a NULL id are in no search and not kept. Ids that repeat come out as often as they occur. The
empty ending finds every row. Letters are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REVERSED = "_reversed"


def write(rows: DataFrame, key: str, folder: str) -> None:
    """Writes the index of ``rows`` by the column ``key``; it holds the whole rows, so give it the
    columns a search shows."""
    kept = rows.where(F.col(key).isNotNull()).withColumn(_REVERSED, F.reverse(F.col(key).cast("string")))
    kept.repartitionByRange(_REVERSED).sortWithinPartitions(_REVERSED).write.parquet(folder)


def search(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """Rows whose id ends with ``ending``."""
    found = spark.read.parquet(folder)
    if ending:
        found = found.where(F.col(_REVERSED).startswith(ending[::-1]))
    return found.drop(_REVERSED)
