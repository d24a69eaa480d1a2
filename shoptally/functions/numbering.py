"""Consecutive ids without pulling rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptally.session import use_checkpoints

_ROW_BITS = 33  # layout of monotonically_increasing_id: partition above, row below


def numbered(df: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Adds ``name`` = ``start``, ``start + 1``, ... in ``order`` (a unique key).

    Range partitions are sorted and written once (checkpoint), so a lost executor cannot change
    which rows a partition holds; the offsets are one row per partition.
    """
    use_checkpoints(df.sparkSession)
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id()).checkpoint()
    )
    slot = placed.withColumn("_p", F.shiftright("_slot", _ROW_BITS))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot.groupBy("_p").count().select(
        "_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    row = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        slot.join(F.broadcast(offsets), "_p")
        .withColumn(name, F.lit(start) + F.col("_before") + row)
        .drop("_p", "_slot", "_before")
    )
