"""Bounded parts of a group, for results that list a group's members in one array.

One invoice or product may hold a large share of all rows, and an array lives in one task. Every
member gets its position within the group, 0, 1, 2, ..., and every array holds ``limit`` positions:
part 0 the first ones, part 1 the next, at any size of the group. No member is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally.functions.running import running

PART_ROWS = 10_000


def with_positions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``pos``, dense within each group in ``order`` (unique within the group): a running count,
    so a hot group is spread over many tasks. A row without a key has no position."""
    counted = running(df, keys, [order], {"pos": F.lit(1)})
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return counted.withColumn("pos", F.when(known, F.col("pos") - 1))


def with_parts(df: DataFrame, keys: list[str], order: str, limit: int = PART_ROWS) -> DataFrame:
    """Adds ``part``: ``limit`` consecutive positions of a group have one part number."""
    part = F.coalesce(F.expr(f"pos div {limit}"), F.lit(0)).cast("bigint")
    return with_positions(df, keys, order).withColumn("part", part).drop("pos")


def in_order(rows: str) -> Column:
    """An array of structs sorted by their first field; an empty one is NULL. Fields are then
    lists of their own (``col("rows.field")``) with NULLs in place."""
    return F.when(F.size(rows) > 0, F.sort_array(rows)).alias(rows)
