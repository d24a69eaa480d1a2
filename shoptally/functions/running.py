"""Running sums per group, a hot group being spread over many tasks.

Rows are placed by ranges of (group, order), so a group of any size lies in consecutive ranges. Sums
run within each range; a range's first group may have begun in earlier ranges, and only for such
groups the totals of those ranges are carried in: at most one row per range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptally.session import stored

RANGE = "_range"


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with the number of each row's range of (``keys``, ``order``), as a written table, so a
    lost executor cannot change the ranges."""
    return stored(df.repartitionByRange(*keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def summed(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums over rows that ``placed`` has put into ranges; see ``running``."""
    amount = {name: f"_amount_{i}" for i, name in enumerate(sums)}
    here = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({amount[n]: F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    totals = within.groupBy(RANGE, *keys).agg(*[F.sum(a).alias(a) for a in amount.values()])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col(RANGE).alias("_into"), *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        *[F.sum(a).over(before).alias(f"_carried{a}") for a in amount.values()])
    carried = carried.where(F.col(f"_carried{next(iter(amount.values()))}").isNotNull())
    same = reduce(lambda a, b: a & b, [
        F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)])
    local = within.withColumns({n: F.sum(amount[n]).over(here) for n in sums})
    joined = local.join(F.broadcast(carried), (F.col(RANGE) == F.col("_into")) & same, "left")
    return joined.select(*rows.columns, *[
        (F.col(n) + F.coalesce(f"_carried{a}", F.lit(0))).alias(n) for n, a in amount.items()])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds every name of ``sums``: its column summed over the rows of the group up to and including
    this one. ``order`` is unique within a group. NULL keys are a group; NULL amounts count as 0."""
    return summed(placed(df, keys, order), keys, order, sums).drop(RANGE)
