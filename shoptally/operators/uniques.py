"""Exact distinct counts of whole-number ids per day, week and month from one pass over the facts.

Ids are kept as bitmaps: per day and column, one word of 64 bits for every 64 consecutive ids of which
one occurs. Words of one group merge before and after the shuffle, so there are never more of them than
(day, id) pairs, and up to 64 times fewer where a day's ids lie close together. A hot day or id costs no
task more than its own rows. Coarser counts merge the days' bitmaps and do not touch the facts again;
counts of days cannot be added up to them, as an id may occur on many days.

Words are plain numbers, so they are kept in hash maps. Wide bitmaps (4 KB) are not: most of a wide one is
empty where a day's ids are strewn over all ids, and the zeros, packed in the shuffle, fill a task.
NULL ids are not counted; a day with no other id counts 0. A NULL day is a group of its own. No facts,
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.calendar import start_of

GRAINS = {"d": "day", "w": "week", "mo": "month"}


def daily_bitmaps(facts: DataFrame, ids: list[str], day: str = "date") -> DataFrame:
    """(start, what, stretch, bits): the ids of each column in ``ids`` that occur on a day."""
    listed = [F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("id")) for c in ids]
    each = facts.select(F.col(day).alias("start"), F.inline(F.array(*listed)))
    bit = F.expr("shiftleft(1L, cast(id & 63 AS int))")
    return each.groupBy("start", "what", F.shiftright("id", 6).alias("stretch")).agg(F.bit_or(bit).alias("bits"))


def merged(bitmaps: DataFrame, unit: str) -> DataFrame:
    """Bitmaps of weeks or months from those of days."""
    return bitmaps.groupBy(start_of(F.col("start"), unit).alias("start"), "what", "stretch").agg(
        F.bit_or("bits").alias("bits"))


def counts(bitmaps: DataFrame, ids: list[str]) -> DataFrame:
    """(start, one distinct count per column of ``ids``)."""
    n = F.bit_count("bits")
    return bitmaps.groupBy("start").agg(*[
        F.coalesce(F.sum(F.when(F.col("what") == c, n)), F.lit(0)).alias(c) for c in ids])


def by_grain(bitmaps: DataFrame, ids: list[str]) -> DataFrame:
    """(grain, start, counts) for days, weeks and months of the same ``bitmaps``; months are merged
    from days, as weeks cross them."""
    out = None
    for unit, name in GRAINS.items():
        part = counts(bitmaps if unit == "d" else merged(bitmaps, unit), ids).select(
            F.lit(name).alias("grain"), "start", *ids)
        out = part if out is None else out.unionByName(part)
    return out
