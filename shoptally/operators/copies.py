"""Rows that share a key with other rows. Keys are counted first and joined back, so copies of a
hot key are never sorted into one window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import join_key


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-null values of ``key`` that occur more than once."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
        .where(F.col("_n") > 1).select(key)
    )


def mark_all_copies(df: DataFrame, key: str, flag: str) -> DataFrame:
    """``flag`` is true on every row whose key occurs more than once; a NULL key never is."""
    found = repeated_keys(df, key).select(
        F.col(key).cast("string").alias("_key"), F.lit(True).alias("_dup"))
    return df.join(found, join_key(key, *df.columns) == F.col("_key"), "left").withColumn(
        flag, F.coalesce("_dup", F.lit(False))).drop("_key", "_dup")


def mark_later_copies(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """``flag`` is true on every row but the first of its key (by ``order``, unique per row).

    NULL keys form one group, as any other value does.
    """
    place = F.struct(*order)
    firsts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("_key")).agg(
        F.min(place).alias("_first"))
    # most keys may be NULL: their first row is a one-row scalar, and they spread over all tasks
    nothing = df.where(F.col(key).isNull()).agg(F.min(place).alias("_none")).scalar()
    first = F.when(F.col(key).isNull(), nothing).otherwise(F.col("_first"))
    return df.join(firsts, join_key(key, *df.columns) == F.col("_key"), "left").withColumn(
        flag, place != first).drop("_key", "_first")
