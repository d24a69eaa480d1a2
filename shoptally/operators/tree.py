"""Hierarchy totals for every prefix of the layers, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.functions.columns import round_even, total
from shoptally.session import use_checkpoints

MISSING = "undefined"


def rollup(df: DataFrame, layers: list[str], values: list[str], sqrt: bool = False) -> DataFrame:
    """(level, path, name, value columns, share_pct). Level 0 is the grand total.

    Leaves are aggregated first, so the rollup expands leaves rather than facts. Missing layer
    names are one node, ``undefined``; NULL after that only marks a subtotal. ``sqrt`` evens out
    node sizes: the first value becomes its root and ``raw_value`` keeps the original.
    """
    if len(values) != len(set(values)):
        raise ValueError("value columns must differ")
    unknown = set(layers + values) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    named = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in layers], *values
    )
    use_checkpoints(df.sparkSession)
    # the rollup and the grand total read the leaves; the facts are read once
    leaves = named.groupBy(*layers).agg(*[total(v).alias(v) for v in values]).checkpoint()
    nodes = leaves.rollup(*layers).agg(
        *[total(v).alias(v) for v in values], F.grouping_id().alias("gid")
    )
    main = values[0]
    depth = F.lit(len(layers)) - F.bit_count("gid")
    grand = leaves.agg(total(main).cast("double").alias("all")).scalar()
    share = F.lit(100.0) * F.col(main).cast("double") / F.nullif(grand, F.lit(0.0))
    out = nodes.select(
        depth.cast("int").alias("level"),
        F.concat_ws(" / ", *layers).alias("path"),
        F.coalesce(*[F.col(c) for c in reversed(layers)], F.lit("Total")).alias("name"),
        *[F.col(v).cast("double").alias(v) for v in values],
        F.coalesce(round_even(share, 1), F.lit(0.0)).alias("share_pct"),
    )
    if sqrt:
        out = out.withColumn("raw_value", F.col(main)).withColumn(main, F.sqrt(main))
    return out
