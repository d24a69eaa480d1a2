"""Sales sheet cleaning: names, types, money repair, completeness report, calendar labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.calendar import month_key, week_label
from shoptally.functions.columns import all_of, any_of, ratio, round_even, sum_across
from shoptally.operators import kinds
from shoptally.session import stored


def rename_positional(df: DataFrame) -> DataFrame:
    """Names by position; columns past the known ones keep theirs."""
    known = K.SALES_COLUMNS[: len(df.columns)]
    return df.toDF(*known, *df.columns[len(known):])


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().replace(" ", "_").lower() for c in df.columns))


def categorise(df: DataFrame) -> DataFrame:
    named = normalise_names(df)
    return kinds.cast_by_kind(named, kinds.kinds(named))


def recover_money(target: str, by: str) -> Column:
    """``target`` (price or revenue), filled from ``by`` where it is NULL and ``by`` is positive."""
    if target == by:
        raise ValueError("recover_money needs two different columns")
    money, qty = F.col(target), F.col("qty")
    off = F.coalesce(F.col("disc_amount"), F.lit(0.0))
    kept_share = F.lit(1.0) - F.coalesce(F.col("disc_percent"), F.lit(0.0))
    paid = sum_across(K.PAYMENT_COLUMNS)
    source = {"price": F.col("price"), "revenue": F.col("revenue"), "payment": paid}[by]
    if by == "price":
        value = source * qty * kept_share - off
    elif target == "price":
        value = F.try_divide(source + off, kept_share * qty)
    else:
        value = source
    return F.when(money.isNull() & (source > 0), value).otherwise(money)


def _has_gap(df: DataFrame) -> Column:
    """Scalar: does any required column hold a NULL?"""
    gap = any_of(F.col(c).isNull() for c in K.REQUIRED_COLUMNS)
    return df.agg(F.coalesce(F.bool_or(gap), F.lit(False)).alias("gap")).scalar()


_KEEP = ("invoice", "ean", "qty", "staff")


def _keep() -> Column:
    return all_of(F.col(c).isNotNull() for c in _KEEP) & (F.col("qty") > 0)


def _repaired(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", recover_money("revenue", "payment")).withColumn(
        "price", recover_money("price", "revenue")
    )


def validate(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Drop rows beyond repair and refill money; a sheet without gaps passes unchanged.

    The check for gaps is a scalar subquery, so nothing runs before the caller's action.
    """
    gap = _has_gap(df)

    def unless_clean(condition: Column) -> Column:
        # CASE, not OR: the optimizer would expand the money formulas into normal form
        return F.when(gap, condition).otherwise(F.lit(True))

    fixed = _repaired(df.where(unless_clean(_keep())))
    whole = F.col("revenue").isNotNull() & F.col("price").isNotNull()
    fixed = fixed.where(unless_clean(whole))
    return fixed.orderBy("date", "invoice") if ordered else fixed


def completeness(df: DataFrame) -> DataFrame:
    """Share of filled values per required column before, after repair and at the end.

    One pass: the three stages are conditional counts over the same rows.
    """
    marked = df.select(
        *K.REQUIRED_COLUMNS,
        recover_money("revenue", "payment").alias("revenue_r"),
        *[F.col(c) for c in ("disc_amount", "disc_percent")],
        _keep().alias("kept"),
    )
    marked = marked.withColumn("revenue_0", F.col("revenue")).withColumn(
        "revenue", F.col("revenue_r")
    ).withColumn("price_r", recover_money("price", "revenue"))
    stages = {
        "before": (F.lit(True), {"revenue": "revenue_0"}),
        "repair": (F.col("kept"), {"price": "price_r"}),
        "final": (
            F.col("kept") & F.col("revenue").isNotNull() & F.col("price_r").isNotNull(),
            {"price": "price_r"},
        ),
    }
    counts = []
    for stage, (rows, renamed) in stages.items():
        counts.append(F.count_if(rows).alias(f"{stage}_length"))
        for c in K.REQUIRED_COLUMNS:
            source = F.col(renamed.get(c, c))
            counts.append(F.count_if(rows & source.isNull()).alias(f"{stage}_{c}"))
    one = marked.agg(*counts)

    def line(stage: str) -> Column:
        length = F.col(f"{stage}_length")
        filled = [
            round_even(F.abs(ratio(F.col(f"{stage}_{c}"), length) - F.lit(1.0)), 4)
            .alias(f"{c}_filled")
            for c in K.REQUIRED_COLUMNS
        ]
        return F.struct(F.lit(stage).alias("stage"), length.alias("length"), *filled)

    return one.select(F.explode(F.array(*[line(s) for s in stages])).alias("s")).select("s.*")


def add_calendar(df: DataFrame, *labels: str) -> DataFrame:
    made = {"week": week_label(F.col("date")), "month": month_key(F.col("date"))}
    return df.withColumns({name: made[name] for name in labels or made})


def clean_sheet(raw: DataFrame) -> DataFrame:
    """Raw text sheet to typed, repaired, labelled sales. The typed sheet is written once: the check for
    gaps, the bounds of the order and the rows themselves each read it."""
    typed = stored(raw.transform(rename_positional).transform(categorise), "typed")
    return typed.transform(validate).transform(add_calendar)


def scatter_points(df: DataFrame) -> DataFrame:
    """Plot points: ``[x, y]``, a pin from 20 on, size a third of y."""
    return df.select(
        F.array("x", "y").alias("value"),
        F.when(F.col("x") >= 20, "pin").otherwise("circle").alias("symbol"),
        F.rint(F.col("y") / F.lit(3.0)).alias("symbol_size"),
    )
