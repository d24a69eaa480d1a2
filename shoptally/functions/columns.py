"""Small column helpers: text tidying, NULL-aware sums and counts, ratios, rounding."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tidy(c: Column) -> Column:
    """Trimmed text, with blank text as NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def tidy_strings(df: DataFrame) -> DataFrame:
    """``tidy`` on every string column."""
    return df.withColumns({c: tidy(F.col(c)) for c in columns_of(df, "string")})


def columns_of(df: DataFrame, family: str) -> list[str]:
    """Names of the ``string`` / ``numeric`` / ``temporal`` columns, in schema order."""
    families = {
        "string": (T.StringType,),
        "numeric": (T.NumericType,),
        "temporal": (T.DateType, T.TimestampType, T.TimestampNTZType),
    }[family]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, families)]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def join_key(key: str, *spread_by: str) -> Column:
    """``key`` as text for the left side of an outer join. NULL keys match nothing, yet all would
    be sent to one task: they become values of their own, spread by the given columns."""
    aside = F.concat(F.lit("\u0000"), F.xxhash64(*spread_by).cast("string"))
    return F.coalesce(F.col(key).cast("string"), aside)


def sum_across(names: Iterable[str]) -> Column:
    """Sum of columns in one row, NULL as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(n), F.lit(0)) for n in names))


def total(c) -> Column:
    """Sum in which no rows, or only NULLs, give 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def distinct_with_null(c) -> Column:
    """Number of distinct values, NULL being one of them."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` in doubles; NULL where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_even(c: Column, digits: int) -> Column:
    """Round a double, ties to even."""
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def fixed(c: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded by the exact binary value of the double.

    Java's own formatter rounds the shortest decimal text instead (11.45 to 11.5, although the
    double is just below 11.45). The double is split in two halves whose products with a small
    integer are exact, which tells on which side of the midpoint it lies.
    """
    scale = float(10**digits)
    below = F.floor(c * F.lit(scale)).cast("double")
    upper = c * F.lit(134217729.0) - (c * F.lit(134217729.0) - c)  # 2^27 + 1: upper half
    doubled = F.lit(2.0 * scale)
    side = (upper * doubled - (below * 2.0 + 1.0)) + (c - upper) * doubled
    up = (side > 0) | ((side == 0) & (F.pmod(below, F.lit(2.0)) == 1.0))
    return F.format_string(
        f"%.{digits}f", F.when(up, below + 1.0).otherwise(below) / F.lit(scale))


def humanise(c: Column, pct: bool = False) -> Column:
    """Short display text: B, M, k, whole, two digits; or a percentage."""
    if pct:
        shown = F.when(c <= 1, c * F.lit(100.0)).otherwise(c)
        return F.concat(fixed(shown, 1), F.lit("%"))

    def short(unit: float, digits: int, suffix: str) -> Column:
        return F.concat(fixed(c / F.lit(unit), digits), F.lit(suffix))

    return (
        F.when(c >= 1e9, short(1e9, 2, "B")).when(c >= 1e6, short(1e6, 2, "M"))
        .when(c >= 1e3, short(1e3, 1, "k")).when(c >= 10, fixed(c, 0)).otherwise(fixed(c, 2))
    )
