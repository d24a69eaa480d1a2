"""Column kinds of a raw sheet: by name first, by values for the rest, then typed casts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import columns_of
from shoptally.session import use_compiled_methods

VALUE_KINDS = ("phone", "date", "boolean", "numeric", "category")


def kind_by_name(name: str) -> str | None:
    """Kind whose word opens ``name`` (a leading underscore is allowed)."""
    for kind, words in K.KIND_WORDS.items():
        if kind == "date" and K.NOT_A_DATE_WORD in name.lower():
            continue
        if re.match(rf"_?(?:{'|'.join(words)})(?:_|$)", name, re.IGNORECASE):
            return kind
    return None


def value_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Detector ratios per column over its non-null values: one row per column.

    The values are first grouped by (column, value), so every detector runs once per distinct
    value, distinct counts are plain counts, and no group is larger than one value's copies.
    """
    pairs = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("v"))
            for n in names
        ])).alias("pair")
    ).select("pair.*").where(F.col("v").isNotNull())
    v, n = F.col("v"), F.col("n")
    values = pairs.groupBy("column_name", "v").agg(F.count("*").alias("n"))

    def share(flag: Column) -> Column:
        return F.sum(F.when(flag, n).otherwise(0)) / F.sum(n)

    return values.groupBy("column_name").agg(
        F.sum(n).alias("n_values"),
        F.count("*").alias("n_distinct"),
        F.count_distinct(F.lower(F.trim(v))).alias("n_folded"),
        share(F.lower(F.trim(v)).isin(*K.BOOLEAN_WORDS)).alias("boolean_share"),
        share(to_day(F.trim(v)).isNotNull()).alias("datetime_share"),
        share(v.rlike("[-/: ]")).alias("separator_share"),
        share(F.substr(v, F.lit(1), F.lit(1)).isin(*K.PHONE_FIRST_DIGITS)).alias("phone_share"),
        (F.sum(F.length(F.regexp_replace(v, r"[,\-\s]", "")) * n) / F.sum(n)).alias("phone_length"),
        share(v.try_cast("double").isNotNull()).alias("numeric_share"),
    )


def kind_by_value(profile: DataFrame, numeric: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, kind) from ``value_profile``; first matching detector wins.

    ``numeric`` names columns whose type is already numeric: those are never dates.
    """
    is_number = F.col("column_name").isin(*numeric) if numeric else F.lit(False)
    tests = {
        "phone": (F.col("phone_share") >= K.DETECT_RATIO)
        & F.col("phone_length").between(*K.PHONE_LENGTH),
        "date": ~is_number
        & (F.col("datetime_share") >= K.DETECT_RATIO)
        & (F.col("separator_share") >= K.DETECT_RATIO),
        "boolean": (F.col("boolean_share") >= K.DETECT_RATIO)
        & (F.col("n_folded") <= K.BOOLEAN_DISTINCT),
        "numeric": is_number | (F.col("numeric_share") >= K.DETECT_RATIO),
        "category": (F.col("numeric_share") <= K.NUMERIC_NOT_CATEGORY_RATIO)
        & F.col("n_distinct").between(*K.CATEGORY_DISTINCT),
    }
    kind = F.lit("string")
    for name in reversed(VALUE_KINDS):
        kind = F.when(tests[name], name).otherwise(kind)
    return profile.select("column_name", kind.alias("kind"))


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column. At most one job, which returns one row per undecided column."""
    found = {c: kind_by_name(c) for c in df.columns}
    pending = [c for c, k in found.items() if k is None]
    if pending:
        numeric = tuple(c for c in columns_of(df, "numeric") if c in pending)
        rows = kind_by_value(value_profile(df, pending), numeric).collect()
        by_value = {r["column_name"]: r["kind"] for r in rows}
        found.update({c: by_value.get(c, "string") for c in pending})
    return found


def to_day(text: Column) -> Column:
    """The day of a full date or date-time: year first or day first, with - or /; anything else is
    NULL. The detector of dates asks the same function, so it finds no date the cast would lose."""
    clock = r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    year_first = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + clock
    day_first = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})" + clock
    iso = F.when(text.rlike(year_first), F.regexp_replace(text, year_first, "$1-$2-$3")).when(
        text.rlike(day_first), F.regexp_replace(text, day_first, "$3-$2-$1")
    )
    return iso.try_cast("date")


def to_clock(text: Column) -> Column:
    """Time of day as ``HH:mm:ss`` text, seconds being optional; anything else is NULL."""
    short = F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(text, F.lit(":00")))
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), text).otherwise(short)


_AS_TEXT = ("string", "phone", "category")


def cast_by_kind(df: DataFrame, kind_of: dict[str, str]) -> DataFrame:
    """Typed columns, bad values as NULL; rows that end up all NULL are dropped."""
    use_compiled_methods(df.sparkSession)
    text = set(columns_of(df, "string"))
    casts = {}
    for name in df.columns:
        kind = kind_of[name]
        c = F.trim(F.col(name)) if name in text else F.col(name)
        if kind == "date":
            casts[name] = to_day(c) if name in text else c.cast("date")
        elif kind == "time":
            casts[name] = to_clock(c) if name in text else F.date_format(c, "HH:mm:ss")
        elif kind in ("price", "numeric", "revenue"):
            casts[name] = c.try_cast("double")
        elif kind == "boolean":
            casts[name] = c.try_cast("boolean")
        else:
            casts[name] = c.cast("string")
    typed = df.withColumns(casts)
    # plain text first: nearly every row passes on it, before any cast is tried. One expression,
    # and not an OR of many: the optimizer would infer every variant of it
    cheap_first = sorted(typed.columns, key=lambda c: kind_of[c] not in _AS_TEXT)
    return typed.where(F.coalesce(*[F.col(c).cast("string") for c in cheap_first]).isNotNull())
