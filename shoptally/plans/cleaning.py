"""Cleaning of the sales sheet: names, kinds, casts, money repair, completeness, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import columns_of, tidy_strings
from shoptally.operators import clean, kinds
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.session import shared_folder, shuffles_removed
from shoptally.sources import files
from shoptally.sources import warehouse as W

RAW_CELLS = [
    "CASE WHEN l_linenumber = 3 AND p_size = 9 THEN 'n/a' WHEN l_linenumber = 2 "
    "THEN strftime(o_orderdate, '%d/%m/%Y') ELSE concat(' ', strftime(o_orderdate, '%Y-%m-%d')) END",
    "CAST(l_orderkey AS VARCHAR)",
    "CASE WHEN l_suppkey % 53 <> 0 THEN concat('Staff_', CAST(l_suppkey % 10 AS VARCHAR), ' ') END",
    "CAST(8930000000000 + l_partkey AS VARCHAR)", "p_type",
    "CASE WHEN l_linenumber = 1 THEN concat('SN', CAST(l_orderkey AS VARCHAR)) END",
    "CAST(l_partkey AS VARCHAR)", "concat(' ', p_name, ' ')",
    "CASE WHEN l_linenumber = 4 AND p_size < 10 THEN 'abc' WHEN l_linenumber <> 5 "
    "THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END",
    "CASE WHEN l_linenumber = 6 THEN '0' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END",
    "CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR)", "CAST(NULL AS VARCHAR)",
    f"CASE WHEN l_linenumber <> 4 AND l_linenumber <> 2 THEN CAST({V.NET} AS VARCHAR) END",
    f"CASE WHEN o_orderpriority = '1-URGENT' THEN CAST({V.NET} AS VARCHAR) END",
    f"CASE WHEN o_orderpriority = '2-HIGH' THEN CAST({V.NET} AS VARCHAR) END",
    *["CAST(NULL AS VARCHAR)"] * 5,
    "CASE WHEN p_size < 40 THEN concat('c', CAST(o_custkey AS VARCHAR), '@shop.example') END",
    "concat('Customer ', CAST(o_custkey AS VARCHAR))",
    "concat('09', lpad(CAST(o_custkey AS VARCHAR), 8, '0'))",
    "CASE WHEN l_linenumber = 7 THEN '25:99' ELSE '08:30:00' END",
    "CAST(50 + 3 * day(o_orderdate) AS VARCHAR)",
    "CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'No' END",
    "CASE WHEN p_size <= 45 THEN p_brand END",
    "CASE WHEN l_linenumber = 1 THEN 'Gift wrap' END",
    "CASE WHEN l_linenumber = 2 THEN strftime(o_orderdate, '%d/%m/%Y 17:05') "
    "ELSE strftime(o_orderdate, '%Y-%m-%d 08:30:00') END",
]
RAW_NAMES = [*K.SALES_COLUMNS, "extra_note", "seen_at"]
RAW = ("SELECT " + ", ".join(
    f'CASE WHEN NOT (l_returnflag = \'N\' AND l_linenumber = 7) THEN {c} END AS "{n}"'
    for c, n in zip(RAW_CELLS, RAW_NAMES))
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
NUMBERS = {"price", "qty", "disc_percent", "disc_amount", "revenue", "cash", "card", "payoo",
           "banking", "mkt_promo", "vnpay", "trade_in", "date_traffic"}


def _day(c: str) -> str:
    """The day of a date or date-time in either form."""
    return (f"CASE WHEN regexp_full_match({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}( \\d{{2}}:\\d{{2}}:\\d{{2}})?') "
            f"THEN TRY_CAST(substr({c}, 1, 10) AS DATE) "
            f"WHEN regexp_full_match({c}, '\\d{{2}}/\\d{{2}}/\\d{{4}}( \\d{{2}}:\\d{{2}})?') "
            f"THEN CAST(try_strptime(substr({c}, 1, 10), '%d/%m/%Y') AS DATE) END")


def _typed(name: str) -> str:
    c = f'trim("{name}")'
    if name in ("date", "seen_at"):
        return _day(c)
    if name == "time":
        return f"CASE WHEN regexp_full_match({c}, '([01]\\d|2[0-3]):[0-5]\\d:[0-5]\\d') THEN {c} END"
    if name in NUMBERS:
        return f"TRY_CAST({c} AS DOUBLE)"
    if name == "event_name":
        return f"lower({c}) = 'yes' OR (CASE WHEN {c} IS NULL THEN NULL ELSE FALSE END)"
    return c


RAW_VIEWS = {
    "raw": RAW,
    "typed": "SELECT " + ", ".join(f'{_typed(n)} AS "{n}"' for n in RAW_NAMES)
             + ' FROM raw WHERE invoice IS NOT NULL',
}
TYPED_OUT = ["date", "invoice", "staff", "product_name", "price", "qty", "disc_percent", "revenue",
             "cash", "email", "id", "time", "date_traffic", "event_name", "sub_cat", "extra_note",
             "seen_at"]


@query("C1 C2", V.sql("", "SELECT date, invoice, product_name, sub_cat, extra_note FROM raw", raw=RAW))
def sheet_renamed(spark, d):
    named = clean.normalise_names(clean.rename_positional(W.raw_sheet(spark, d)))
    return named.select("date", "invoice", "product_name", "sub_cat", "extra_note")


KIND_OF = {
    "date": "date", "invoice": "string", "staff": "category", "ean": "string", "cat": "category",
    "lot_number": "string", "sku": "string", "product_name": "string", "price": "price",
    "qty": "numeric", "disc_percent": "numeric", "disc_amount": "numeric", "revenue": "revenue",
    "cash": "numeric", "card": "numeric", "payoo": "numeric", "banking": "numeric",
    "mkt_promo": "numeric", "vnpay": "numeric", "trade_in": "numeric", "email": "string",
    "name": "string", "id": "phone", "time": "time", "date_traffic": "numeric",
    "event_name": "boolean", "sub_cat": "category", "extra_note": "string",
    "seen_at": "date",
}


def named_sheet(spark, d) -> DataFrame:
    return clean.normalise_names(clean.rename_positional(W.raw_sheet(spark, d)))


@query("C3 C4", "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{k}')" for c, k in KIND_OF.items()) + ") AS t(column_name, kind)")
def sheet_column_kinds(spark, d):
    """Kind of every column: by name where the name tells, by the values of the whole column
    otherwise."""
    named = named_sheet(spark, d)
    by_name = {c: kinds.kind_by_name(c) for c in named.columns}
    pending = [c for c, k in by_name.items() if k is None]
    by_value = kinds.kind_by_value(kinds.value_profile(named, pending))
    known = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"))
        for c, k in by_name.items() if k]))
    return spark.range(1).select(known.alias("k")).select("k.*").unionByName(by_value)


def _profile_sql(c: str) -> str:
    def share(flag: str) -> str:
        return f"CAST(count(*) FILTER (WHERE {flag}) AS DOUBLE) / count(*)"

    v = f'"{c}"'
    return (f"SELECT '{c}' AS column_name, count(*) AS n_values, count(DISTINCT {v}) AS n_distinct, "
            f"count(DISTINCT lower(trim({v}))) AS n_folded, "
            f"{share(f'''lower(trim({v})) IN ('true', 'false', 'yes', 'no', '1', '0')''')} AS boolean_share, "
            f"{share(_day(f'trim({v})') + ' IS NOT NULL')} AS datetime_share, "
            f"{share(f'''regexp_matches({v}, '[-/: ]')''')} AS separator_share, "
            f"{share(f'''substr({v}, 1, 1) IN ('0', '3', '5', '7', '8', '9')''')} AS phone_share, "
            f"CAST(sum(length(regexp_replace({v}, '[,\\-\\s]', '', 'g'))) AS DOUBLE) / count(*) AS phone_length, "
            f"{share(f'TRY_CAST({v} AS DOUBLE) IS NOT NULL')} AS numeric_share FROM raw WHERE {v} IS NOT NULL")


PENDING = ["staff", "lot_number", "product_name", "email", "date_traffic", "event_name", "sub_cat", "id",
           "seen_at"]


@query("C4 C4a C4b C4c C4d C4e", V.sql("", " UNION ALL ".join(_profile_sql(c) for c in PENDING), raw=RAW))
def sheet_value_profile(spark, d):
    return kinds.value_profile(named_sheet(spark, d), PENDING)


def typed_sheet(spark, d) -> DataFrame:
    return kinds.cast_by_kind(named_sheet(spark, d), KIND_OF)


@query("C5 C6 X1", V.sql("", "SELECT " + ", ".join(TYPED_OUT) + " FROM typed", **RAW_VIEWS))
def sheet_typed(spark, d):
    """Typed by the kinds found in the data; all-NULL rows are gone."""
    return clean.categorise(clean.rename_positional(W.raw_sheet(spark, d))).select(*TYPED_OUT)


PAID = "coalesce(cash, 0) + coalesce(card, 0)"
KEPT = "(1.0E0 - coalesce(disc_percent, 0.0E0))"
OFF = "coalesce(disc_amount, 0.0E0)"
REVENUE_BY_PAYMENT = f"CASE WHEN revenue IS NULL AND {PAID} > 0 THEN {PAID} ELSE revenue END"
PRICE_BY_REVENUE = (f"CASE WHEN price IS NULL AND revenue > 0 THEN (revenue + {OFF}) / nullif({KEPT} * qty, 0) "
                    "ELSE price END")


@query("C7 X12", V.sql("dirty", f"""
SELECT invoice, line, ean, supplier, {REVENUE_BY_PAYMENT} AS revenue_by_payment,
  CASE WHEN revenue IS NULL AND price > 0 THEN price * qty * {KEPT} - {OFF} ELSE revenue END AS revenue_by_price,
  {PRICE_BY_REVENUE} AS price_by_revenue,
  CASE WHEN price IS NULL AND {PAID} > 0 THEN ({PAID} + {OFF}) / nullif({KEPT} * qty, 0) ELSE price END
  AS price_by_payment FROM dirty"""))
def money_recovered(spark, d):
    pairs = [("revenue", "payment"), ("revenue", "price"), ("price", "revenue"), ("price", "payment")]
    return W.dirty_sales(spark, d).select(
        "invoice", "line", "ean", "supplier",
        *[clean.recover_money(t, by).alias(f"{t}_by_{by}") for t, by in pairs])


REPAIR = {
    "kept": "SELECT * FROM dirty WHERE invoice IS NOT NULL AND ean IS NOT NULL AND qty > 0 AND staff IS NOT NULL",
    "paid": f"SELECT * REPLACE ({REVENUE_BY_PAYMENT} AS revenue) FROM kept",
    "repaired": f"SELECT * REPLACE ({PRICE_BY_REVENUE} AS price) FROM paid",
    "final": "SELECT * FROM repaired WHERE revenue IS NOT NULL AND price IS NOT NULL",
}


@query("C8 O1", V.sql("dirty", "SELECT date, invoice, line, ean, supplier, staff, qty, price, revenue FROM final",
                      **REPAIR))
def sales_validated(spark, d):
    return clean.validate(W.dirty_sales(spark, d)).select(
        "date", "invoice", "line", "ean", "supplier", "staff", "qty", "price", "revenue")


def _filled(stage: str, view: str) -> str:
    shares = ", ".join(
        V.round_even(f"abs(CAST(count(*) - count({c}) AS DOUBLE) / count(*) - 1.0E0)", 4) + f" AS {c}_filled"
        for c in K.REQUIRED_COLUMNS)
    return f"SELECT '{stage}' AS stage, count(*) AS length, {shares} FROM {view}"


@query("C9 U1 A18", V.sql("dirty", " UNION ALL ".join(
    [_filled("before", "dirty"), _filled("repair", "repaired"), _filled("final", "final")]), **REPAIR))
def sales_completeness(spark, d):
    return clean.completeness(W.dirty_sales(spark, d))


@query("C10 X5 X6", f"SELECT o_orderkey AS id, {V.week_label('CAST(o_orderdate AS DATE)')} AS week, "
                    "strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def calendar_labels(spark, d):
    days = W.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    return clean.add_calendar(days).drop("date")


@query("C12 X3", V.sql("", "SELECT nullif(trim(staff), '') AS staff, nullif(trim(product_name), '') AS product_name, "
                       "nullif(trim(lot_number), '') AS lot_number, invoice FROM raw", raw=RAW))
def text_tidied(spark, d):
    return tidy_strings(named_sheet(spark, d).select("staff", "product_name", "lot_number", "invoice"))


@query("C13", V.sql("", "SELECT invoice, CAST(floor(TRY_CAST(price AS DOUBLE)) AS BIGINT) AS price FROM typed",
                    **RAW_VIEWS))
def prices_as_whole_numbers(spark, d):
    return typed_sheet(spark, d).select("invoice", F.floor("price").cast("bigint").alias("price"))


NUMERIC = ["invoice", "line", "ean", "supplier", "qty"]


@query("C14 U5", V.sql("dirty", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(sum({c}) AS BIGINT) AS total FROM base" for c in NUMERIC),
    base=f"SELECT date, staff, {', '.join(NUMERIC)} FROM dirty"))
def numeric_columns_summed(spark, d):
    """Columns picked by type from a mixed frame."""
    rows = W.dirty_sales(spark, d).select("date", "staff", *NUMERIC)
    picked = columns_of(rows, "numeric")
    sums = rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in picked])
    return sums.unpivot([], picked, "column_name", "total")


@query("C15 X14", "SELECT concat(CAST(l_partkey AS VARCHAR), '|', CAST(l_suppkey AS VARCHAR)) AS value, "
                  "CASE WHEN l_partkey >= 20 THEN 'pin' ELSE 'circle' END AS symbol, "
                  "round_even(CAST(l_suppkey AS DOUBLE) / 3.0E0, 0) AS symbol_size FROM lineitem")
def scatter_points(spark, d):
    xy = W.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    points = clean.scatter_points(xy)
    return points.withColumn("value", F.array_join(F.col("value").cast("array<string>"), "|"))


CLEANED = {
    **RAW_VIEWS,
    "dirty": "SELECT * FROM typed",
    "kept": "SELECT * FROM dirty WHERE invoice IS NOT NULL AND ean IS NOT NULL AND qty > 0 AND staff IS NOT NULL",
    "paid": f"SELECT * REPLACE ({REVENUE_BY_PAYMENT} AS revenue) FROM kept",
    "repaired": f"SELECT * REPLACE ({PRICE_BY_REVENUE} AS price) FROM paid",
    "final": "SELECT * FROM repaired WHERE revenue IS NOT NULL AND price IS NOT NULL",
}
CLEANED_SQL = V.sql("", f"""
SELECT date, invoice, staff, sku, qty, price, revenue, CASE WHEN date IS NOT NULL THEN {V.week_label('date')} END AS week,
       strftime(date, '%Y-%m') AS month FROM final""", **CLEANED)
CLEANED_OUT = ["date", "invoice", "staff", "sku", "qty", "price", "revenue", "week", "month"]


@query("S1 S2 C1 C2 C3 C4 C5 C6 C7 C8 C10", CLEANED_SQL)
def sheet_cleaned_from_csv(spark, d):
    """The sheet written as CSV, read back as text, and cleaned from end to end."""
    folder = shared_folder(spark, "sheet")
    sheet = W.raw_sheet(spark, d)
    with shuffles_removed(spark):
        # a compressed file is read by one task: none gets more than a million rows
        sheet.write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", 1_000_000).csv(folder)
        cleaned = clean.clean_sheet(files.sheet(spark, folder, sheet.columns))
    return cleaned.select(*CLEANED_OUT)
