"""Scalar functions, order and limit rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoptally.functions import rules
from shoptally.functions.calendar import axis_label, shift, start_of
from shoptally.functions.columns import all_of, any_of, humanise, ratio, round_even, sum_across
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.plans.stock import STRICT, money
from shoptally.plans.pos import goods
from shoptally.sources import warehouse as W


@query("X1", r"""
SELECT p_partkey, upper(p_name) AS upper_name, lower(p_brand) AS lower_brand, length(p_name) AS name_length,
       substr(p_name, 1, 3) AS head, starts_with(p_name, 'red') AS is_red, ends_with(p_name, 'bolt') AS is_bolt,
       split_part(p_brand, '#', 2) AS brand_no, regexp_replace(p_brand, '\d+', 'N') AS brand_form,
       regexp_matches(p_name, '^[a-m]') AS early FROM part""")
def text_functions(spark, d):
    name, brand = F.col("p_name"), F.col("p_brand")
    return W.table(spark, d, "part").select(
        "p_partkey", F.upper(name).alias("upper_name"), F.lower(brand).alias("lower_brand"),
        F.length(name).cast("bigint").alias("name_length"), F.substr(name, F.lit(1), F.lit(3)).alias("head"),
        name.startswith("red").alias("is_red"), name.endswith("bolt").alias("is_bolt"),
        F.split(brand, "#")[1].alias("brand_no"), F.regexp_replace(brand, r"\d+", "N").alias("brand_form"),
        name.rlike("^[a-m]").alias("early"))


@query("X2", r"""
SELECT c_custkey, mail, regexp_full_match(lower(mail), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') AS valid FROM (
  SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN concat(c_mktsegment, '@Shop.Example')
    WHEN 1 THEN concat(c_mktsegment, ' @shop.example') WHEN 2 THEN 'a.b+c@x.io' ELSE concat(c_name, '@x.io') END
  AS mail FROM customer)""")
def email_forms(spark, d):
    nation = F.col("c_nationkey") % 4
    mail = (
        F.when(nation == 0, F.concat("c_mktsegment", F.lit("@Shop.Example")))
        .when(nation == 1, F.concat("c_mktsegment", F.lit(" @shop.example")))
        .when(nation == 2, "a.b+c@x.io").otherwise(F.concat("c_name", F.lit("@x.io")))
    )
    return W.table(spark, d, "customer").select(
        "c_custkey", mail.alias("mail"), rules.valid_email(mail).alias("valid"))


@query("X3", V.sql("ledger", "SELECT product_id, coalesce(nullif(serial, ''), 'loose') AS serial, count(*) AS n "
                   "FROM ledger GROUP BY ALL"))
def null_functions(spark, d):
    serial = F.coalesce(F.nullif("serial", F.lit("")), F.lit("loose"))
    return W.ledger(spark, d).groupBy("product_id", serial.alias("serial")).agg(F.count("*").alias("n"))


@query("X4 X5", """
SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS month_back,
       CAST(CAST(o_orderdate AS DATE) - INTERVAL 21 DAY AS DATE) AS weeks_back,
       CAST(o_orderdate AS DATE) - 5 AS days_back, week(o_orderdate) AS iso_week,
       day(last_day(o_orderdate)) AS month_days, strftime(o_orderdate, '%B') AS month_name FROM orders""")
def date_functions(spark, d):
    day = F.to_date("o_orderdate")
    return W.table(spark, d, "orders").select(
        "o_orderkey", start_of(day, "w").alias("monday"), start_of(day, "mo").alias("month_start"),
        shift(day, -1, "mo").alias("month_back"), shift(day, -3, "w").alias("weeks_back"),
        shift(day, -5, "d").alias("days_back"), F.weekofyear(day).cast("bigint").alias("iso_week"),
        F.dayofmonth(F.last_day(day)).cast("bigint").alias("month_days"),
        F.date_format(day, "MMMM").alias("month_name"))


DAY = "CAST(o_orderdate AS DATE)"


@query("X6", f"SELECT o_orderkey, {V.axis_label(DAY, '1d')} AS day_label, {V.axis_label(DAY, '1w')} AS week_label, "
             f"{V.axis_label(DAY, '1mo')} AS month_label FROM orders")
def axis_labels(spark, d):
    day = F.to_date("o_orderdate")
    return W.table(spark, d, "orders").select("o_orderkey", *[
        axis_label(day, v).alias(n)
        for v, n in (("1d", "day_label"), ("1w", "week_label"), ("1mo", "month_label"))])


@query("X8", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {V.round_even('CAST(l_partkey AS DOUBLE) / nullif(CAST(l_suppkey % 8 AS DOUBLE), 0)', 2)} AS share,
       abs(l_suppkey - l_partkey) AS gap, sqrt(CAST(l_partkey AS DOUBLE)) AS root,
       least(greatest(l_partkey, 10), 1000) AS clamped FROM lineitem""")
def number_functions(spark, d):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return W.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        round_even(ratio(part, supp % 8), 2).alias("share"), F.abs(supp - part).alias("gap"),
        F.sqrt(part.cast("double")).alias("root"),
        F.least(F.greatest(part, F.lit(10)), F.lit(1000)).alias("clamped"))


@query("X9", """
SELECT p_partkey, CASE WHEN x >= 1e9 THEN printf('%.2fB', x / 1e9) WHEN x >= 1e6 THEN printf('%.2fM', x / 1e6)
  WHEN x >= 1e3 THEN printf('%.1fk', x / 1e3) WHEN x >= 10 THEN printf('%.0f', x) ELSE printf('%.2f', x) END AS shown,
  CASE WHEN p_size < 2 THEN printf('%.1f%%', p_size * 100.0E0) ELSE printf('%.1f%%', CAST(p_size AS DOUBLE)) END AS pct
FROM (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN p_size * 1e8 + p_partkey * 1e6 WHEN 1 THEN p_partkey * 1e4 + 7e3
  WHEN 2 THEN p_partkey * 10 + 1000.0E0 WHEN 3 THEN p_size * 1.0E0 ELSE p_size / 64.0E0 END AS x FROM part)""")
def short_numbers(spark, d):
    size, part = F.col("p_size"), F.col("p_partkey")
    x = (
        F.when(size % 5 == 0, size * 1e8 + part * 1e6).when(size % 5 == 1, part * 1e4 + 7e3)
        .when(size % 5 == 2, part * 10 + 1000.0).when(size % 5 == 3, size * 1.0).otherwise(size / 64.0)
    )
    return W.table(spark, d, "part").select(
        "p_partkey", humanise(x).alias("shown"), humanise(size.cast("double"), pct=True).alias("pct"))


@query("X12", V.sql("dirty", """
SELECT invoice, line, ean, supplier, staff IS NULL OR qty IS NULL OR price IS NULL OR revenue IS NULL AS any_gap,
       staff IS NULL AND price IS NULL AS both_gaps, coalesce(cash, 0) + coalesce(card, 0) AS paid FROM dirty"""))
def across_columns(spark, d):
    def gaps(*names):
        return (F.col(n).isNull() for n in names)

    return W.dirty_sales(spark, d).select(
        "invoice", "line", "ean", "supplier", any_of(gaps("staff", "qty", "price", "revenue")).alias("any_gap"),
        all_of(gaps("staff", "price")).alias("both_gaps"), sum_across(("cash", "card")).alias("paid"))


@query("O4", """
SELECT name, n, CASE WHEN upper(name) LIKE 'ALL%' THEN 0 WHEN upper(name) LIKE 'IPH%' THEN 1
  WHEN upper(name) LIKE 'IPA%' OR upper(name) LIKE 'MAC%' OR upper(name) LIKE 'WAT%' THEN 2
  WHEN upper(name) LIKE 'A%' THEN 4 WHEN regexp_matches(name, '^[A-Za-z]') THEN 3 ELSE 5 END AS place
FROM (SELECT CASE p_size % 8 WHEN 0 THEN 'All Cat' WHEN 1 THEN concat('iPhone ', p_name) WHEN 2 THEN 'iPad'
  WHEN 3 THEN 'mac mini' WHEN 4 THEN 'Watch' WHEN 5 THEN concat('Accessory ', p_name) WHEN 6 THEN '9x'
  ELSE p_type END AS name, count(*) AS n FROM part GROUP BY 1)""")
def category_order(spark, d):
    size = F.col("p_size") % 8
    name = (
        F.when(size == 0, "All Cat").when(size == 1, F.concat(F.lit("iPhone "), "p_name"))
        .when(size == 2, "iPad").when(size == 3, "mac mini").when(size == 4, "Watch")
        .when(size == 5, F.concat(F.lit("Accessory "), "p_name")).when(size == 6, "9x").otherwise(F.col("p_type"))
    )
    names = W.table(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return names.withColumn("place", rules.category_rank(F.col("name"))).orderBy("place", "name")


@query("O5 O2", V.sql("product price history", f"""
SELECT ean, id, cat, name, CAST(price AS DOUBLE) AS price, stock FROM (
  SELECT ean, p.id, cat, name, price, CAST(coalesce(s.stock, 0) AS BIGINT) AS stock
  FROM product p JOIN price r ON p.id = r.product_id AND r.is_active LEFT JOIN
  (SELECT product_id, sum({STRICT}) AS stock FROM history GROUP BY 1) s ON p.id = s.product_id
  ORDER BY p.id DESC LIMIT 50)"""))
def stock_list_last_fifty(spark, d):
    tail = goods(spark, d).orderBy(F.col("id").desc()).limit(50)
    listed = tail.select("ean", "id", "cat", "name", "price", "stock")
    return money(listed, "price").orderBy(F.col("cat").desc(), "id")
