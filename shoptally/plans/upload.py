"""Bulk uploads: product, price and customer batches, and the upload sheet's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.operators import apply_upload, copies, upload, upsert
from shoptally.plans import views as V
from shoptally.plans.pos import goods
from shoptally.plans.registry import query
from shoptally.plans.stock import STRICT, money
from shoptally.sources import warehouse as W

# --- product batch -------------------------------------------------------------------------
BATCH_SQL = """
SELECT CASE WHEN p_size = 1 THEN concat('D', p_brand) WHEN p_size > 46
            THEN concat('N', CAST(p_partkey AS VARCHAR)) ELSE CAST(p_partkey AS VARCHAR) END AS id,
       CASE WHEN p_size = 2 THEN 777 ELSE 8930000000000 + p_partkey END AS ean,
       concat(' ', p_type, ' ') AS cat, CASE WHEN p_size <= 45 THEN p_brand ELSE '' END AS subcat,
       CASE WHEN p_size = 3 THEN '   ' ELSE p_name END AS name,
       CASE WHEN p_size = 4 THEN NULL WHEN p_size = 5 THEN CAST(0 AS DECIMAL(18,2))
            WHEN p_size BETWEEN 6 AND 15 THEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) + 5 AS DECIMAL(18,2))
            ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS price FROM part"""


def product_batch(spark, d) -> DataFrame:
    """Every part as an uploaded product: repeated ids and eans, blank names, missing, zero and
    changed prices, new products."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    price = F.col("p_retailprice").cast(W.MONEY)
    return W.table(spark, d, "part").select(
        F.when(size == 1, F.concat(F.lit("D"), F.col("p_brand")))
        .when(size > 46, F.concat(F.lit("N"), key)).otherwise(key).alias("id"),
        F.when(size == 2, 777).otherwise(F.lit(8930000000000) + F.col("p_partkey")).alias("ean"),
        F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("cat"),
        F.when(size <= 45, F.col("p_brand")).otherwise("").alias("subcat"),
        F.when(size == 3, "   ").otherwise(F.col("p_name")).alias("name"),
        F.when(size == 4, None).when(size == 5, 0).when(size.between(6, 15), price + 5)
        .otherwise(price).cast(W.MONEY).alias("price"))


PRODUCT_VIEWS = {
    "batch": BATCH_SQL,
    "tidy": "SELECT id, ean, nullif(trim(cat), '') AS cat, nullif(trim(subcat), '') AS subcat, "
            "nullif(trim(name), '') AS name, price FROM batch",
    "checked": "SELECT *, name IS NULL OR cat IS NULL OR id IS NULL OR ean IS NULL "
               "OR count(*) OVER (PARTITION BY id) > 1 OR count(*) OVER (PARTITION BY ean) > 1 AS invalid "
               "FROM tidy",
    "valid": "SELECT * FROM checked WHERE NOT invalid",
    "fresh": "SELECT id, ean, cat, subcat, name FROM valid WHERE id NOT IN (SELECT id FROM product)",
    "prices": "SELECT id AS product_id, price FROM valid WHERE price > 0",
    "retired": "SELECT r.id, r.product_id, r.price, r.is_active AND NOT coalesce(n.price <> r.price, FALSE) "
               "AS is_active FROM price r LEFT JOIN prices n ON n.product_id = r.product_id",
    "added": "SELECT * FROM prices n WHERE NOT EXISTS (SELECT 1 FROM retired r "
             "WHERE r.product_id = n.product_id AND r.is_active)",
}


@query("L10 C12 W3 A18", V.sql("product price", "SELECT id, ean, cat, subcat, name, CAST(price AS DOUBLE) AS price, "
                               "invalid FROM checked", **PRODUCT_VIEWS))
def product_batch_checked(spark, d):
    return money(upsert.checked_products(product_batch(spark, d)), "price")


@query("L11 J12 J14", V.sql("product price", "SELECT * FROM fresh", **PRODUCT_VIEWS))
def product_batch_new(spark, d):
    return upsert.new_products(upsert.valid_products(product_batch(spark, d)), W.product(spark, d))


@query("L12", V.sql("product price", "SELECT id, product_id, CAST(price AS DOUBLE) AS price, is_active FROM retired",
                    **PRODUCT_VIEWS))
def price_history_after_batch(spark, d):
    return money(upsert.products(
        product_batch(spark, d), W.product(spark, d), W.price(spark, d))[1], "price")


@query("L12 J14", V.sql("product price", "SELECT product_id, CAST(price AS DOUBLE) AS price, TRUE AS is_active "
                        "FROM added", **PRODUCT_VIEWS))
def prices_added_by_batch(spark, d):
    return money(upsert.products(
        product_batch(spark, d), W.product(spark, d), W.price(spark, d))[2], "price")


@query("L11 L12 A18", V.sql("product price", """
SELECT CASE WHEN i.n = 0 AND f.n = a.n AND p.n = q.n THEN 'success' ELSE 'partial' END AS status,
       a.n AS input, i.n AS invalid, f.n AS product, p.n AS price
FROM (SELECT count(*) AS n FROM checked) a, (SELECT count(*) AS n FROM checked WHERE invalid) i,
     (SELECT count(*) AS n FROM fresh) f, (SELECT count(*) AS n FROM added) p,
     (SELECT count(*) AS n FROM prices) q""", **PRODUCT_VIEWS))
def product_batch_report(spark, d):
    return upsert.products(product_batch(spark, d), W.product(spark, d), W.price(spark, d))[3]


# --- customer batch -----------------------------------------------------------------------------
CUSTOMER_VIEWS = {
    "batch": """
SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('dup', CAST(c_nationkey AS VARCHAR))
            ELSE CAST(c_custkey AS VARCHAR) END AS id, c_name AS name,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('same', CAST(c_nationkey AS VARCHAR), '@shop.example')
            WHEN c_acctbal >= 0 THEN concat('c', CAST(c_custkey AS VARCHAR), '@shop.example') END AS email
FROM customer""",
    "existing": "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "checked": "SELECT *, (count(*) OVER (PARTITION BY id) > 1) OR (email IS NOT NULL "
               "AND count(*) OVER (PARTITION BY email) > 1) AS duplicate FROM batch",
    "fresh": "SELECT id, name, email FROM checked WHERE NOT duplicate AND id NOT IN (SELECT id FROM existing)",
}


def customer_batch(spark, d) -> tuple[DataFrame, DataFrame]:
    c = W.table(spark, d, "customer")
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    nation = F.col("c_nationkey").cast("string")
    mail = F.lit("@shop.example")
    batch = c.select(
        F.when(segment == "MACHINERY", F.concat(F.lit("dup"), nation)).otherwise(key).alias("id"),
        F.col("c_name").alias("name"),
        F.when(segment == "FURNITURE", F.concat(F.lit("same"), nation, mail))
        .when(F.col("c_acctbal") >= 0, F.concat(F.lit("c"), key, mail)).alias("email"))
    existing = c.where(segment != "BUILDING").select(
        key.alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit("old"), key, mail).alias("email"))
    return batch, existing


@query("L13 W3", V.sql("", "SELECT id, name, email FROM fresh", **CUSTOMER_VIEWS))
def customer_batch_new(spark, d):
    return upsert.customers(*customer_batch(spark, d))[0].select("id", "name", "email")


@query("L13", V.sql("", """
SELECT (SELECT count(*) FROM checked) AS input, (SELECT count(*) FROM checked WHERE duplicate) AS duplicates,
       CAST(0 AS BIGINT) AS blocked, (SELECT count(*) FROM fresh) AS inserted,
       CASE WHEN (SELECT count(*) FROM fresh) > 0 THEN '01' ELSE '02' END AS code""", **CUSTOMER_VIEWS))
def customer_batch_report(spark, d):
    return upsert.customers(*customer_batch(spark, d))[1]


# --- upload sheet -------------------------------------------------------------------------------------
SHEET_VIEWS = {
    "sheet": f"""
SELECT concat(lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), '-', {V.LINE_ID}) AS line,
       CASE WHEN p_size <> 2 THEN 8930000000000 + p_partkey END AS ean,
       CASE WHEN p_size = 1 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS id,
       p_type AS cat, CASE WHEN l_linenumber > 3 THEN p_brand END AS subcat,
       concat(p_name, ' ', l_returnflag) AS name,
       CASE WHEN p_size = 4 THEN NULL WHEN p_size = 5 THEN CAST(0 AS DECIMAL(18,2))
            ELSE CAST(CAST(p_retailprice AS DECIMAL(18,2)) + l_linenumber AS DECIMAL(18,2)) END AS price,
       CASE WHEN l_returnflag = 'R' THEN {V.SERIAL} END AS serial,
       CASE WHEN p_size = 6 AND l_linenumber = 2 THEN NULL WHEN p_size = 7 AND l_linenumber = 3 THEN 0
            ELSE CAST(l_quantity AS BIGINT) END AS quantity,
       CASE l_linenumber WHEN 1 THEN 'import_po' WHEN 2 THEN 'import_do' WHEN 3 THEN 'adjust_in'
            WHEN 4 THEN 'adjust_out' WHEN 5 THEN NULL WHEN 6 THEN 'transfer'
            ELSE CASE WHEN p_size = 8 THEN 'gift' ELSE 'rtv' END END AS type,
       concat('T', CAST(l_orderkey AS VARCHAR)) AS transaction_id
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "usable": "SELECT line, ean, id, cat, subcat, name, price, serial, CASE WHEN serial IS NOT NULL THEN 1 "
              "ELSE quantity END AS quantity, type, transaction_id FROM sheet WHERE id <> '' AND ean IS NOT NULL",
    "merged": """
SELECT id, ean, arg_min(cat, line) FILTER (WHERE cat IS NOT NULL) AS cat,
       arg_min(subcat, line) FILTER (WHERE subcat IS NOT NULL) AS subcat,
       arg_min(name, line) FILTER (WHERE name IS NOT NULL) AS name, max(price) AS price
FROM usable GROUP BY id, ean""",
    "moves": "SELECT id AS product_id, serial, quantity, type, transaction_id FROM usable WHERE type IS NOT NULL",
}


def sheet(spark, d) -> DataFrame:
    """An upload sheet over all lines: rows without id or ean, unknown types, missing and zero
    quantities, repeated serials, products with and without serials."""
    size, line = F.col("p_size"), F.col("l_linenumber")
    part = W.table(spark, d, "part")
    rows = W.table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    price = (F.col("p_retailprice").cast(W.MONEY) + line).cast(W.MONEY)
    kind = (
        F.when(line == 1, "import_po").when(line == 2, "import_do").when(line == 3, "adjust_in")
        .when(line == 4, "adjust_out").when(line == 6, "transfer")
        .when((line == 7) & (size == 8), "gift").when(line == 7, "rtv")
    )
    return rows.select(
        F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"),
                 W._line_id()).alias("line"),
        F.when(size != 2, F.lit(8930000000000) + F.col("p_partkey")).alias("ean"),
        F.when(size == 1, "").otherwise(F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_type").alias("cat"),
        F.when(line > 3, F.col("p_brand")).alias("subcat"),
        F.concat_ws(" ", "p_name", "l_returnflag").alias("name"),
        F.when(size == 4, None).when(size == 5, 0).otherwise(price).cast(W.MONEY).alias("price"),
        F.when(F.col("l_returnflag") == "R", W._serial()).alias("serial"),
        F.when((size == 6) & (line == 2), None).when((size == 7) & (line == 3), 0)
        .otherwise(F.col("l_quantity")).cast("bigint").alias("quantity"),
        kind.alias("type"),
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("transaction_id"))


@query("L14 F15 U4", V.sql("", "SELECT line, ean, id, cat, subcat, name, CAST(price AS DOUBLE) AS price, serial, "
                           "quantity, type, transaction_id FROM usable", **SHEET_VIEWS))
def upload_usable_rows(spark, d):
    return money(upload.usable_rows(sheet(spark, d)), "price")


@query("L14 F15 W5 A18", V.sql("", """
SELECT 'type' AS rule, count(*) FILTER (WHERE type NOT IN
  ('import_po', 'import_do', 'adjust_in', 'adjust_out', 'transfer', 'rtv')) AS n FROM usable
UNION ALL SELECT 'duplicate serial', count(*) FROM (SELECT serial FROM usable WHERE serial IS NOT NULL
  GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'mixed serials', count(*) FROM (SELECT id FROM usable GROUP BY 1
  HAVING bool_or(serial IS NULL) AND bool_or(serial IS NOT NULL))
UNION ALL SELECT 'quantity', count(*) FILTER (WHERE quantity <= 0) FROM usable
UNION ALL SELECT 'type without quantity', count(*) FILTER (WHERE quantity IS NULL AND type IS NOT NULL)
FROM usable""", **SHEET_VIEWS))
def upload_violations(spark, d):
    return upload.violations(upload.usable_rows(sheet(spark, d)))


LOOSE = "SELECT * FROM usable WHERE serial IS NULL AND quantity > 0 AND (type IS NULL OR type <> 'gift')"


@query("L14", V.sql("", "SELECT line, id, quantity, type FROM loose", **SHEET_VIEWS, loose=LOOSE))
def upload_guard_passes_clean_sheet(spark, d):
    """The sheet without its faulty rows passes the guard as a whole."""
    rows = sheet(spark, d).where(
        F.col("serial").isNull() & (F.col("quantity") > 0)
        & F.coalesce(F.col("type") != "gift", F.lit(True)))
    return upload.guard(rows)[0].select("line", "id", "quantity", "type")


@query("A12", V.sql("", "SELECT id, ean, cat, subcat, name, CAST(price AS DOUBLE) AS price FROM merged",
                    **SHEET_VIEWS))
def upload_products_consolidated(spark, d):
    return money(upload.consolidate(upload.usable_rows(sheet(spark, d))), "price")


@query("L15 W4", V.sql("", """
SELECT count(*) FILTER (WHERE price IS NULL OR price <= 0) AS no_price,
       CAST(count(*) - count(DISTINCT id) AS BIGINT) AS dup_id,
       CAST(count(*) - count(DISTINCT ean) AS BIGINT) AS dup_ean FROM merged""", **SHEET_VIEWS))
def upload_product_check(spark, d):
    return upload.product_check(upload.consolidate(upload.usable_rows(sheet(spark, d))))


@query("L15", V.sql("", "SELECT id, ean, CAST(price AS DOUBLE) AS price FROM merged WHERE price > 0 AND NOT EXISTS "
                    "(SELECT id FROM merged GROUP BY id HAVING count(*) > 1) AND NOT EXISTS "
                    "(SELECT ean FROM merged GROUP BY ean HAVING count(*) > 1)", **SHEET_VIEWS))
def upload_products_passed(spark, d):
    merged = upload.consolidate(upload.usable_rows(sheet(spark, d)))
    return money(upload.checked_products(merged), "price").select("id", "ean", "price")


@query("L17", V.sql("", "SELECT * FROM moves", **SHEET_VIEWS))
def upload_ledger_rows(spark, d):
    return upload.ledger_rows(upload.usable_rows(sheet(spark, d)))


GOODS = f"""
SELECT p.id, price FROM product p JOIN price r ON p.id = r.product_id AND r.is_active"""


@query("L16 J12 A13", V.sql("product price", """
SELECT 'Records' AS figure, count(DISTINCT id) AS value FROM passed
UNION ALL SELECT 'New Product', count(*) FROM passed WHERE id NOT IN (SELECT id FROM goods)
UNION ALL SELECT 'New Price', count(*) FROM passed p LEFT JOIN goods g ON g.id = p.id
          WHERE p.price IS DISTINCT FROM g.price
UNION ALL SELECT 'Lines', count(*) FROM moves
UNION ALL SELECT type, CAST(coalesce(sum(quantity), 0) AS BIGINT) FROM moves GROUP BY type""",
                            **SHEET_VIEWS, goods=GOODS, passed="SELECT * FROM merged WHERE price > 0"))
def upload_summary(spark, d):
    rows = upload.usable_rows(sheet(spark, d))
    passed = upload.checked_products(upload.consolidate(rows))
    listed = goods(spark, d).select("id", "price")
    return upload.summary(passed, upload.ledger_rows(rows), listed)


@query("J12", V.sql("product price", "SELECT p.id, CAST(p.price AS DOUBLE) AS price FROM merged p LEFT JOIN goods g "
                    "ON g.id = p.id WHERE p.price IS DISTINCT FROM g.price", **SHEET_VIEWS, goods=GOODS))
def upload_new_prices(spark, d):
    merged = upload.consolidate(upload.usable_rows(sheet(spark, d)))
    changed = upload.new_prices(merged, goods(spark, d).select("id", "price"))
    return money(changed, "price").select("id", "price")


@query("W3", V.sql("", "SELECT line, serial FROM (SELECT line, serial, count(*) OVER (PARTITION BY serial) AS n "
                   "FROM usable WHERE serial IS NOT NULL) WHERE n > 1", **SHEET_VIEWS))
def upload_repeated_serials(spark, d):
    rows = upload.usable_rows(sheet(spark, d)).select("line", "serial")
    return copies.mark_all_copies(rows, "serial", "dup").where("dup").drop("dup")


CLEAN_VIEWS = {
    **{k: v for k, v in SHEET_VIEWS.items() if k in ("sheet", "usable")}, "loose": LOOSE,
    "passed": """
SELECT * FROM (SELECT id, ean, arg_min(cat, line) AS cat, arg_min(name, line) AS name, max(price) AS price
               FROM loose GROUP BY id, ean) WHERE price > 0""",
    "prices": "SELECT id AS product_id, price FROM passed",
    "goods": GOODS,
    "kept": "SELECT r.product_id FROM price r JOIN prices n ON n.product_id = r.product_id "
            "AND n.price = r.price WHERE r.is_active",
}


@query("L18", V.sql("product price", """
SELECT (SELECT count(*) FROM passed p LEFT JOIN goods g ON g.id = p.id
        WHERE p.price IS DISTINCT FROM g.price) > 0 AS needed,
       CASE WHEN (SELECT count(*) FROM passed WHERE id NOT IN (SELECT id FROM product)) = (SELECT count(*) FROM passed)
             AND (SELECT count(*) FROM prices WHERE product_id NOT IN (SELECT product_id FROM kept))
                 = (SELECT count(*) FROM prices) THEN 'success' ELSE 'partial' END AS status,
       (SELECT count(*) FROM loose WHERE type IS NOT NULL) AS moves, CAST(0 AS BIGINT) AS applied""",
                    **CLEAN_VIEWS))
def upload_applied_in_order(spark, d):
    """Known products with new prices: the product step is partial, so no movement follows."""
    rows = upload.usable_rows(sheet(spark, d)).where(
        F.col("serial").isNull() & (F.col("quantity") > 0)
        & F.coalesce(F.col("type") != "gift", F.lit(True)))
    return apply_upload.apply(
        rows, W.product(spark, d), W.price(spark, d), W.history(spark, d),
        goods(spark, d).select("id", "price")).outcome
