"""SQL text of the store tables for the cross-check, and helpers that compose it."""

from __future__ import annotations

NET = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4))"
OFF = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))"
SERIAL = (
    "CASE WHEN l_partkey % 5 = 0 AND NOT (l_partkey % 3 = 0 AND l_linenumber = 7) "
    "THEN concat('SN', CAST(l_partkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) END"
)
LINE_ID = "concat(" + ", ".join(
    f"lpad(CAST({c} AS VARCHAR), {n}, '0')" for c, n in [
        ("l_linenumber", 6), ("l_partkey", 12), ("l_suppkey", 12), ("CAST(l_quantity AS BIGINT)", 8)]) + ")"

VIEWS = {
    "sales": f"""
SELECT CAST(o_orderdate AS DATE) AS date, l_orderkey AS invoice, n_name AS store_id,
       concat('Staff_', CAST(l_suppkey % 10 AS VARCHAR)) AS staff,
       CAST(l_partkey AS VARCHAR) AS sku, p_name AS product_name, p_type AS cat,
       CASE WHEN p_size <= 45 THEN p_brand END AS sub_cat,
       CASE WHEN l_linenumber = 1 THEN concat('SN', CAST(l_orderkey AS VARCHAR), '-',
            CAST(l_partkey AS VARCHAR)) END AS lot_number,
       CAST(l_quantity AS BIGINT) AS qty, {NET} AS revenue, {OFF} AS mkt_promo,
       50 + 3 * day(CAST(o_orderdate AS DATE)) AS date_traffic
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "ledger": f"""
SELECT {LINE_ID} AS id, CAST(l_partkey AS VARCHAR) AS product_id, {SERIAL} AS serial,
       CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'import_po'
            WHEN l_returnflag = 'A' THEN 'import_do'
            WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'return'
            WHEN l_returnflag = 'R' THEN 'adjust_in'
            WHEN l_linestatus = 'F' THEN 'sell'
            WHEN l_linenumber <= 2 THEN 'transfer'
            WHEN l_linenumber <= 4 THEN 'adjust_out' ELSE 'rtv' END AS type,
       CASE WHEN ({SERIAL}) IS NOT NULL THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS quantity,
       l_orderkey AS order_id, l_shipdate AS created_at, l_linestatus AS phase
FROM lineitem""",
    "history": "SELECT * FROM ledger WHERE phase = 'F'",
    "incoming": "SELECT * FROM ledger WHERE phase = 'O'",
    "product": """
SELECT CAST(p_partkey AS VARCHAR) AS id, 8930000000000 + p_partkey AS ean, p_type AS cat,
       CASE WHEN p_size <= 45 THEN p_brand END AS subcat, p_name AS name FROM part""",
    "price": """
SELECT p_partkey * 2 AS id, CAST(p_partkey AS VARCHAR) AS product_id,
       CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size <= 43 AS is_active FROM part
UNION ALL
SELECT p_partkey * 2 + 1, CAST(p_partkey AS VARCHAR),
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) - 1 AS DECIMAL(18,2)), FALSE
FROM part WHERE p_size < 10""",
    "shop_orders": """
SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS customer_id,
       concat('Staff_', CAST(o_custkey % 10 AS VARCHAR)) AS staff_id,
       CAST(0 AS DECIMAL(18,2)) AS discount,
       CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'completed' END AS status,
       o_orderdate::TIMESTAMP + to_hours(o_orderkey % 24) AS created_at FROM orders""",
    "item": f"""
SELECT {LINE_ID} AS id, l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
       {SERIAL} AS serial, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS price, {OFF} AS discount FROM lineitem""",
    "payment": """
SELECT o_orderkey * 2 AS id, o_orderkey AS order_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'cash' WHEN o_orderpriority = '2-HIGH' THEN 'card'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'banking' ELSE 'vnpay' END AS method,
       CAST(CAST(o_totalprice AS DECIMAL(18,2))
            - CASE WHEN o_orderpriority = '5-LOW' THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS amount
FROM orders
UNION ALL
SELECT o_orderkey * 2 + 1, o_orderkey, 'voucher', CAST(100 AS DECIMAL(18,2))
FROM orders WHERE o_orderpriority = '5-LOW'""",
    "shop_customer": """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
       CASE WHEN c_acctbal >= 0 THEN concat(lower(replace(c_name, '#', '.')), '@shop.example') END
       AS email FROM customer""",
    "dirty": f"""
SELECT CAST(o_orderdate AS DATE) AS date, l_orderkey AS invoice, l_linenumber AS line,
       CASE WHEN l_suppkey % 53 <> 0 THEN concat('Staff_', CAST(l_suppkey % 10 AS VARCHAR)) END AS staff,
       l_partkey AS ean, l_suppkey AS supplier, CAST(l_partkey AS VARCHAR) AS sku, l_returnflag AS cat,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 89 = 0 THEN 0
            ELSE CAST(l_quantity AS BIGINT) END AS qty,
       CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice / l_quantity END AS price,
       CASE WHEN l_orderkey % 7 <> 0 THEN CAST({NET} AS DOUBLE) END AS revenue,
       CASE WHEN l_linenumber <> 2 THEN l_discount END AS disc_percent,
       CASE WHEN l_linenumber = 3 THEN 1.0E0 END AS disc_amount,
       CASE WHEN o_orderpriority = '1-URGENT' THEN CAST({NET} AS DOUBLE) END AS cash,
       CASE WHEN o_orderpriority = '2-HIGH' THEN CAST({NET} AS DOUBLE) END AS card
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
_NEEDS = {"history": ("ledger",), "incoming": ("ledger",)}


def sql(views: str, body: str, **more: str) -> str:
    """``body`` with the named views, then ``more`` ones, as common table expressions."""
    wanted: list[str] = []
    for name in views.split():
        for v in (*_NEEDS.get(name, ()), name):
            if v not in wanted:
                wanted.append(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in wanted] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def week_label(d: str) -> str:
    return (f"concat(strftime({d}, '%y'), '-W', CAST(week({d}) AS VARCHAR), "
            f"strftime(date_trunc('week', {d}), ' (%d %b)'))")


def axis_label(d: str, view: str) -> str:
    if view == "1w":
        return week_label(d)
    if view == "1mo":
        return f"strftime({d}, '%b %Y')"
    return f"concat(strftime({d}, '%a %d'), chr(10), strftime({d}, '%b'))"


def trunc(d: str, view: str) -> str:
    unit = {"1w": "week", "1mo": "month"}.get(view)
    return f"CAST(date_trunc('{unit}', {d}) AS DATE)" if unit else d


def round_even(x: str, digits: int) -> str:
    scale = f"{10 ** digits}.0E0"
    return f"(round_even(({x}) * {scale}, 0) / {scale})"
