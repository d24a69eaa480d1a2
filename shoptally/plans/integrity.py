"""Integrity audit and table profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoptally.operators import audit
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.sources import warehouse as W


def _orphans(rule: str, child: str, key: str, parent: str) -> str:
    return (f"SELECT '{rule}' AS rule, count(*) AS violations FROM {child} WHERE {key} IS NOT NULL "
            f"AND {key} NOT IN (SELECT id FROM {parent})")


def _repeats(rule: str, table: str, key: str, where: str = "TRUE") -> str:
    return (f"SELECT '{rule}' AS rule, count(*) AS violations FROM (SELECT {key} FROM {table} "
            f"WHERE {key} IS NOT NULL AND {where} GROUP BY 1 HAVING count(*) > 1)")


def _broken(rule: str, table: str, condition: str) -> str:
    return f"SELECT '{rule}' AS rule, count(*) AS violations FROM {table} WHERE {condition}"


RULES = [
    _broken("customer email form", "shop_customer",
            r"NOT regexp_full_match(lower(email), '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')"),
    _repeats("customer id unique", "shop_customer", "id"),
    _repeats("customer email unique", "shop_customer", "email"),
    _repeats("product id unique", "product", "id"),
    _repeats("product ean unique", "product", "ean"),
    _broken("orders discount", "shop_orders", "discount < 0"),
    _broken("orders status", "shop_orders", "status NOT IN ('completed', 'cancelled')"),
    _broken("item quantity", "item", "quantity <= 0"),
    _broken("item price", "item", "price < 0"),
    _broken("item discount", "item", "discount < 0"),
    _broken("price positive", "price", "price <= 0"),
    _repeats("price one active", "price", "product_id", "is_active"),
    _broken("payment amount", "payment", "amount <= 0"),
    _broken("payment method", "payment",
            "method NOT IN ('cash', 'card', 'banking', 'vnpay', 'voucher')"),
    _broken("ledger quantity", "ledger", "quantity <= 0"),
    _broken("ledger type", "ledger", "type NOT IN ('import_po', 'import_do', 'adjust_in', "
            "'adjust_out', 'transfer', 'rtv', 'sell', 'return')"),
    "SELECT 'ledger serial of one product' AS rule, count(*) AS violations FROM (SELECT serial FROM "
    "ledger WHERE serial IS NOT NULL GROUP BY 1 HAVING count(DISTINCT product_id) > 1)",
    _orphans("payment of an order", "payment", "order_id", "shop_orders"),
    _orphans("item of an order", "item", "order_id", "shop_orders"),
    _orphans("item of a product", "item", "product_id", "product"),
    _orphans("order of a customer", "shop_orders", "customer_id", "shop_customer"),
    _orphans("order of a staff member", "shop_orders", "staff_id", "crew"),
    _orphans("price of a product", "price", "product_id", "product"),
    _orphans("ledger row of an order", "ledger", "order_id", "shop_orders"),
    _orphans("ledger row of a product", "ledger", "product_id", "product"),
]


@query("L19 A18", V.sql("shop_customer product shop_orders item price payment ledger",
                        " UNION ALL ".join(RULES),
                        crew="SELECT concat('Staff_', CAST(s_suppkey % 7 AS VARCHAR)) AS id FROM supplier"))
def integrity_audit(spark, d):
    """All rules over the store tables. The staff table lacks some of the ids that orders use."""
    crew = W.table(spark, d, "supplier").select(
        F.concat(F.lit("Staff_"), (F.col("s_suppkey") % 7).cast("string")).alias("id"))
    return audit.integrity({
        "customer": W.customer(spark, d), "product": W.product(spark, d),
        "orders": W.orders(spark, d), "item": W.item(spark, d), "price": W.price(spark, d),
        "payment": W.payment(spark, d), "staff": crew, "stock_ledger": W.ledger(spark, d),
    })


PROFILED = [("date", "date"), ("invoice", "bigint"), ("line", "int"), ("staff", "string"),
            ("qty", "bigint"), ("price", "double"), ("revenue", "double"), ("cash", "double")]


@query("C11 A18", V.sql("dirty", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS nulls, count(*) AS n_rows "
    "FROM dirty" for c, t in PROFILED)))
def frame_profile(spark, d):
    return audit.profile(W.dirty_sales(spark, d).select(*[c for c, _ in PROFILED]))
