"""Point of sale: scanning, carts, payment, checkout, cancellation, invoices, customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.parts import with_parts
from shoptally.functions.rules import discount_amount, sellable_quantity
from shoptally.operators import carts, copies, invoices, ledger, people
from shoptally.operators import inventory as stock_ops
from shoptally.plans import views as V
from shoptally.plans.registry import query
from shoptally.plans.stock import SIGNED, STRICT, joined, money
from shoptally.sources import ledger_log
from shoptally.sources import warehouse as W

STAMP = "yyyy-MM-dd HH:mm:ss"
INVENTORY = f"""
SELECT ean, p.id, cat, subcat, name, price, CAST(coalesce(s.stock, 0) AS BIGINT) AS stock
FROM product p JOIN price r ON p.id = r.product_id AND r.is_active
LEFT JOIN (SELECT product_id, sum({STRICT}) AS stock FROM history GROUP BY 1) s
ON p.id = s.product_id"""


def goods(spark, d) -> DataFrame:
    return stock_ops.stock(W.product(spark, d), W.price(spark, d), W.history(spark, d))


# --- scanning and carts -------------------------------------------------------------------------
CODES = f"""
SELECT l_orderkey AS cart_id, {V.LINE_ID} AS line, {V.SERIAL} AS serial,
       CAST(l_quantity AS BIGINT) AS quantity,
       CASE WHEN l_linenumber = 7 THEN concat('X', CAST(l_partkey AS VARCHAR))
            WHEN l_linenumber % 2 = 0 THEN CAST(8930000000000 + l_partkey AS VARCHAR)
            ELSE CAST(l_partkey AS VARCHAR) END AS code FROM lineitem"""


def codes(spark, d) -> DataFrame:
    """What was scanned per cart: product ids, eans and unknown codes."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    return W.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cart_id"), W._line_id().alias("line"),
        W._serial().alias("serial"), F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(line == 7, F.concat(F.lit("X"), part.cast("string")))
        .when(line % 2 == 0, (F.lit(8930000000000) + part).cast("string"))
        .otherwise(part.cast("string")).alias("code"))


SCANNED = """
SELECT c.*, coalesce(a.id, b.id, c.code) AS sku, coalesce(a.name, b.name, 'Not Found') AS name,
       coalesce(a.price, b.price, 0) AS price, coalesce(a.stock, b.stock, 0) AS stock
FROM codes c LEFT JOIN inv a ON a.id = c.code LEFT JOIN inv b ON CAST(b.ean AS VARCHAR) = c.code"""
SCAN_VIEWS = {"inv": INVENTORY, "codes": CODES, "scanned": SCANNED}


def scanned(spark, d) -> DataFrame:
    return carts.scan(codes(spark, d), goods(spark, d))


@query("F12", V.sql("product price history", """
SELECT cart_id, line, code, serial, quantity, sku, name, CAST(price AS DOUBLE) AS price, stock
FROM scanned""", **SCAN_VIEWS))
def barcode_scan(spark, d):
    return money(scanned(spark, d), "price")


CONSOLIDATED = """
SELECT cart_id, sku, serial, name, price, discount, stock,
       CAST(CASE WHEN serial IS NOT NULL THEN 1 ELSE least(quantity, stock) END AS BIGINT) AS quantity
FROM (SELECT cart_id, sku, serial, arg_min(name, line) AS name, sum(quantity) AS quantity,
             arg_min(price, line) AS price, sum(discount) AS discount, max(stock) AS stock
      FROM (SELECT *, CAST(0 AS DECIMAL(18,2)) AS discount FROM scanned
            WHERE price > 0 AND quantity > 0 AND stock > 0) GROUP BY cart_id, sku, serial)"""


@query("A14 U2 X11", V.sql("product price history", """
SELECT cart_id, sku, serial, name, quantity, CAST(price AS DOUBLE) AS price,
       CAST(discount AS DOUBLE) AS discount, stock FROM merged""",
                           **SCAN_VIEWS, merged=CONSOLIDATED))
def cart_consolidated(spark, d):
    """Scanned lines (odd and even line numbers as two sources) merged into carts."""
    lines = scanned(spark, d).withColumn("discount", F.lit(0).cast("decimal(18,2)"))
    by_id = lines.where(F.col("code") == F.col("sku"))
    others = lines.where(F.col("code") != F.col("sku"))
    merged = carts.consolidate(carts.sellable(by_id.unionByName(others)))
    return money(merged, "price", "discount")


ITEM_LINES = "SELECT order_id AS cart_id, product_id AS sku, serial, quantity, price, discount FROM item"


def cart_lines(spark, d) -> DataFrame:
    return W.item(spark, d).withColumnsRenamed({"order_id": "cart_id", "product_id": "sku"}).drop("id")


TOTALS = f"""
SELECT cart_id, sum(price * quantity) AS subtotal, sum(discount) AS discount,
       CAST(greatest(floor(sum(price * quantity) - sum(discount)), 0) AS BIGINT) AS balance
FROM ({ITEM_LINES}) GROUP BY cart_id"""


@query("A16", V.sql("item", "SELECT cart_id, CAST(subtotal AS DOUBLE) AS subtotal, "
                    "CAST(discount AS DOUBLE) AS discount, balance FROM t", t=TOTALS))
def cart_totals(spark, d):
    return money(carts.totals(cart_lines(spark, d)), "subtotal", "discount")


@query("X10 X11 X1", f"""
SELECT l_orderkey AS invoice, {V.LINE_ID} AS line, entry, CAST(CASE WHEN q * price - amount < 0 THEN 0 ELSE amount END AS BIGINT)
  AS amount, CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE least(q, 20) END AS BIGINT) AS sellable
FROM (SELECT *, coalesce(CAST(floor(CAST(pct AS DOUBLE) / 100.0E0 * CAST(price AS DOUBLE)) AS BIGINT) * q,
                         CASE WHEN regexp_full_match(entry, '[0-9]+') THEN CAST(entry AS BIGINT) END, 0) AS amount
      FROM (SELECT *, CASE WHEN regexp_full_match(replace(entry, ' ', ''), '[0-9]+%[^%]*')
                           THEN split_part(replace(entry, ' ', ''), '%', 1)
                           WHEN regexp_full_match(entry, '[0-9]+') AND CAST(entry AS BIGINT) BETWEEN 1 AND 100
                           THEN entry END AS pct
            FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS price,
                         CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                              WHEN 2 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' %')
                              WHEN 3 THEN CAST(l_partkey AS VARCHAR) WHEN 4 THEN 'abc' WHEN 5 THEN ''
                              WHEN 6 THEN '150%' ELSE '%5' END AS entry FROM lineitem)))""")
def discount_entries(spark, d):
    line, qty = F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    entry = (
        F.when(line == 1, qty.cast("string")).when(line == 2, F.concat(qty.cast("string"), F.lit(" %")))
        .when(line == 3, F.col("l_partkey").cast("string")).when(line == 4, "abc")
        .when(line == 5, "").when(line == 6, "150%").otherwise("%5")
    )
    price = F.floor("l_extendedprice").cast("bigint")
    serial = F.when(line == 1, "one")
    return W.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("invoice"), W._line_id().alias("line"), entry.alias("entry"),
        discount_amount(entry, price, qty).alias("amount"),
        sellable_quantity(qty, F.lit(20), serial).cast("bigint").alias("sellable"))


# --- payment -----------------------------------------------------------------------------------------
ENTRIES = """
SELECT cart_id, m.method, m.entered FROM (
  SELECT cart_id, unnest(CASE
    WHEN o_orderpriority = '1-URGENT' THEN [{'method': 'cash', 'entered': 'abc'}]
    WHEN o_orderpriority = '2-HIGH' THEN [{'method': 'card', 'entered': CAST(balance - 100 AS VARCHAR)},
                                          {'method': 'voucher', 'entered': '100'}]
    WHEN o_orderpriority = '3-MEDIUM' THEN [{'method': 'banking', 'entered': CAST(balance AS VARCHAR)},
                                            {'method': 'voucher', 'entered': '50'}]
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN [{'method': 'vnpay', 'entered': '1000'},
                                                   {'method': 'voucher', 'entered': 'n/a'}]
  END) AS m FROM t JOIN orders ON cart_id = o_orderkey)"""


def entries(spark, d, balances: DataFrame) -> DataFrame:
    """What the cashier entered per payment method; the choice follows the order's priority."""
    def entry(method: str, entered):
        return F.struct(F.lit(method).alias("method"), entered.alias("entered"))

    text = F.col("balance").cast("string")
    level = F.col("o_orderpriority")
    chosen = (
        F.when(level == "1-URGENT", F.array(entry("cash", F.lit("abc"))))
        .when(level == "2-HIGH", F.array(
            entry("card", (F.col("balance") - 100).cast("string")), entry("voucher", F.lit("100"))))
        .when(level == "3-MEDIUM", F.array(entry("banking", text), entry("voucher", F.lit("50"))))
        .when(level == "4-NOT SPECIFIED", F.array(
            entry("vnpay", F.lit("1000")), entry("voucher", F.lit("n/a"))))
    )
    order = W.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return balances.join(order, F.col("cart_id") == F.col("o_orderkey")).select(
        "cart_id", F.explode(chosen).alias("m")).select("cart_id", "m.*")


PAID = """
SELECT e.cart_id, method, CASE WHEN n = 1 THEN balance
       WHEN regexp_full_match(entered, '[0-9]+') THEN CAST(entered AS BIGINT) END AS amount
FROM entries e JOIN (SELECT cart_id, count(*) AS n FROM entries GROUP BY 1) USING (cart_id)
JOIN t USING (cart_id)"""


@query("L8", V.sql("item", """
SELECT t.cart_id, balance, CAST(coalesce(received, 0) AS BIGINT) AS received,
       CAST(coalesce(received, 0) - balance AS BIGINT) AS delta,
       CASE WHEN coalesce(received, 0) > balance THEN 'due change'
            WHEN coalesce(received, 0) < balance THEN 'remaining'
            WHEN balance > 0 THEN 'save' ELSE 'empty' END AS verdict
FROM t LEFT JOIN (SELECT cart_id, sum(amount) AS received FROM paid GROUP BY 1) USING (cart_id)""",
                   t=TOTALS, entries=ENTRIES, paid=PAID))
def payment_reconciliation(spark, d):
    balances = carts.totals(cart_lines(spark, d))
    return carts.reconcile(balances, carts.payments(balances, entries(spark, d, balances)))


# --- checkout -------------------------------------------------------------------------------------------
CHECKOUT = {
    "cart_line": f"SELECT l_orderkey AS cart_id, CAST(l_partkey AS VARCHAR) AS sku, {V.SERIAL} AS serial, "
                 f"CASE WHEN ({V.SERIAL}) IS NOT NULL THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS quantity, "
                 f"CAST(l_extendedprice AS DECIMAL(18,2)) AS price, {V.OFF} AS discount "
                 "FROM lineitem WHERE l_linestatus = 'O'",
    "held": f"SELECT product_id, serial, sum({SIGNED}) AS stock FROM history GROUP BY ALL",
    "lines": "SELECT c.*, coalesce(h.stock - c.quantity >= 0, FALSE) AS ok FROM cart_line c LEFT JOIN held h "
             "ON h.product_id = c.sku AND h.serial IS NOT DISTINCT FROM c.serial",
    "verdict": "SELECT cart_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT ok) AS n_refused, "
               "bool_and(ok) AS accepted FROM lines GROUP BY cart_id",
    "placed": "SELECT cart_id, CAST(o_custkey AS VARCHAR) AS customer_id, "
              f"{K.FIRST_SEQUENCE_ID} - 1 + row_number() OVER (ORDER BY cart_id) AS order_id "
              "FROM verdict JOIN orders ON cart_id = o_orderkey WHERE accepted",
}


def open_lines(spark, d) -> DataFrame:
    """Cart lines: the open lines of every order; a serial line is one piece."""
    serial = W._serial()
    return W.table(spark, d, "lineitem").where(F.col("l_linestatus") == "O").select(
        F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").cast("string").alias("sku"),
        serial.alias("serial"),
        F.when(serial.isNotNull(), 1).otherwise(F.col("l_quantity").cast("bigint"))
        .cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(W.MONEY).alias("price"),
        (F.col("l_extendedprice").cast(W.MONEY) * F.col("l_discount").cast("decimal(4,2)"))
        .cast("decimal(18,4)").alias("discount"))


def cart_heads(spark, d) -> DataFrame:
    return W.orders(spark, d).select(F.col("id").alias("cart_id"), "customer_id", "staff_id",
                                     "discount")


def _checkout(spark, d):
    paid = W.payment(spark, d).withColumnRenamed("order_id", "cart_id")
    return carts.check_out(cart_heads(spark, d), open_lines(spark, d), paid, W.history(spark, d))


@query("L6", V.sql("history", "SELECT * FROM verdict", **CHECKOUT))
def checkout_verdicts(spark, d):
    return carts.verdicts(carts.judge(open_lines(spark, d), W.history(spark, d)))


@query("L6 S10", V.sql("history", "SELECT cart_id, customer_id, order_id FROM placed", **CHECKOUT))
def checkout_orders(spark, d):
    return _checkout(spark, d)[0].select("cart_id", "customer_id", "order_id")


@query("L6 J9", V.sql("history", """
SELECT order_id, sku AS product_id, serial, quantity, CAST(price AS DOUBLE) AS price,
       CAST(discount AS DOUBLE) AS discount FROM lines JOIN placed USING (cart_id)""", **CHECKOUT))
def checkout_items(spark, d):
    return money(_checkout(spark, d)[1], "price", "discount")


@query("L6 J9", V.sql("history payment", """
SELECT p.order_id, method, CAST(amount AS DOUBLE) AS amount
FROM placed p JOIN payment m ON m.order_id = p.cart_id""", **CHECKOUT))
def checkout_payments(spark, d):
    return money(_checkout(spark, d)[2], "amount")


@query("L6", V.sql("history", "SELECT sku AS product_id, 'sell' AS type, serial, quantity, order_id "
                   "FROM lines JOIN placed USING (cart_id)", **CHECKOUT))
def checkout_ledger_rows(spark, d):
    return _checkout(spark, d)[3]


# --- carts that compete: one after the other ----------------------------------------------------
#: the queue is walked cart by cart. Carts that ask for more than there ever was take nothing, and only
#: the (product, serial) pairs that run short among the others are kept as state
QUEUE = CHECKOUT | {
    "wants": "SELECT cart_id, sku, serial, sum(quantity)::BIGINT AS taken, max(quantity) AS most FROM cart_line GROUP BY ALL",
    "stocked": "SELECT w.*, h.stock FROM wants w LEFT JOIN held h ON h.product_id = w.sku AND h.serial IS NOT DISTINCT FROM w.serial",
    "hopeless": "SELECT DISTINCT cart_id FROM stocked WHERE coalesce(stock < most, TRUE)",
    "supply": "SELECT * FROM stocked WHERE cart_id NOT IN (FROM hopeless)",
    "scarce": "SELECT sku, serial, any_value(stock)::BIGINT AS stock, row_number() OVER (ORDER BY sku, serial) AS pos "
              "FROM supply GROUP BY sku, serial HAVING sum(taken) > any_value(stock)",
    "asked": "SELECT s.cart_id, c.pos, s.taken, s.most FROM supply s JOIN scarce c ON s.sku = c.sku "
             "AND s.serial IS NOT DISTINCT FROM c.serial",
    "takes": "SELECT n.cart_id, list(coalesce(a.taken, 0) ORDER BY c.pos) AS takes "
             "FROM (SELECT DISTINCT cart_id FROM asked) n CROSS JOIN scarce c "
             "LEFT JOIN asked a ON a.cart_id = n.cart_id AND a.pos = c.pos GROUP BY n.cart_id",
    "queue": "SELECT cart_id, row_number() OVER (ORDER BY cart_id) AS i, any_value(takes) AS takes, "
             "list({'pos': pos, 'most': most}) AS asks FROM asked JOIN takes USING (cart_id) GROUP BY cart_id",
    "walk": """
SELECT 0::BIGINT AS i, NULL::BIGINT AS cart_id, FALSE AS accepted, (SELECT list(stock ORDER BY pos) FROM scarce) AS state
UNION ALL
SELECT i, cart_id, accepted, CASE WHEN accepted THEN list_transform(list_zip(state, takes), lambda z: z[1] - z[2]) ELSE state END
FROM (SELECT q.*, state, len(list_filter(asks, lambda a: state[a.pos] < a.most)) = 0 AS accepted
      FROM walk w JOIN queue q ON q.i = w.i + 1)""",
    "served": "SELECT c.cart_id, c.cart_id NOT IN (FROM hopeless) AND coalesce(w.accepted, TRUE) AS accepted "
              "FROM (SELECT DISTINCT cart_id FROM cart_line) c LEFT JOIN walk w ON c.cart_id = w.cart_id",
    "placed_in_order": "SELECT cart_id, CAST(o_custkey AS VARCHAR) AS customer_id, "
                       f"{K.FIRST_SEQUENCE_ID} - 1 + row_number() OVER (ORDER BY cart_id) AS order_id "
                       "FROM served JOIN orders ON cart_id = o_orderkey WHERE accepted",
}


def queue_sql(body: str) -> str:
    text = V.sql("history", body, **QUEUE).replace("WITH", "WITH RECURSIVE", 1)
    for name in ("cart_line", "supply", "scarce", "queue", "walk"):  # else computed again at every step
        text = text.replace(f"{name} AS (", f"{name} AS MATERIALIZED (", 1)
    return text


def _checkout_in_order(spark, d):
    paid = W.payment(spark, d).withColumnRenamed("order_id", "cart_id")
    return carts.check_out_in_order(cart_heads(spark, d), open_lines(spark, d), paid, W.history(spark, d))


@query("L6 L8", queue_sql("SELECT cart_id, accepted FROM served"))
def checkout_in_order_verdicts(spark, d):
    """Carts that compete for the same pieces, served by cart id."""
    return carts.decide_in_order(open_lines(spark, d), W.history(spark, d)).select("cart_id", "accepted")


@query("L6 S10", queue_sql("SELECT cart_id, customer_id, order_id FROM placed_in_order"))
def checkout_in_order_orders(spark, d):
    return _checkout_in_order(spark, d)[0].select("cart_id", "customer_id", "order_id")


@query("L6 A8", queue_sql(f"""
SELECT product_id, serial, CAST(sum(stock) AS BIGINT) AS stock FROM (
  SELECT product_id, serial, stock FROM held
  UNION ALL SELECT sku, serial, -quantity FROM cart_line JOIN placed_in_order USING (cart_id)) GROUP BY ALL"""))
def stock_after_checkout_in_order(spark, d):
    """What the accepted carts leave: no stock that was there falls below 0."""
    moves = _checkout_in_order(spark, d)[3]
    both = W.history(spark, d).select("product_id", "serial", "type", "quantity").unionByName(
        moves.select("product_id", "serial", "type", "quantity"))
    return stock_ops.serial_balance(both)


#: members per part in the queries below: small, so that the tables have groups of several parts
PER_PART = 3


def payloads(spark, d) -> DataFrame:
    """Checkout payloads in list form, faulty ones among them: a missing staff id, no payment, an
    extra serial."""
    fields = ["product_id", "price", "quantity", "discount", "serial"]
    rows = with_parts(W.item(spark, d), ["order_id"], "id", PER_PART)
    packed = ledger_log.to_lists(rows, ["order_id", "part"], "id", fields)
    order = W.table(spark, d, "orders")
    level = F.col("o_orderpriority")
    serials = F.col("serial")
    none = F.array().cast("array<string>")
    return packed.join(order, F.col("order_id") == F.col("o_orderkey")).select(
        F.col("order_id").alias("cart_id"), F.lit("sell").alias("type"),
        F.col("o_custkey").cast("string").alias("cus_id"),
        F.when(level == "1-URGENT", "").otherwise("Staff_1").alias("staff_id"),
        F.lit(0).alias("inv_disc"),
        F.when(level == "2-HIGH", none).when(level == "3-MEDIUM", F.array(
            F.lit("cash"), F.lit("card"))).otherwise(F.array(F.lit("cash"))).alias("pay_method"),
        F.array("o_totalprice").alias("pay_amount"),
        F.col("product_id").alias("sku_id"), F.col("price").alias("sku_price"),
        F.col("quantity").alias("sku_qty"), F.col("discount").alias("sku_disc"),
        F.when(level == "5-LOW", F.concat(serials, F.array(F.lit("extra")))).otherwise(serials)
        .alias("sku_serial"))


@query("L7 U4", V.sql("item", """
SELECT order_id AS cart_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'empty value'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'payment lists differ in length'
  WHEN o_orderpriority = '5-LOW' THEN 'item lists differ in length' END AS problem
FROM (SELECT DISTINCT order_id FROM item) JOIN orders ON order_id = o_orderkey"""))
def checkout_payload_problems(spark, d):
    return carts.problems(carts.check_payload(payloads(spark, d)))


# --- cancellation --------------------------------------------------------------------------------------------
def cancelling(spark, d):
    """Requests to cancel every urgent order; some are cancelled already."""
    asked = W.table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("id"))
    return ledger.cancel(asked, W.orders(spark, d), W.ledger(spark, d))


ASKED = "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'"


@query("L9 J15", V.sql("shop_orders", """
SELECT id, CASE WHEN status = 'completed' AND id IN (SELECT id FROM asked) THEN 'cancelled'
           ELSE status END AS status FROM shop_orders""", asked=ASKED))
def cancel_order_status(spark, d):
    return cancelling(spark, d)[0].select("id", "status")


@query("L9 J15", V.sql("shop_orders ledger", """
SELECT product_id, 'return' AS type, serial, quantity, order_id FROM ledger
WHERE type = 'sell' AND order_id IN (SELECT id FROM shop_orders WHERE status = 'completed'
                                     AND id IN (SELECT id FROM asked))""", asked=ASKED))
def cancel_return_rows(spark, d):
    return cancelling(spark, d)[1]


# --- invoices --------------------------------------------------------------------------------------------------
@query("W1", V.sql("ledger", """
SELECT order_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS cancelled_at FROM (
  SELECT order_id, created_at, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC) AS rn
  FROM ledger WHERE type = 'return') WHERE rn = 1"""))
def cancelled_at(spark, d):
    return invoices.cancelled_at(W.ledger(spark, d)).withColumn(
        "cancelled_at", F.date_format("cancelled_at", STAMP))


LOCAL = "strftime({} + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S')"
LIST_TEXT = "string_agg({}, '|' ORDER BY {}.id) AS {}"
def _cut(view: str, order: str = "id", group: str = "order_id") -> str:
    """A view with each row's part within its group."""
    return (f"SELECT *, (row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1) // {PER_PART} AS part "
            f"FROM {view}")


DOC_VIEWS = {
    "items": "SELECT i.order_id, i.part, " + ", ".join(
        f"string_agg({e}, '|' ORDER BY i.id) AS {n}" for e, n in [
            ("i.product_id", "product_id"), ("coalesce(p.name, '~')", "product_name"),
            ("CAST(i.quantity AS VARCHAR)", "quantity"), ("CAST(i.price AS VARCHAR)", "price"),
            ("CAST(i.discount AS VARCHAR)", "discount")])
             + f" FROM ({_cut('item')}) i LEFT JOIN product p ON p.id = i.product_id GROUP BY ALL",
    "paid": "SELECT order_id, part, string_agg(method, '|' ORDER BY id) AS method, "
            f"string_agg(CAST(amount AS VARCHAR), '|' ORDER BY id) AS amount FROM ({_cut('payment')}) GROUP BY ALL",
    "sold": "SELECT order_id, part, string_agg(coalesce(serial, '~'), '|' ORDER BY id) AS serial FROM ("
            + _cut("(SELECT * FROM ledger WHERE type = 'sell')") + ") GROUP BY ALL",
    "slots": "SELECT order_id, part FROM items UNION SELECT order_id, part FROM paid "
             "UNION SELECT order_id, part FROM sold",
    "back": "SELECT order_id, max(created_at) AS cancelled_at FROM ledger WHERE type = 'return' GROUP BY 1",
}


@query("V2 J5 J6 W1 A10 X7", V.sql("shop_orders shop_customer item product payment ledger", f"""
SELECT o.id, CAST(coalesce(t.part, 0) AS BIGINT) AS part, o.status, o.customer_id, c.name AS customer_name,
       c.email AS customer_email, i.product_id, i.product_name, i.quantity, i.price, i.discount,
       s.serial, p.method, p.amount, {LOCAL.format('o.created_at')} AS created_at,
       {LOCAL.format('b.cancelled_at')} AS cancelled_at
FROM shop_orders o LEFT JOIN shop_customer c ON c.id = o.customer_id
LEFT JOIN back b ON b.order_id = o.id LEFT JOIN slots t ON t.order_id = o.id
LEFT JOIN items i ON i.order_id = o.id AND i.part = t.part
LEFT JOIN paid p ON p.order_id = o.id AND p.part = t.part
LEFT JOIN sold s ON s.order_id = o.id AND s.part = t.part""", **DOC_VIEWS))
def invoice_documents(spark, d):
    """Lists of three entries: items and serials of one part stand side by side."""
    docs = invoices.documents(
        W.orders(spark, d), W.customer(spark, d), W.item(spark, d), W.product(spark, d),
        W.payment(spark, d), W.ledger(spark, d), PER_PART)
    lists = (*invoices.ITEM_FIELDS, "serial", "method", "amount")
    return docs.select(
        "id", "part", "status", "customer_id", "customer_name", "customer_email",
        *[joined(c) for c in lists],
        F.date_format("created_at", STAMP).alias("created_at"),
        F.date_format("cancelled_at", STAMP).alias("cancelled_at"))


@query("V4 J7 J8", V.sql("shop_orders shop_customer item product", """
SELECT strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, o.id AS invoice, o.staff_id,
       CAST(o.discount AS DOUBLE) AS order_disc, o.status, i.product_id, i.serial, p.cat, p.subcat,
       p.name AS product_name, i.quantity, CAST(i.price AS DOUBLE) AS price,
       CAST(i.discount AS DOUBLE) AS item_discount, c.id AS phone, c.name, c.email
FROM item i JOIN shop_orders o ON i.order_id = o.id JOIN product p ON i.product_id = p.id
JOIN shop_customer c ON o.customer_id = c.id"""))
def sales_lines(spark, d):
    """Every item line once."""
    lines = invoices.sales_lines(W.item(spark, d), W.orders(spark, d), W.product(spark, d),
                                 W.customer(spark, d))
    return money(lines, "order_disc", "price", "item_discount").withColumn(
        "created_at", F.date_format("created_at", STAMP))


@query("V4 A10", V.sql("payment", f"""
SELECT order_id, part, string_agg(method, '|' ORDER BY id) AS method,
       string_agg(CAST(amount AS VARCHAR), '|' ORDER BY id) AS amount
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY id) - 1 AS part FROM payment) GROUP BY ALL"""))
def sales_payment_lists(spark, d):
    """What was paid per order, one payment to a part."""
    lists = invoices.payment_lists(W.payment(spark, d), part_rows=1)
    return lists.select("order_id", "part", joined("method"), joined("amount"))


@query("V6 A16", V.sql("item", """
SELECT order_id, CAST(sum(price * quantity) AS DOUBLE) AS subtotal, CAST(sum(discount) AS DOUBLE) AS discount,
       CAST(sum(price * quantity - discount) AS DOUBLE) AS total FROM item GROUP BY order_id"""))
def invoice_statements(spark, d):
    return money(invoices.statements(W.item(spark, d)), "subtotal", "discount", "total")


@query("V6", V.sql("item", "SELECT order_id, id, CAST(price * quantity - discount AS DOUBLE) AS line_amount "
                   "FROM item"))
def invoice_statement_lines(spark, d):
    return money(invoices.statement_lines(W.item(spark, d)), "line_amount").select(
        "order_id", "id", "line_amount")


@query("A16", V.sql("item", """
SELECT CAST(sum(price * quantity) AS DOUBLE) AS subtotal, CAST(sum(discount) AS DOUBLE) AS discount,
       CAST(sum(price * quantity - discount) AS DOUBLE) AS balance FROM item"""))
def till_totals(spark, d):
    return money(invoices.entry_totals(W.item(spark, d)), "subtotal", "discount", "balance")


INVOICES = f"""
SELECT o.id AS invoice, CAST(coalesce(i.quantity, 0) AS BIGINT) AS quantity,
       CAST(coalesce(p.amount, 0) AS DOUBLE) AS amount,
       {LOCAL.format('o.created_at')} AS created_at, o.status
FROM shop_orders o LEFT JOIN (SELECT order_id, sum(quantity) AS quantity FROM item GROUP BY 1) i
ON i.order_id = o.id LEFT JOIN (SELECT order_id, sum(amount) AS amount FROM payment GROUP BY 1) p
ON p.order_id = o.id"""


def listed(spark, d) -> DataFrame:
    rows = invoices.invoice_list(W.orders(spark, d), W.item(spark, d), W.payment(spark, d))
    return money(rows, "amount").withColumn("created_at", F.date_format("created_at", STAMP))


@query("A15", V.sql("shop_orders item payment", INVOICES))
def invoice_list(spark, d):
    return listed(spark, d)


@query("O6", V.sql("shop_orders item payment",
                   "SELECT * FROM invoices ORDER BY invoice DESC LIMIT 5 OFFSET 10", invoices=INVOICES))
def invoice_page_three(spark, d):
    return invoices.page(listed(spark, d), "invoice", 3)


@query("F14", V.sql("shop_orders", "SELECT id, status FROM shop_orders "
                    "WHERE CAST(created_at + INTERVAL 7 HOUR AS DATE) = DATE '1995-02-04'"))
def invoice_search_by_day(spark, d):
    return invoices.search(W.orders(spark, d), "04/02/1995").select("id", "status")


@query("F14", V.sql("shop_orders", "SELECT id, status FROM shop_orders WHERE CAST(id AS VARCHAR) LIKE '%77'"))
def invoice_search_by_ending(spark, d):
    return invoices.search(W.orders(spark, d), "77").select("id", "status")


@query("X7", V.sql("shop_orders", f"SELECT id, {LOCAL.format('created_at')} AS created_at FROM shop_orders"))
def order_store_time(spark, d):
    return W.orders(spark, d).select("id", F.date_format(
        invoices.local_time(F.col("created_at")), STAMP).alias("created_at"))


# --- people ---------------------------------------------------------------------------------------------
@query("F13 O5", V.sql("shop_customer", "SELECT id, name, email FROM shop_customer WHERE id LIKE '12%' "
                       "ORDER BY id LIMIT 10"))
def customer_prefix_search(spark, d):
    return people.find_customers(W.customer(spark, d), "12").select("id", "name", "email")


@query("V5 S6", V.sql("shop_customer", "SELECT * FROM shop_customer"))
def customer_lookup(spark, d):
    return W.customer(spark, d)


@query("V5 S6", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def staff_lookup(spark, d):
    return people.names(W.staff(spark, d))


ENTRY_SQL = """
SELECT CASE WHEN c_nationkey < 3 THEN concat('9', CAST(c_custkey AS VARCHAR))
            ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS id,
       CASE WHEN c_nationkey = 3 THEN 'x' WHEN c_nationkey = 4 THEN c_name ELSE 'ANNA of lee' END AS name,
       CASE WHEN c_nationkey = 5 THEN 'not an address' WHEN c_nationkey = 6 THEN ''
            ELSE concat(lower(replace(c_name, '#', '.')), '@Shop.Example') END AS email,
       CASE WHEN c_mktsegment = 'BUILDING' THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS known,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN concat(lower(replace(c_name, '#', '.')), '@shop.example') END
       AS known_mail FROM customer"""


@query("X13 X2 X1", V.sql("", r"""
SELECT id, name2 AS name, mail AS email,
  CASE WHEN NOT regexp_full_match(id, '[0-9]{10}') THEN 'phone'
       WHEN id IN (SELECT known FROM e WHERE known IS NOT NULL) THEN 'known id'
       WHEN length(name2) < 2 OR regexp_matches(name2, '[0-9]') THEN 'name'
       WHEN mail <> '' AND mail IN (SELECT known_mail FROM e WHERE known_mail IS NOT NULL) THEN 'known email'
       WHEN mail <> '' AND NOT regexp_full_match(mail, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
       THEN 'email' END AS problem
FROM (SELECT *, CASE WHEN name = 'ANNA of lee' THEN 'Anna Of Lee' WHEN name = 'x' THEN 'X' ELSE name END AS name2,
             lower(trim(email)) AS mail FROM e)""", e=ENTRY_SQL))
def new_customer_problems(spark, d):
    c = W.table(spark, d, "customer")
    nation, key = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Shop.Example"))
    phone = F.lpad(key, 10, "0")
    rows = c.select(
        F.when(nation < 3, F.concat(F.lit("9"), key)).otherwise(phone).alias("id"),
        F.when(nation == 3, "x").when(nation == 4, F.col("c_name")).otherwise("ANNA of lee")
        .alias("name"),
        F.when(nation == 5, "not an address").when(nation == 6, "").otherwise(mail).alias("email"))
    known = c.select(
        F.when(F.col("c_mktsegment") == "BUILDING", phone).alias("id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lower(mail)).alias("email"))
    return people.screened(rows, known)


@query("W3", V.sql("shop_orders", "SELECT id, customer_id, count(*) OVER (PARTITION BY customer_id) > 1 AS repeated "
                   "FROM shop_orders"))
def orders_of_repeat_customers(spark, d):
    rows = W.orders(spark, d).select("id", "customer_id")
    return copies.mark_all_copies(rows, "customer_id", "repeated")


@query("W4", V.sql("item", "SELECT order_id, id, serial, row_number() OVER (PARTITION BY serial "
                   "ORDER BY order_id, id, price, discount) > 1 AS later FROM item"))
def later_copies_of_a_serial(spark, d):
    rows = W.item(spark, d).select("order_id", "id", "serial", "price", "discount")
    marked = copies.mark_later_copies(
        rows, "serial", ["order_id", "id", "price", "discount"], "later")
    return marked.drop("price", "discount")
