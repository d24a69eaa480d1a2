"""Point of sale on many carts at once: barcode lookup, consolidation, payment, checkout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import total
from shoptally.functions.numbering import numbered
from shoptally.functions.rules import sellable_quantity
from shoptally.functions.running import placed, summed
from shoptally.operators.inventory import serial_balance
from shoptally.session import stored, use_checkpoints


def scan(codes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Product per scanned ``code``, by id or by ean; the id wins. Unknown codes stay, named
    ``Not Found``.

    Two equi-joins, one per key: an OR in one condition would compare all pairs.
    """
    goods = inventory.select(F.col("id").alias("sku"), F.col("ean").cast("string").alias("ean"),
                             "name", "price", "stock")
    by_id = goods.select(F.col("sku").alias("code"), F.struct("sku", "name", "price", "stock")
                         .alias("a"))
    by_ean = goods.select(F.col("ean").alias("code"), F.struct("sku", "name", "price", "stock")
                          .alias("b"))
    hit = F.coalesce("a", "b")
    return codes.join(by_id, "code", "left").join(by_ean, "code", "left").select(
        *codes.columns,
        F.coalesce(hit["sku"], F.col("code")).alias("sku"),
        F.coalesce(hit["name"], F.lit("Not Found")).alias("name"),
        F.coalesce(hit["price"], F.lit(0)).alias("price"),
        F.coalesce(hit["stock"], F.lit(0)).alias("stock"),
    )


def sellable(lines: DataFrame) -> DataFrame:
    """Lines that may enter a cart: price, quantity and stock all above 0."""
    return lines.where((F.col("price") > 0) & (F.col("quantity") > 0) & (F.col("stock") > 0))


def consolidate(lines: DataFrame, order: str = "line") -> DataFrame:
    """One row per (cart, sku, serial), NULL serial being a group; quantity capped."""
    merged = lines.groupBy("cart_id", "sku", "serial").agg(
        F.min_by("name", order).alias("name"),
        F.sum("quantity").alias("quantity"),
        F.min_by("price", order).alias("price"),
        F.sum("discount").alias("discount"),
        F.max("stock").alias("stock"),
    )
    return merged.withColumn("quantity", sellable_quantity(
        F.col("quantity"), F.col("stock"), F.col("serial")).cast("bigint"))


def totals(lines: DataFrame) -> DataFrame:
    """Subtotal, discount and balance per cart; no balance below 0."""
    gross = F.col("price") * F.col("quantity")
    sums = lines.groupBy("cart_id").agg(
        total(gross).alias("subtotal"), total("discount").alias("discount"))
    return sums.withColumn(
        "balance", F.greatest(F.floor(F.col("subtotal") - F.col("discount")), F.lit(0))
        .cast("bigint"))


def payments(balances: DataFrame, entries: DataFrame) -> DataFrame:
    """What each method pays: a single method pays the balance, several pay what was entered in
    digits (anything else pays nothing)."""
    several = entries.groupBy("cart_id").agg(F.count("*").alias("n_methods"))
    entered = F.when(F.col("entered").rlike("^[0-9]+$"), F.col("entered").try_cast("bigint"))
    joined = entries.join(several, "cart_id").join(balances.select("cart_id", "balance"), "cart_id")
    return joined.select("cart_id", "method", F.when(
        F.col("n_methods") == 1, F.col("balance")).otherwise(entered).alias("amount"))


def reconcile(balances: DataFrame, paid: DataFrame) -> DataFrame:
    """Received, difference and verdict per cart; only an exact, positive balance is saved."""
    sums = paid.groupBy("cart_id").agg(F.sum("amount").alias("received"))
    rows = balances.join(sums, "cart_id", "left").withColumn(
        "received", F.coalesce("received", F.lit(0)).cast("bigint"))
    delta = F.col("received") - F.col("balance")
    verdict = (
        F.when(delta > 0, "due change").when(delta < 0, "remaining")
        .when(F.col("balance") > 0, "save").otherwise("empty")
    )
    return rows.select("cart_id", "balance", "received", delta.alias("delta"),
                       verdict.alias("verdict"))


PAYLOAD = ("type", "cus_id", "staff_id", "inv_disc", "pay_method", "pay_amount", "sku_id",
           "sku_price", "sku_qty", "sku_disc", "sku_serial")


def check_payload(payload: DataFrame) -> DataFrame:
    """Adds ``problem`` to checkout payloads (list columns), NULL for a usable one."""
    if set(payload.columns) - {"cart_id"} != set(PAYLOAD):
        raise ValueError(f"a payload has exactly these columns: {', '.join(PAYLOAD)}")
    lists = [c for c in PAYLOAD if c.startswith(("pay_", "sku_"))]
    scalars = [c for c in PAYLOAD if c not in lists and c != "inv_disc"]

    def size(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0))

    blank = F.lit(False)
    for c in lists:
        blank = blank | (size(c) <= 0)
    for c in scalars:
        blank = blank | F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    sku = [size(c) for c in lists if c.startswith("sku_")]
    return payload.withColumn(
        "problem",
        F.when(blank, "empty value")
        .when(size("pay_method") != size("pay_amount"), "payment lists differ in length")
        .when(F.greatest(*sku) != F.least(*sku), "item lists differ in length"))


def problems(checked: DataFrame) -> DataFrame:
    """(cart_id, problem): the gravest problem among the parts of each cart's payload."""
    rank = F.when(F.col("problem") == "empty value", 0).when(
        F.col("problem") == "payment lists differ in length", 1).otherwise(2)
    worst = F.min(F.when(F.col("problem").isNotNull(), F.struct(rank.alias("rank"), "problem")))
    return checked.groupBy("cart_id").agg(worst.alias("worst")).select("cart_id", "worst.problem")


def judge(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds ``ok`` to cart lines: enough stock of (sku, serial). No history is not enough."""
    clean = lines.withColumn("serial", F.nullif("serial", F.lit("")))
    concerned = ledger.join(
        clean.select(F.col("sku").alias("product_id")).distinct(), "product_id", "left_semi")
    held = serial_balance(concerned).select(
        F.col("product_id").alias("p"), F.col("serial").alias("s"), F.col("stock").alias("held"))
    return clean.join(
        held, (F.col("sku") == F.col("p")) & F.col("serial").eqNullSafe(F.col("s")), "left"
    ).withColumn(
        "ok", F.coalesce(F.col("held") - F.col("quantity") >= 0, F.lit(False))
    ).drop("p", "s", "held")


def verdicts(judged: DataFrame) -> DataFrame:
    """Per cart: lines, refused lines, and whether the order goes through as a whole."""
    return judged.groupBy("cart_id").agg(
        F.count("*").alias("n_lines"), F.count_if(~F.col("ok")).alias("n_refused"),
        F.every("ok").alias("accepted"))


def decide_in_order(lines: DataFrame, ledger: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(cart_id, accepted, round): carts one after the other by ``cart_id``, each against what the
    accepted carts before it leave. Two carts that want the last piece do not both get it.

    A cart's lines are judged each alone against the stock before the cart, as one statement would.
    All open carts are judged at once between two bounds: what is left of a (product, serial) if no
    open cart before takes its share, and if all of them do. A cart that passes by the lower bound
    everywhere is accepted, one that fails by the upper bound anywhere is refused, and the rest goes
    into the next round with tighter bounds. The first open cart of all its products meets equal
    bounds, so every round decides some; products that nobody contests are decided in the first.
    The claims before a cart are running sums, spread over tasks for a hot product.

    A line with no stock history, or whose quantity is missing or not above 0, refuses its cart.
    ``most_rounds`` stops early and leaves the open carts out.
    """
    clean = lines.withColumn("serial", F.nullif("serial", F.lit("")))
    wants = clean.groupBy("cart_id", "sku", "serial").agg(
        F.sum("quantity").alias("taken"), F.max("quantity").alias("most"),
        F.every(F.coalesce(F.col("quantity") > 0, F.lit(False))).alias("fine"))
    concerned = ledger.join(
        clean.select(F.col("sku").alias("product_id")).distinct(), "product_id", "left_semi")
    held = serial_balance(concerned).select(
        F.col("product_id").alias("p"), F.col("serial").alias("s"), F.col("stock").alias("held"))
    same = (F.col("sku") == F.col("p")) & F.col("serial").eqNullSafe(F.col("s"))
    rows = placed(wants.join(held, same, "left").select(
        "cart_id", "sku", "serial", "taken", "most", F.when(F.col("fine"), F.col("held")).alias("held"),
        F.lit(None).cast("boolean").alias("accepted")), ["sku", "serial"], ["cart_id"])
    is_open, decided = F.col("accepted").isNull(), []
    while most_rounds is None or len(decided) < most_rounds:
        claims = {"gone": F.when(F.col("accepted"), F.col("taken")), "claimed": F.when(is_open, F.col("taken"))}
        seen = summed(rows, ["sku", "serial"], ["cart_id"], claims)
        upper = F.col("held") - F.col("gone")
        lower = upper - (F.col("claimed") - F.col("taken"))
        verdict = seen.where(is_open).groupBy("cart_id").agg(
            F.every(F.coalesce(lower >= F.col("most"), F.lit(False))).alias("passes"),
            F.some(F.coalesce(upper < F.col("most"), F.lit(True))).alias("fails"),
        ).where("passes OR fails").select("cart_id", F.col("passes").alias("fresh"))
        after = stored(rows.join(verdict, "cart_id", "left"), "queue")
        decided.append(after.where(F.col("fresh").isNotNull()).select(
            "cart_id", F.col("fresh").alias("accepted"), F.lit(len(decided) + 1).alias("round")).distinct())
        after = after.withColumn("accepted", F.coalesce("accepted", "fresh")).drop("fresh")
        if after.where(is_open).isEmpty():
            break
        # what the next round needs: open carts, and what accepted ones took of the same pieces
        still = after.where(is_open).select(F.col("sku").alias("p"), F.col("serial").alias("s")).distinct()
        rows = after.where(is_open | F.col("accepted")).join(still, same, "left_semi")
    return reduce(DataFrame.unionByName, decided)


def check_out(carts: DataFrame, lines: DataFrame, paid: DataFrame, ledger: DataFrame,
              first_id: int = K.FIRST_SEQUENCE_ID
              ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(orders, items, payments, ledger rows, refused carts) of carts judged all-or-nothing, each
    cart alone against the stock before the batch.

    ``carts`` holds cart_id, customer_id, staff_id, discount; new orders are numbered from
    ``first_id`` by cart id.
    """
    use_checkpoints(lines.sparkSession)
    judged = judge(lines, ledger).checkpoint()  # read again for the items and the refusals
    return (*_fan_out(carts, judged.drop("ok"), paid, verdicts(judged), first_id),
            verdicts(judged).where(~F.col("accepted")))


def check_out_in_order(carts: DataFrame, lines: DataFrame, paid: DataFrame, ledger: DataFrame,
                       first_id: int = K.FIRST_SEQUENCE_ID
                       ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``check_out`` for carts that compete: later carts see what earlier ones took."""
    result = decide_in_order(lines, ledger)
    clean = lines.withColumn("serial", F.nullif("serial", F.lit("")))
    return (*_fan_out(carts, clean, paid, result, first_id), result.where(~F.col("accepted")))


def _fan_out(carts: DataFrame, lines: DataFrame, paid: DataFrame, result: DataFrame, first_id: int):
    """(orders, items, payments, ledger rows) of the accepted carts."""
    through = carts.join(result.where("accepted").select("cart_id"), "cart_id", "left_semi")
    orders = numbered(through, ["cart_id"], "order_id", first_id)
    ids = orders.select("cart_id", "order_id")
    items = lines.join(ids, "cart_id").select(
        "order_id", F.col("sku").alias("product_id"), "serial", "quantity", "price", "discount")
    payment = paid.join(ids, "cart_id").select("order_id", "method", "amount")
    moves = items.select("product_id", F.lit("sell").alias("type"), "serial", "quantity",
                         "order_id")
    return orders, items, payment, moves
