"""Invoice documents, sales lines, statements and invoice lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptally import constants as K
from shoptally.functions.columns import total
from shoptally.functions.parts import PART_ROWS, in_order, with_parts
from shoptally.operators.kinds import to_day
from shoptally.session import stored

ITEM_FIELDS = ("product_id", "product_name", "quantity", "price", "discount")


def local_time(ts: Column) -> Column:
    """A UTC timestamp without zone as store time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(K.STORE_TIMEZONE), ts)


def cancelled_at(ledger: DataFrame) -> DataFrame:
    """Latest return per order. A maximum needs no ranking, so a hot order is combined map-side."""
    return (
        ledger.where(F.col("type") == "return")
        .groupBy("order_id").agg(F.max("created_at").alias("cancelled_at"))
    )


def _place(c: Column) -> Column:
    """An id as text of one length, in the order of the ids."""
    return F.lpad(c.cast("string"), 40, "0")


def _columns(lists: DataFrame) -> DataFrame:
    return lists.select(
        "order_id", "part", *[F.col(f"items.{f}").alias(f) for f in ITEM_FIELDS],
        "serials.serial", "payments.method", "payments.amount")


def _entries(df: DataFrame, kind: str, fields: dict[str, Column]) -> DataFrame:
    # ids of different tables in one column
    return df.select("order_id", F.lit(kind).alias("kind"), _place(F.col("id")).alias("id"),
                     *[v.alias(k) for k, v in fields.items()])


def _spread_lists(item: DataFrame, names: DataFrame, payment: DataFrame, sold: DataFrame, part_rows: int
                  ) -> DataFrame:
    """Lists per (order, part) of orders of any size: their entries are placed by ranges."""
    items = _entries(
        item.join(names, "product_id", "left"), "item", {f: F.col(f) for f in ITEM_FIELDS})
    paid = _entries(payment, "payment", {"method": F.col("method"), "amount": F.col("amount")})
    serials = _entries(sold, "serial", {"serial": F.col("serial")})
    rows = items.unionByName(paid, True).unionByName(serials, True)
    parts = with_parts(rows, ["order_id", "kind"], "id", part_rows)

    def gather(kind: str, *fields: str) -> Column:
        return F.collect_list(F.when(F.col("kind") == kind, F.struct("id", *fields)))

    grouped = parts.groupBy("order_id", "part").agg(
        gather("item", *ITEM_FIELDS).alias("items"),
        gather("payment", "method", "amount").alias("payments"),
        gather("serial", "serial").alias("serials"),
    )
    return _columns(grouped.select(
        "order_id", "part", in_order("items"), in_order("payments"), in_order("serials")))


def _whole_lists(item: DataFrame, names: DataFrame, payment: DataFrame, sold: DataFrame, part_rows: int
                 ) -> DataFrame:
    """Lists per (order, part) of orders whose entries fit one task: gathered by order in one shuffle
    under their own short ids, then sorted and cut."""
    kinds = {"items": (item.join(names, "product_id", "left"), ITEM_FIELDS),
             "payments": (payment, ("method", "amount")), "serials": (sold, ("serial",))}
    rows = reduce(lambda a, b: a.unionByName(b, True), [
        df.select("order_id", F.struct("id", *fields).alias(kind)) for kind, (df, fields) in kinds.items()])
    whole = rows.groupBy("order_id").agg(*[F.collect_list(k).alias(k) for k in kinds])

    def ordered(kind: str, fields: tuple[str, ...]) -> Column:
        # entries that share an id, or have none, keep the order in which they came
        return F.sort_array(F.transform(kind, lambda x, at: F.struct(
            _place(x["id"]).alias("id"), at.alias("at"), *[x[f].alias(f) for f in fields]))).alias(kind)

    whole = whole.select("order_id", *[ordered(k, fields) for k, (_, fields) in kinds.items()])
    last = F.floor((F.greatest(F.lit(1), *[F.size(k) for k in kinds]) - 1) / part_rows)
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))

    def cut(kind: str, fields: tuple[str, ...]) -> Column:
        some = F.slice(F.col(kind), (F.col("part") * part_rows + 1).cast("int"), F.lit(part_rows))
        plain = F.transform(some, lambda x: F.struct(x["id"].alias("id"), *[x[f].alias(f) for f in fields]))
        return F.when(F.size(some) > 0, F.sort_array(plain)).alias(kind)

    return _columns(parts.select("order_id", "part", *[cut(k, fields) for k, (_, fields) in kinds.items()]))


def _large(*entries: DataFrame) -> DataFrame:
    """Orders with more entries than one task should hold, as a written table: at most one row per
    ``PART_ROWS`` entries."""
    ids = reduce(DataFrame.union, [e.select("order_id") for e in entries])
    return stored(ids.groupBy("order_id").count().where(F.col("count") > PART_ROWS).select("order_id"), "large")


def _lists(item: DataFrame, product: DataFrame, payment: DataFrame, ledger: DataFrame,
           part_rows: int) -> DataFrame:
    """Item, payment and serial lists per (order, part). An order without a key meets no order."""
    names = product.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    frames = [f.where(F.col("order_id").isNotNull()) for f in (
        item, payment, ledger.where(F.col("type") == "sell").select("order_id", "id", "serial"))]
    large = _large(*frames)
    few, many = ([f.join(large, "order_id", how) for f in frames] for how in ("left_anti", "left_semi"))
    lists = _whole_lists(few[0], names, *few[1:], part_rows)
    if not large.isEmpty():
        lists = lists.unionByName(_spread_lists(many[0], names, *many[1:], part_rows))
    return lists


def documents(orders: DataFrame, customer: DataFrame, item: DataFrame, product: DataFrame,
              payment: DataFrame, ledger: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per order with its lists in id order; NULL serials keep their place. A row holds
    ``part_rows`` entries of a kind, further ones follow in further ``part`` rows, so items and
    serials of one part are at the same positions."""
    who = customer.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                          F.col("email").alias("customer_email"))
    lists = _lists(item, product, payment, ledger, part_rows)
    return (
        orders.select(F.col("id").alias("order_id"), "customer_id", "status", "created_at")
        .join(who, "customer_id", "left")
        .join(cancelled_at(ledger), "order_id", "left")
        .join(lists, "order_id", "left")
        .select(
            F.col("order_id").alias("id"),
            F.coalesce("part", F.lit(0)).cast("bigint").alias("part"),
            "status", "customer_id", "customer_name", "customer_email",
            *ITEM_FIELDS, "serial", "method", "amount",
            local_time(F.col("created_at")).alias("created_at"),
            local_time(F.col("cancelled_at")).alias("cancelled_at"),
        )
    )


def payment_lists(payment: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    rows = with_parts(payment, ["order_id"], "id", part_rows)
    lists = rows.groupBy("order_id", "part").agg(
        F.collect_list(F.struct("id", "amount", "method")).alias("payments"))
    sorted_lists = lists.select("order_id", "part", in_order("payments"))
    return sorted_lists.select("order_id", "part", "payments.amount", "payments.method")


def sales_lines(item: DataFrame, orders: DataFrame, product: DataFrame, customer: DataFrame
                ) -> DataFrame:
    """Item lines with their order, product and customer, each line once. What was paid for the
    orders is ``payment_lists``, a frame of its own: an order may have several parts of it."""
    o = orders.select(F.col("id").alias("order_id"), "customer_id", "staff_id",
                      F.col("discount").alias("order_disc"), "status", "created_at")
    p = product.select(F.col("id").alias("product_id"), "cat", "subcat",
                       F.col("name").alias("product_name"))
    c = customer.select(F.col("id").alias("customer_id"), F.col("name"), F.col("email"))
    return (
        item.withColumnRenamed("discount", "item_discount").join(o.join(c, "customer_id"), "order_id")
        .join(p, "product_id")
        .select("created_at", F.col("order_id").alias("invoice"), "staff_id", "order_disc",
                "status", "product_id", "serial", "cat", "subcat", "product_name", "quantity",
                "price", "item_discount",
                F.col("customer_id").alias("phone"), "name", "email")
    )


def statement_lines(item: DataFrame) -> DataFrame:
    return item.withColumn("line_amount", F.col("price") * F.col("quantity") - F.col("discount"))


def statements(item: DataFrame) -> DataFrame:
    """Subtotal, discount and total per order."""
    gross = F.col("price") * F.col("quantity")
    return item.groupBy("order_id").agg(
        F.sum(gross).alias("subtotal"), F.sum("discount").alias("discount"),
        F.sum(gross - F.col("discount")).alias("total"),
    )


def invoice_list(orders: DataFrame, item: DataFrame, payment: DataFrame) -> DataFrame:
    """Pieces and money per invoice. Both sums are taken before the join, on scalars: no list is
    built to be summed."""
    pieces = item.groupBy("order_id").agg(F.sum("quantity").alias("quantity"))
    money = payment.groupBy("order_id").agg(F.sum("amount").alias("amount"))
    return (
        orders.select(F.col("id").alias("order_id"), "status", "created_at")
        .join(pieces, "order_id", "left").join(money, "order_id", "left")
        .select(F.col("order_id").alias("invoice"),
                F.coalesce("quantity", F.lit(0)).alias("quantity"),
                F.coalesce("amount", F.lit(0)).alias("amount"),
                local_time(F.col("created_at")).alias("created_at"), "status")
    )


def search(orders: DataFrame, keyword: str) -> DataFrame:
    """Orders created on the day of the store the keyword names (day first), else ids that end with
    it. The day becomes a range of UTC times, which a scan can push down."""
    day = to_day(F.lit(keyword))

    def midnight(d: Column) -> Column:
        return F.convert_timezone(F.lit(K.STORE_TIMEZONE), F.lit("UTC"), d.cast("timestamp_ntz"))

    by_day = (F.col("created_at") >= midnight(day)) & (F.col("created_at") < midnight(F.date_add(day, 1)))
    return orders.where(
        F.when(day.isNotNull(), by_day).otherwise(F.col("id").cast("string").endswith(keyword)))


def page(df: DataFrame, key: str, number: int, size: int = 5) -> DataFrame:
    """The ``number``-th page, newest id first; for pages near the start."""
    return df.orderBy(F.col(key).desc()).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last: int | None, size: int = 5) -> DataFrame:
    """The page that follows the id ``last`` (None: the first page), newest first. However far down,
    a task holds ``size`` rows."""
    rest = df if last is None else df.where(F.col(key) < last)
    return rest.orderBy(F.col(key).desc()).limit(size)


def entry_totals(item: DataFrame) -> DataFrame:
    """Order subtotal, discount and balance in one row over all lines."""
    gross = F.col("price") * F.col("quantity")
    return item.agg(total(gross).alias("subtotal"), total("discount").alias("discount"),
                    total(gross - F.col("discount")).alias("balance"))
