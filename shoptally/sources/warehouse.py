"""The back office's tables, read from the star-schema files of a data folder.

Every function reads whole files and returns a lazy frame. ``sales`` joins only the dimensions
whose columns are asked for: order, part, supplier and nation keys are declared foreign keys
(``operators.audit`` counts orphans), so an unused dimension changes no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _net() -> Column:
    """Line revenue after discount, exact."""
    price, off = F.col("l_extendedprice").cast(MONEY), F.col("l_discount").cast("decimal(4,2)")
    return (price * (1 - off)).cast("decimal(18,4)")


def _serial() -> Column:
    """A fifth of the products is tracked by serial; some of those have loose rows as well."""
    tracked = F.col("l_partkey") % 5 == 0
    loose = (F.col("l_partkey") % 3 == 0) & (F.col("l_linenumber") == 7)
    return F.when(
        tracked & ~loose,
        F.concat(F.lit("SN"), F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")),
    )


def _sales_columns() -> dict[str, Column]:
    day = F.to_date("o_orderdate")
    return {
        "date": day,
        "invoice": F.col("l_orderkey"),
        "store_id": F.col("n_name"),
        "staff": F.concat(F.lit("Staff_"), (F.col("l_suppkey") % 10).cast("string")),
        "sku": F.col("l_partkey").cast("string"),
        "product_name": F.col("p_name"),
        "cat": F.col("p_type"),
        "sub_cat": F.when(F.col("p_size") <= 45, F.col("p_brand")),
        "lot_number": F.when(
            F.col("l_linenumber") == 1,
            F.concat(F.lit("SN"), F.col("l_orderkey").cast("string"), F.lit("-"),
                     F.col("l_partkey").cast("string")),
        ),
        "qty": F.col("l_quantity").cast("bigint"),
        "revenue": _net(),
        "mkt_promo": (F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast("decimal(4,2)"))
        .cast("decimal(18,4)"),
        "date_traffic": (F.lit(50) + F.lit(3) * F.dayofmonth(day)).cast("bigint"),
    }


_ORDER = {"date", "date_traffic"}
_PART = {"product_name", "cat", "sub_cat"}
_STORE = {"store_id"}


def sales(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The flat sales fact, one row per invoice line, with the ``columns`` asked for."""
    made = _sales_columns()
    wanted = columns or tuple(made)
    out = table(spark, folder, "lineitem")
    if _ORDER & set(wanted):
        orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
        out = out.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if _PART & set(wanted):
        out = out.join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if _STORE & set(wanted):
        nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
        store = table(spark, folder, "supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey"))
        out = out.join(store, F.col("l_suppkey") == F.col("s_suppkey"))
    return out.select(*[made[c].alias(c) for c in wanted])


def ledger(spark: SparkSession, folder: str, lines: DataFrame | None = None) -> DataFrame:
    """Stock ledger: one movement per line, all eight types, serial rows of one piece. ``lines``
    may be a stream of the line table."""
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    kind = (
        F.when((flag == "A") & (status == "F"), "import_po")
        .when(flag == "A", "import_do")
        .when((flag == "R") & (status == "F"), "return")
        .when(flag == "R", "adjust_in")
        .when(status == "F", "sell")
        .when(line <= 2, "transfer")
        .when(line <= 4, "adjust_out")
        .otherwise("rtv")
    )
    serial = _serial()
    lines = table(spark, folder, "lineitem") if lines is None else lines
    return lines.select(
        _line_id().alias("id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        serial.alias("serial"),
        kind.alias("type"),
        F.when(serial.isNotNull(), 1).otherwise(F.col("l_quantity").cast("bigint"))
        .cast("bigint").alias("quantity"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").alias("created_at"),
        status.alias("phase"),
    )


def _line_id() -> Column:
    """Line id, unique within its order: text that sorts by line, product, supplier, quantity. Every
    number keeps all its digits."""
    parts = [("l_linenumber", 6), ("l_partkey", 12), ("l_suppkey", 12), ("l_quantity", 8)]
    return F.concat(*[F.lpad(F.col(c).cast("bigint").cast("string"), n, "0") for c, n in parts])


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Booked movements: the final lines."""
    return ledger(spark, folder).where(F.col("phase") == "F").drop("phase")


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Movements still to be booked: the open lines, all of manual types."""
    return (
        ledger(spark, folder).where(F.col("phase") == "O").drop("phase", "created_at", "order_id")
    )


def product(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        (F.lit(8930000000000) + F.col("p_partkey")).alias("ean"),
        F.col("p_type").alias("cat"),
        F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("subcat"),
        F.col("p_name").alias("name"),
    )


def price(spark: SparkSession, folder: str) -> DataFrame:
    """Price history: a current row per product (inactive for the largest sizes) and, for small
    sizes, an older inactive one."""
    part = table(spark, folder, "part")
    money = F.col("p_retailprice").cast(MONEY)
    rows = F.array(
        F.struct((F.col("p_partkey") * 2).alias("id"), money.alias("price"),
                 (F.col("p_size") <= 43).alias("is_active")),
        F.struct((F.col("p_partkey") * 2 + 1).alias("id"), (money - 1).cast(MONEY).alias("price"),
                 F.lit(False).alias("is_active")),
    )
    kept = F.when(F.col("p_size") < 10, rows).otherwise(F.slice(rows, 1, 1))
    return part.select(
        F.col("p_partkey").cast("string").alias("product_id"), F.explode(kept).alias("r")
    ).select("r.id", "product_id", "r.price", "r.is_active")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("Staff_"), (F.col("o_custkey") % 10).cast("string")).alias("staff_id"),
        F.lit(0).cast(MONEY).alias("discount"),
        F.when(F.col("o_orderstatus") == "F", "cancelled").otherwise("completed").alias("status"),
        # at every hour, so that the UTC day and the store's day differ for some orders
        (F.col("o_orderdate").cast("timestamp_ntz")
         + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("created_at"),
    )


def item(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        _serial().alias("serial"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        (F.col("l_extendedprice").cast(MONEY) * F.col("l_discount").cast("decimal(4,2)"))
        .cast("decimal(18,4)").alias("discount"),
    )


def payment(spark: SparkSession, folder: str) -> DataFrame:
    """One payment per order, a second one (voucher) for the low-priority orders."""
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "cash")
        .when(F.col("o_orderpriority") == "2-HIGH", "card")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "banking")
        .otherwise("vnpay")
    )
    money = F.col("o_totalprice").cast(MONEY)
    low = F.col("o_orderpriority") == "5-LOW"
    first = F.struct((F.col("o_orderkey") * 2).alias("id"), method.alias("method"),
                     F.when(low, money - 100).otherwise(money).cast(MONEY).alias("amount"))
    second = F.struct((F.col("o_orderkey") * 2 + 1).alias("id"), F.lit("voucher").alias("method"),
                      F.lit(100).cast(MONEY).alias("amount"))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.explode(F.when(low, F.array(first, second)).otherwise(F.array(first))).alias("p"),
    ).select("p.id", "order_id", "p.method", "p.amount")


def customer(spark: SparkSession, folder: str) -> DataFrame:
    """Customers; those in debt left no e-mail address."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.when(
            F.col("c_acctbal") >= 0,
            F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@shop.example")),
        ).alias("email"),
    )


def staff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))


def dirty_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with gaps: missing staff, quantity, price, revenue and discounts."""
    line = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    net = _net().cast("double")
    key = F.col("l_orderkey")
    paid = {
        "cash": F.when(F.col("o_orderpriority") == "1-URGENT", net),
        "card": F.when(F.col("o_orderpriority") == "2-HIGH", net),
    }
    nothing = F.lit(None).cast("double")
    return line.select(
        F.to_date("o_orderdate").alias("date"),
        key.alias("invoice"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_suppkey") % 53 != 0,
               F.concat(F.lit("Staff_"), (F.col("l_suppkey") % 10).cast("string"))).alias("staff"),
        F.col("l_partkey").alias("ean"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_returnflag").alias("cat"),
        F.when(key % 97 == 0, None).when(key % 89 == 0, 0).otherwise(F.col("l_quantity"))
        .cast("bigint").alias("qty"),
        F.when(key % 11 != 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(key % 7 != 0, net).alias("revenue"),
        F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("disc_percent"),
        F.when(F.col("l_linenumber") == 3, F.lit(1.0)).alias("disc_amount"),
        *[paid.get(c, nothing).alias(c) for c in
          ("cash", "card", "payoo", "banking", "mkt_promo", "vnpay", "trade_in")],
    )


def raw_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The sales sheet as it arrives: 29 text columns under working titles, padded text, two date
    forms, bad dates, prices and times, missing money, blank rows."""
    rows = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    line, level, key = F.col("l_linenumber"), F.col("o_orderpriority"), F.col("l_orderkey")
    net, none = _net().cast("string"), F.lit(None).cast("string")
    cells = [
        F.when((line == 3) & (F.col("p_size") == 9), "n/a")
        .when(line == 2, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "yyyy-MM-dd"))),
        key.cast("string"),
        F.when(F.col("l_suppkey") % 53 != 0,
               F.concat(F.lit("Staff_"), (F.col("l_suppkey") % 10).cast("string"), F.lit(" "))),
        (F.lit(8930000000000) + F.col("l_partkey")).cast("string"),
        F.col("p_type"),
        F.when(line == 1, F.concat(F.lit("SN"), key.cast("string"))),
        F.col("l_partkey").cast("string"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")),
        F.when((line == 4) & (F.col("p_size") < 10), "abc").when(line != 5, F.col("l_extendedprice")
                                                                 .cast(MONEY).cast("string")),
        F.when(line == 6, "0").otherwise(F.col("l_quantity").cast("bigint").cast("string")),
        F.col("l_discount").cast("decimal(4,2)").cast("string"),
        none,
        F.when((line != 4) & (line != 2), net),
        F.when(level == "1-URGENT", net),
        F.when(level == "2-HIGH", net),
        none, none, none, none, none,
        F.when(F.col("p_size") < 40, F.concat(F.lit("c"), F.col("o_custkey").cast("string"),
                                              F.lit("@shop.example"))),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")),
        F.concat(F.lit("09"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")),
        F.when(line == 7, "25:99").otherwise("08:30:00"),
        (F.lit(50) + F.lit(3) * F.dayofmonth("o_orderdate")).cast("string"),
        F.when(F.col("p_size") % 3 == 0, "yes").otherwise("No"),
        F.when(F.col("p_size") <= 45, F.col("p_brand")),
        F.when(line == 1, "Gift wrap"),
        # date-times under a title that does not tell
        F.when(line == 2, F.date_format("o_orderdate", "dd/MM/yyyy 17:05")).otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd 08:30:00")),
    ]
    blank = (F.col("l_returnflag") == "N") & (line == 7)
    titles = [f"Title {i}" for i in range(1, len(cells) - 1)] + [" Extra Note ", "Seen At"]
    return rows.select(*[F.when(~blank, c).alias(t) for c, t in zip(cells, titles)])
