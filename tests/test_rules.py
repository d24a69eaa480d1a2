"""Edge rules on small hand-written frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shoptally.functions.columns import distinct_with_null, fixed, total
from shoptally.functions.rules import category_rank, discount_amount, signed_quantity
from shoptally.operators import (
    apply_upload, carts, clean, copies, inventory, invoices, kinds, ledger, metrics, periods, upload, upsert,
)

ROW = "product_id string, serial string, type string, quantity bigint"


def day(text):
    return dt.date.fromisoformat(text)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- periods ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def march(spark):
    first = day("2024-01-01")
    rows = [(first + dt.timedelta(i),) for i in range(91)]  # up to 2024-03-31
    return spark.createDataFrame(rows, "date date")


def ends(df):
    r = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).first()
    return r["lo"], r["hi"]


@pytest.mark.parametrize("args, expected", [
    ({"mode": "month_so_far"}, ("2024-03-01", "2024-03-31")),
    ({"mode": "last_month_days"}, ("2024-03-03", "2024-03-31")),  # February has 29 days
    ({"mode": "last_xy", "x": 1, "unit": "mo"}, ("2024-03-01", "2024-03-31")),
    ({"mode": "last_xy", "x": 1, "unit": "mo", "head": True}, ("2024-02-01", "2024-03-31")),
    ({"mode": "last_xy", "x": 1, "unit": "mo", "head": True, "tail": True},
     ("2024-02-01", "2024-02-29")),
    ({"mode": "last_xy", "x": 1, "unit": "w", "head": True}, ("2024-03-18", "2024-03-31")),
    ({"mode": "last_xy", "x": 5, "unit": "d", "head": True, "tail": True},
     ("2024-03-27", "2024-03-31")),
    ({"mode": "custom"}, ("2024-03-25", "2024-03-31")),
    ({"mode": "custom", "start": day("2024-02-10"), "end": day("2024-02-12")},
     ("2024-02-10", "2024-02-12")),
])
def test_slice_bounds(march, args, expected):
    assert ends(periods.current(march, **args)) == tuple(map(day, expected))


def test_previous_period_is_as_long_and_touches(march):
    cur = periods.current(march, "custom", start=day("2024-03-11"), end=day("2024-03-20"))
    assert ends(periods.previous(march, cur)) == (day("2024-03-01"), day("2024-03-10"))


def test_anchor_row(march):
    row = periods.anchor_row(march).first()
    assert row["prev_month_count"] == 29 and row["this_month_name"] == "March"


def test_bucket_falls_back_to_the_first(march):
    assert ends(periods.bucket(march, march, "1mo", 1)) == (day("2024-02-01"), day("2024-02-29"))
    assert ends(periods.bucket(march, march, "1mo", 99)) == (day("2024-01-01"), day("2024-01-31"))


def test_date_bound_reaches_a_partitioned_scan(spark, march, tmp_path):
    folder = str(tmp_path / "facts")
    march.withColumn("qty", F.lit(1)).write.partitionBy("date").parquet(folder)
    facts = spark.read.parquet(folder)
    plan = periods.current(facts, "month_so_far")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "qty" in x)
    assert "PartitionFilters: [isnotnull(date" in scan and "Subquery" in scan


# --- NULL rules --------------------------------------------------------------------------------
def test_null_is_a_distinct_value_and_empty_sums_are_zero(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (1, "a"), (2, None)], "k int, lot string")
    assert values(df.groupBy("k").agg(distinct_with_null("lot").alias("n")), "k", "n") == [
        (1, 2), (2, 1)]
    none = spark.createDataFrame([], "x bigint")
    assert none.agg(total("x").alias("t")).first()["t"] == 0


def test_trend_fills_missing_days(spark):
    df = spark.createDataFrame([(day("2024-01-01"), 5), (day("2024-01-03"), 7)], "date date, qty bigint")
    out = values(metrics.trend(df, "1d", {"qty": "sum"}), "period", "qty")
    assert out == [(day("2024-01-01"), 5.0), (day("2024-01-02"), 0.0), (day("2024-01-03"), 7.0)]


@pytest.mark.parametrize("x, text", [
    (11.45, "11.4"), (11.35, "11.3"), (0.25, "0.2"), (0.35, "0.3"), (2.5, "2.5"), (0.05, "0.1"),
])
def test_fixed_agrees_with_exact_rounding(spark, x, text):
    got = spark.range(1).select(fixed(F.lit(x), 1).alias("t")).first()["t"]
    assert got == text == f"{x:.1f}"


# --- cleaning ------------------------------------------------------------------------------------
@pytest.mark.parametrize("name, kind", [
    ("date", "date"), ("date_traffic", None), ("sub_cat", None), ("cat", "category"),
    ("disc_amount", "numeric"), ("amount", "revenue"), ("id", "phone"), ("ean", "string"),
    ("invoice", "string"), ("created_at", "date"), ("is_active", None), ("status", "boolean"),
])
def test_kind_by_name(name, kind):
    assert kinds.kind_by_name(name) == kind


def test_value_thresholds(spark):
    def column(values):
        return spark.createDataFrame([(v,) for v in values], "c string")

    def kind(values):
        return kinds.kinds(column(values))["c"]

    assert kind(["yes"] * 90 + ["maybe"] * 10) == "boolean"
    assert kind(["yes"] * 89 + ["maybe"] * 11) == "category"
    assert kind(["0123456789"] * 5) == "phone"
    assert kind(["x" * 40 + str(i) for i in range(34)]) == "string"
    assert kind(["x" * 40 + str(i) for i in range(33)]) == "category"
    assert kind(["2.5"] * 81 + [f"w{i}" for i in range(19)]) == "string"
    assert kind(["2.5"] * 80 + [f"w{i % 9}" for i in range(20)]) == "category"
    assert kind(["2024-01-05"] * 9 + ["later"]) == "date"
    assert kind([None, None]) == "string"
    assert kind(["11.5"] * 10) == "numeric"
    assert kind(["2024-01-05 08:30:00"] * 9 + ["later"]) == "date"
    assert kind(["05/01/2024 8:30"] * 9 + ["later"]) == "date"


SHEET = ("date date, invoice string, staff string, ean string, sku string, cat string, qty double, "
         "price double, revenue double, disc_percent double, disc_amount double, cash double, "
         "card double, payoo double, banking double, mkt_promo double, vnpay double, trade_in double")


def sale(**changes):
    row = dict(date=day("2024-01-02"), invoice="1", staff="s", ean="e", sku="k", cat="c", qty=2.0,
               price=10.0, revenue=20.0, disc_percent=None, disc_amount=None, cash=None, card=None,
               payoo=None, banking=None, mkt_promo=None, vnpay=None, trade_in=None)
    return tuple({**row, **changes}.values())


def test_validate_leaves_a_sheet_without_gaps_alone(spark):
    df = spark.createDataFrame([sale(), sale(qty=0.0)], SHEET)
    assert clean.validate(df).count() == 2


def test_validate_repairs_and_drops(spark):
    df = spark.createDataFrame([
        sale(invoice="paid", revenue=None, cash=8.0, card=4.0),
        sale(invoice="lost", revenue=None),
        sale(invoice="priced", price=None, disc_percent=0.5, disc_amount=1.0),
        sale(invoice="none", qty=0.0), sale(invoice="nobody", staff=None),
    ], SHEET)
    out = values(clean.validate(df), "invoice", "price", "revenue")
    assert out == [("paid", 10.0, 12.0), ("priced", 21.0, 20.0)]


def test_dates_are_full_dates(spark):
    df = spark.createDataFrame([("2024-1",), ("2024-1-5",), ("05/01/2024",), ("2024-13-01",)], "t string")
    got = [r["d"] for r in df.select(kinds.to_day(F.col("t")).alias("d")).collect()]
    assert got == [None, day("2024-01-05"), day("2024-01-05"), None]


def test_a_column_of_date_times_keeps_its_days(spark):
    df = spark.createDataFrame([("2024-03-01 08:30:00",), ("01/03/2024 08:30",), ("2024-03-01T23:59:59.5Z",)],
                               "seen string")
    found = kinds.kinds(df)
    assert found == {"seen": "date"}
    assert {r["seen"] for r in kinds.cast_by_kind(df, found).collect()} == {day("2024-03-01")}


def test_search_by_day_uses_the_stores_day(spark):
    df = spark.createDataFrame([(1, "2024-03-01 16:59:59"), (2, "2024-03-01 17:00:00"), (3, "2024-03-02 16:59:59")],
                               "id bigint, t string").select("id", F.col("t").cast("timestamp_ntz").alias("created_at"))
    assert [r["id"] for r in invoices.search(df, "02/03/2024").orderBy("id").collect()] == [2, 3]


def test_pages_follow_the_last_id(spark):
    df = spark.range(1, 13).withColumnRenamed("id", "invoice")
    first = [r[0] for r in invoices.page_after(df, "invoice", None).collect()]
    assert first == [12, 11, 10, 9, 8]
    assert [r[0] for r in invoices.page_after(df, "invoice", 8).collect()] == [7, 6, 5, 4, 3]


# --- ledger ------------------------------------------------------------------------------------------
def judged(spark, batch, past):
    rows = [(i, *r) for i, r in enumerate(batch)]
    out = ledger.judge(spark.createDataFrame(rows, "id bigint, " + ROW), spark.createDataFrame(past, ROW))
    return {r["id"]: (r["stock_ok"], r["serial_ok"], r["cap_ok"]) for r in out.collect()}


def test_cumulative_stock_counts_earlier_rows_of_the_batch(spark):
    batch = spark.createDataFrame([(i, "p", None, "transfer", 3) for i in range(3)], "id bigint, " + ROW)
    past = spark.createDataFrame([("p", None, "import_po", 6)], ROW)
    for order, want in ((None, [True, True, True]), ("id", [True, True, False])):
        got = ledger.judge(batch, past, order).orderBy("id").collect()
        assert [r["stock_ok"] for r in got] == want


def test_rows_are_judged_alone_against_the_stock_before(spark):
    past = [("p", None, "import_po", 5)]
    got = judged(spark, [("p", None, "transfer", 4), ("p", None, "transfer", 4),
                         ("p", None, "transfer", 6), ("new", None, "transfer", 1),
                         ("new", None, "import_po", 1)], past)
    assert [got[i][0] for i in range(5)] == [True, True, False, False, True]


def test_serial_rules(spark):
    past = [("p", "s1", "import_po", 1), ("q", None, "import_po", 9)]
    got = judged(spark, [("p", "s1", "import_po", 1), ("p", None, "import_po", 1),
                         ("q", "s2", "import_po", 1), ("p", "", "import_po", 1)], past)
    assert got[0] == (True, True, False)   # second copy of a serial in stock
    assert got[1][1] is False and got[2][1] is False and got[3][1] is False


def test_batch_is_booked_whole_or_not_at_all(spark):
    past = spark.createDataFrame([("p", None, "import_po", 5)], ROW)
    good = spark.createDataFrame([("p", None, "transfer", 5), ("z", None, "import_do", 1)], ROW)
    bad = good.unionByName(spark.createDataFrame([("y", None, "rtv", 1)], ROW))
    booked, refused = ledger.admit(good, past)
    assert booked.count() == 2 and refused.count() == 0
    booked, refused = ledger.admit(bad, past)
    assert booked.count() == 0 and ("product_id", "y") in values(refused, "field", "value")
    wrong_type = spark.createDataFrame([("p", None, "sell", 1)], ROW)
    assert ledger.admit(wrong_type, past)[0].count() == 0


def test_cancel_twice_is_cancel_once(spark):
    orders = spark.createDataFrame([(1, "completed"), (2, "cancelled")], "id bigint, status string")
    moves = spark.createDataFrame(
        [("p", None, "sell", 2, 1), ("p", None, "sell", 1, 2)], ROW + ", order_id bigint")
    asked = spark.createDataFrame([(1,), (2,), (1,)], "id bigint")
    after, mirror = ledger.cancel(asked, orders, moves)
    assert values(mirror, "product_id", "quantity", "order_id") == [("p", 2, 1)]
    assert ledger.cancel(asked, after, moves)[1].count() == 0


def test_signs(spark):
    df = spark.createDataFrame([("gift", 3), ("sell", 3), ("return", 3)], "type string, quantity bigint")
    strict = signed_quantity(F.col("type"), F.col("quantity"), unknown="zero")
    assert values(df.select("type", strict.alias("s")), "type", "s") == [
        ("gift", 0), ("return", 3), ("sell", -3)]


# --- checkout -----------------------------------------------------------------------------------------
def test_no_history_refuses_the_whole_cart(spark):
    lines = spark.createDataFrame(
        [(1, "p", None, 2, 10, 0), (1, "unknown", None, 1, 10, 0), (2, "p", None, 5, 10, 0),
         (3, "p", None, 6, 10, 0)],
        "cart_id bigint, sku string, serial string, quantity bigint, price bigint, discount bigint")
    past = spark.createDataFrame([("p", None, "import_po", 5)], ROW)
    heads = spark.createDataFrame([(1, "c", "s", 0), (2, "c", "s", 0), (3, "c", "s", 0)],
                                  "cart_id bigint, customer_id string, staff_id string, discount int")
    paid = spark.createDataFrame([(2, "cash", 50)], "cart_id bigint, method string, amount bigint")
    orders, items, payments, moves, refused = carts.check_out(heads, lines, paid, past)
    assert values(orders, "cart_id", "order_id") == [(2, 10_000_000)]
    assert values(payments, "order_id", "amount") == [(10_000_000, 50)]
    assert values(moves, "type", "quantity") == [("sell", 5)] and items.count() == 1
    assert values(refused, "cart_id", "n_refused") == [(1, 1), (3, 1)]


@pytest.mark.parametrize("text, amount", [
    ("10", 60), ("10%", 60), ("150", 150), ("0", 0), ("abc", 0), ("1 0%", 60), ("", 0), ("%5", 0),
    ("999", 0),
])
def test_discount_text(spark, text, amount):
    df = spark.createDataFrame([(text, 200, 3)], "t string, p bigint, q bigint")
    assert df.select(discount_amount(F.col("t"), F.col("p"), F.col("q")).alias("a")).first()["a"] == amount


def test_cart_merges_lines_and_keeps_null_serials(spark):
    rows = [(1, "p", None, 2, "n", 10, 0, 3, 1), (1, "p", None, 2, "n", 10, 0, 3, 2),
            (1, "p", "s", 4, "n", 10, 0, 3, 3)]
    df = spark.createDataFrame(rows, "cart_id int, sku string, serial string, quantity bigint, "
                               "name string, price int, discount int, stock bigint, line int")
    got = {r["serial"]: r["quantity"] for r in carts.consolidate(df).collect()}
    assert got == {None: 3, "s": 1}


def test_payments(spark):
    due = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 0)], "cart_id int, balance bigint")
    entries = spark.createDataFrame(
        [(1, "cash", "x"), (2, "cash", "60"), (2, "card", "40"), (3, "cash", "60"), (3, "card", "4x")],
        "cart_id int, method string, entered string")
    got = values(carts.reconcile(due, carts.payments(due, entries)), "cart_id", "verdict", "delta")
    assert got == [(1, "save", 0), (2, "save", 0), (3, "remaining", -40), (4, "empty", 0)]


# --- upserts and uploads --------------------------------------------------------------------------------
def test_every_copy_of_a_duplicate_goes(spark):
    batch = spark.createDataFrame(
        [("a", 1, "c", None, "n", 5), ("a", 2, "c", None, "n", 5), ("b", 3, "c", None, "  ", 5),
         ("d", 4, "c", " x ", "n", 0), ("e", 5, "c", None, "n", None)],
        "id string, ean bigint, cat string, subcat string, name string, price bigint")
    valid = upsert.valid_products(batch)
    assert values(valid, "id") == [("d",), ("e",)] and upsert.priced(valid).count() == 0
    none = spark.createDataFrame([], "id string, product_id string, price bigint, is_active boolean")
    report = upsert.products(batch, none.select("id"), none)[3].first()
    assert (report["status"], report["invalid"], report["product"]) == ("partial", 3, 2)


def test_price_history(spark):
    price = spark.createDataFrame([(1, "same", 5, True), (2, "moved", 5, True), (3, "off", 5, False)],
                                  "id int, product_id string, price int, is_active boolean")
    new = spark.createDataFrame([("same", 5), ("moved", 6), ("off", 5), ("first", 9)],
                                "product_id string, new_price int")
    assert values(upsert.retire_prices(price, new), "id", "is_active") == [(1, True), (2, False), (3, False)]
    assert values(upsert.added_prices(price, new), "product_id", "price") == [
        ("first", 9), ("moved", 6), ("off", 5)]


def test_a_taken_email_keeps_the_batch_out(spark):
    schema = "id string, name string, email string"
    known = spark.createDataFrame([("1", "a", "a@x.io")], schema)
    rows, report = upsert.customers(
        spark.createDataFrame([("2", "b", "a@x.io"), ("3", "c", None), ("4", "d", None)], schema), known)
    assert rows.count() == 0 and report.first()["code"] == "error"
    rows, report = upsert.customers(spark.createDataFrame([("3", "c", None), ("4", "d", None)], schema), known)
    assert rows.count() == 2 and report.first()["code"] == "01"
    rows, report = upsert.customers(spark.createDataFrame([("1", "z", None)], schema), known)
    assert report.first()["code"] == "02"


def test_repeats_are_found_before_priceless_rows_go(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("b", 3, 5)], "id string, ean int, price int")
    assert upload.product_check(df).first().asDict() == {"no_price": 1, "dup_id": 1, "dup_ean": 0}
    assert upload.checked_products(df).count() == 0
    assert upload.checked_products(df.where("ean <> 2")).count() == 2


def test_sheet_columns_are_a_closed_set(spark):
    with pytest.raises(ValueError):
        upload.usable_rows(spark.createDataFrame([("a",)], "id string"))


SHEET_ROW = ("line int, ean bigint, id string, cat string, subcat string, name string, price int, "
             "serial string, quantity bigint, type string, transaction_id string")


def test_movements_follow_only_a_finished_product_step(spark):
    def run(rows, known):
        product = spark.createDataFrame([(k, i) for i, k in enumerate(known)], "id string, ean bigint")
        price = spark.createDataFrame([(i, k, 5, True) for i, k in enumerate(known)],
                                      "id int, product_id string, price int, is_active boolean")
        shelf = spark.createDataFrame([(k, 5) for k in known], "id string, price int")
        past = spark.createDataFrame([], ROW)
        sheet = spark.createDataFrame(rows, SHEET_ROW)
        return apply_upload.apply(sheet, product, price, past, shelf).outcome.first().asDict()

    def line(key, money):
        return (1, ord(key), key, "c", None, "n", money, None, 2, "import_po", "t")

    assert run([line("a", 5)], ["z"]) == {
        "needed": True, "status": "success", "moves": 1, "applied": 1}
    assert run([line("a", 5)], ["a"]) == {
        "needed": False, "status": "not needed", "moves": 1, "applied": 1}
    assert run([line("a", 6)], ["a"]) == {
        "needed": True, "status": "partial", "moves": 1, "applied": 0}


def test_category_rank(spark):
    names = ["All cats", "iPhone", "iPad", "Mac", "Watch", "Accessory", "Zeta", "9x", "", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["r"] for r in df.select(category_rank(F.col("n")).alias("r")).collect()]
    assert got == [0, 1, 2, 2, 2, 4, 3, 5, 5, 5]


# --- groups that do not fit one task ------------------------------------------------------------------------
def test_a_hot_invoice_continues_in_parts(spark):
    rows = [(i, 1, f"p{i}", f"s{i}" if i % 2 else None) for i in range(25)] + [(90, 2, "p0", None)]
    item = spark.createDataFrame(rows, "id bigint, order_id bigint, product_id string, serial string").select(
        "*", F.lit(1).alias("quantity"), F.lit(Decimal("1.00")).alias("price"), F.lit(0).alias("discount"))
    product = spark.createDataFrame([(f"p{i}", "n") for i in range(25)], "id string, name string")
    orders = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "id bigint, customer_id string").select(
        "*", F.lit("completed").alias("status"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    customer = spark.createDataFrame([("c", "n", None)], "id string, name string, email string")
    payment = spark.createDataFrame([(7, 1, "cash", 5)], "id bigint, order_id bigint, method string, amount bigint")
    moves = item.select("id", "order_id", "product_id", "serial", F.lit("sell").alias("type"),
                        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    docs = invoices.documents(orders, customer, item, product, payment, moves, part_rows=10)
    hot = [r for r in docs.orderBy("id", "part").collect() if r["id"] == 1]
    assert [len(r["product_id"]) for r in hot] == [10, 10, 5]
    assert [p for r in hot for p in r["product_id"]] == [f"p{i}" for i in range(25)]
    assert [s for r in hot for s in r["serial"]] == [f"s{i}" if i % 2 else None for i in range(25)]
    assert hot[0]["method"] == ["cash"] and hot[1]["method"] is None
    small = {r["id"]: r for r in docs.collect() if r["id"] > 1}
    assert small[2]["serial"] == [None] and small[3]["product_id"] is None and small[3]["part"] == 0


def test_invoices_beyond_one_task_are_placed_by_ranges(spark, monkeypatch):
    """Orders of few entries cross one shuffle; one of many (and one of none) comes out the same."""
    rows = [(i, o, f"p{i % 3}", None if i % 4 else f"s{i}") for o, n in ((1, 30), (2, 7), (3, 1)) for i in range(n)]
    item = spark.createDataFrame(rows, "id bigint, order_id bigint, product_id string, serial string").select(
        "*", F.lit(1).alias("quantity"), F.lit(Decimal("1.00")).alias("price"), F.lit(0).alias("discount"))
    product = spark.createDataFrame([("p0", "n"), ("p1", "m")], "id string, name string")
    orders = spark.createDataFrame([(1, "c"), (2, "c"), (3, "d"), (4, "c"), (None, "c")], "id bigint, customer_id string").select(
        "*", F.lit("completed").alias("status"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    customer = spark.createDataFrame([("c", "n", None)], "id string, name string, email string")
    payment = spark.createDataFrame([(i, o, "cash", i) for o in (1, 2) for i in range(5)] + [(9, None, "cash", 1)],
                                    "id bigint, order_id bigint, method string, amount bigint")
    moves = item.select("id", "order_id", "product_id", "serial", F.lit("sell").alias("type"),
                        F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"))
    frames = (orders, customer, item, product, payment, moves)
    got = {}
    for limit in (0, 20, 10_000):
        monkeypatch.setattr(invoices, "PART_ROWS", limit)
        docs = invoices.documents(*frames, part_rows=4)
        got[limit] = sorted(map(str, docs.collect()))
    assert got[0] == got[20] == got[10_000] and len(got[0]) == 8 + 2 + 1 + 1 + 1
    whole = docs._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in whole and "Window" not in whole


def test_a_hot_product_lists_all_serials(spark):
    rows = [("p", f"s{i}", "import_po", 1) for i in range(500)] + [("q", "t", "import_po", 1)]
    out = inventory.serials(spark.createDataFrame(rows, ROW), part_rows=50).collect()
    hot = [r for r in out if r["product_id"] == "p"]
    assert sorted(s for r in hot for s in r["serial_list"]) == sorted(f"s{i}" for i in range(500))
    assert [len(r["serial_list"]) for r in hot] == [50] * 10


def test_every_item_line_comes_out_once(spark):
    """Payments never multiply lines, and sparse ids need no more parts than dense ones."""
    item = spark.createDataFrame([(i * 10**7, 1, "p", 2) for i in range(4)],
                                 "id bigint, order_id bigint, product_id string, quantity int").select(
        "*", F.lit(None).cast("string").alias("serial"), F.lit(1).alias("price"), F.lit(0).alias("discount"))
    orders = spark.createDataFrame([(1, "c", "s", 0, "completed", "t")],
                                   "id bigint, customer_id string, staff_id string, discount int, status string, created_at string")
    product = spark.createDataFrame([("p", "n", "c", "u")], "id string, name string, cat string, subcat string")
    customer = spark.createDataFrame([("c", "n", "e")], "id string, name string, email string")
    payment = spark.createDataFrame([(i * 5 * 10**6, 1, "cash", i) for i in range(5)],
                                    "id bigint, order_id bigint, method string, amount bigint")
    lines = invoices.sales_lines(item, orders, product, customer)
    assert lines.agg(F.sum("quantity")).first()[0] == 8
    lists = invoices.payment_lists(payment, part_rows=2).orderBy("part").collect()
    assert [r["amount"] for r in lists] == [[0, 1], [2, 3], [4]]


def test_later_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "n int, k string")
    out = copies.mark_later_copies(df, "k", ["n"], "later")
    assert values(out.where("later"), "n") == [(2,), (4,)]
    assert values(copies.mark_all_copies(df, "k", "dup").where("dup"), "n") == [(1,), (2,)]


def test_a_sheet_is_typed_once_and_by_compiled_code(spark):
    from shoptally import constants as K
    from shoptally.operators import clean

    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")  # as in a session not built here
    row = {c: None for c in K.SALES_COLUMNS} | {
        "date": "2024-02-29", "invoice": "7", "staff": " An ", "ean": "12", "sku": "s", "qty": "2", "revenue": "10"}
    schema = ", ".join(f"`{c}` string" for c in K.SALES_COLUMNS)
    try:
        raw = spark.createDataFrame([tuple(row.values())], schema)
        got = clean.clean_sheet(raw)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "trim" not in plan.lower() and "rlike" not in plan.lower()
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
        (r,) = got.collect()
        assert (r["staff"], r["qty"], r["revenue"], r["price"], r["month"]) == ("An", 2, 10.0, 5.0, "2024-02")
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
