"""Tables that are changed in place, follow a folder or answer searches by ending; bitmaps of ids."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptally.operators import uniques
from shoptally.sources import balances, endings, keyed, ledger_log, mirror, versions

LINE = T.StructType([T.StructField("value", T.StringType())])


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


def lines(spark, table):
    return sorted(r["value"] for r in mirror.rows(spark, table, LINE).collect())


def test_mirror_follows_new_replaced_and_vanished_files(spark, tmp_path):
    folder, table = tmp_path / "in +%é", str(tmp_path / "table")

    def look():
        return mirror.refresh(spark, str(folder), table, LINE, "text")

    assert look() == {} and lines(spark, table) == []
    put(folder, a="a1\na2", b="b1", c="", d="d1")
    assert look() == {"new": 3} and lines(spark, table) == ["a1", "a2", "b1", "d1"]
    assert look() == {"same": 3} and versions.newest(spark, table) == 0
    put(folder, a="a3\nlonger", e="e1")
    (folder / "b.txt").unlink()
    assert look() == {"same": 1, "replaced": 1, "new": 1, "vanished": 1}
    assert lines(spark, table) == ["a3", "d1", "e1", "longer"]
    (folder / "d.txt").rename(folder / "f.txt")
    assert look() == {"same": 2, "new": 1, "vanished": 1}
    mirror.compact(spark, table, LINE)
    assert lines(spark, table) == ["a3", "d1", "e1", "longer"] and look() == {"same": 3}
    put(folder, e="later")
    assert look() == {"same": 2, "replaced": 1} and lines(spark, table) == ["a3", "d1", "later", "longer"]


def test_mirror_keeps_its_version_when_a_look_fails(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    put(folder, a="a")
    mirror.refresh(spark, str(folder), table, LINE, "text")
    put(folder, b="b")
    with pytest.raises(Exception):
        mirror.refresh(spark, str(folder), table, LINE, "no-such-format")
    (tmp_path / "table/manifest/version=1").mkdir()  # begun, never complete
    assert lines(spark, table) == ["a"]
    assert mirror.refresh(spark, str(folder), table, LINE, "text")["new"] == 1
    assert lines(spark, table) == ["a", "b"] and versions.newest(spark, table) == 2


def test_stock_table_goes_on_after_an_unfinished_manifest(spark, tmp_path):
    folder = str(tmp_path / "stock")
    moves = spark.createDataFrame([("p", None, "import_po", 2)],
                                  "product_id string, serial string, type string, quantity bigint")
    balances.create(moves, folder)
    (tmp_path / "stock/manifest/version=1").mkdir()
    assert balances.add(moves, folder, "s", 0)
    assert [r["stock"] for r in balances.whole(spark, folder).collect()] == [4]


ORDER = "id bigint, status string"
MOVE = "product_id string, type string, serial string, quantity bigint, order_id bigint"


def files_of(folder):
    return {p for p in folder.rglob("*.parquet") if "schema" not in p.parts}


def test_cancelling_rewrites_only_its_buckets(spark, tmp_path):
    orders, log = str(tmp_path / "orders"), str(tmp_path / "log")
    rows = [(i, "cancelled" if i % 5 == 0 else "completed") for i in range(200)] + [(None, "completed")]
    keyed.create(spark.createDataFrame(rows, ORDER), orders, "id", buckets=16)
    moves = [("p", "sell", None, i + 1, i) for i in range(200)] + [("p", "import_po", None, 9, None)]
    ledger_log.append(spark.createDataFrame(moves, MOVE), log, "opening")
    before = files_of(tmp_path / "orders")
    asked = spark.createDataFrame([(3,), (3,), (5,), (777,), (None,)], "id bigint")
    touched = keyed.cancel_orders(asked, orders, log, "t")
    assert 0 < len(touched) <= 3
    assert all(f"_bucket={b}/" in str(p) for p in files_of(tmp_path / "orders") - before
               for b in [int(str(p).split("_bucket=")[1].split("/")[0])] if b in touched)
    assert {int(str(p).split("_bucket=")[1].split("/")[0]) for p in files_of(tmp_path / "orders") - before} <= set(touched)
    want = sorted(((i, "cancelled" if i == 3 else s) for i, s in rows), key=repr)
    assert sorted(map(tuple, keyed.whole(spark, orders).collect()), key=repr) == want
    keyed.cancel_orders(asked, orders, log, "t")  # repeated: nothing more is booked
    back = ledger_log.read(spark, log).where("type = 'return'").collect()
    assert [(r["order_id"], r["quantity"]) for r in back] == [(3, 4)]
    assert keyed.cancel_orders(asked.where("id is null"), orders, log, "none") == []


def test_a_failed_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    orders, log = str(tmp_path / "orders"), str(tmp_path / "log")
    keyed.create(spark.createDataFrame([(1, "completed"), (2, "completed")], ORDER), orders, "id", buckets=4)
    ledger_log.append(spark.createDataFrame([("p", "sell", None, 7, 1)], MOVE), log, "opening")
    asked = spark.createDataFrame([(1,)], "id bigint")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", broken)
        with pytest.raises(OSError):
            keyed.cancel_orders(asked, orders, log, "t")
    assert {r["status"] for r in keyed.whole(spark, orders).collect()} == {"completed"}
    keyed.cancel_orders(asked, orders, log, "t")
    assert {(r["id"], r["status"]) for r in keyed.whole(spark, orders).collect()} == {(1, "cancelled"), (2, "completed")}
    assert ledger_log.read(spark, log).where("type = 'return'").count() == 1
    with pytest.raises(ValueError):
        keyed.change(spark, orders, asked, lambda rows: rows.withColumn(
            "id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(50).cast("bigint")))))


def test_keyed_table_without_rows(spark, tmp_path):
    folder = str(tmp_path / "t")
    keyed.create(spark.createDataFrame([], ORDER), folder, "id")
    assert keyed.whole(spark, folder).columns == ["id", "status"] and keyed.whole(spark, folder).count() == 0
    keyed.change(spark, folder, spark.createDataFrame([(1,)], "id bigint"),
                 lambda rows: rows.unionByName(spark.createDataFrame([(1, "new")], ORDER)))
    assert [tuple(r) for r in keyed.whole(spark, folder).collect()] == [(1, "new")]


def test_prices_retire_and_follow(spark, tmp_path):
    folder = str(tmp_path / "p")
    price = "product_id string, price bigint, is_active boolean"
    keyed.create(spark.createDataFrame(
        [("a", 5, True), ("a", 4, False), ("b", 7, True), ("c", 1, True)], price), folder, "product_id")
    keyed.set_prices(spark.createDataFrame(
        [("a", 6), ("b", 7), ("new", 2)], "product_id string, new_price bigint"), folder)
    assert sorted(map(tuple, keyed.whole(spark, folder).collect())) == [
        ("a", 4, False), ("a", 5, False), ("a", 6, True), ("b", 7, True), ("c", 1, True), ("new", 2, True)]


def test_endings_are_a_range_of_the_index(spark, tmp_path):
    folder = str(tmp_path / "e")
    rng = random.Random(3)
    ids = [str(rng.randrange(10**6)) for _ in range(3000)] + ["é77", "A77", "a77", "77", "", None, "100%", "10_"]
    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int")
    endings.write(rows, "id", folder)
    for ending in ["77", "7", "a77", "é77", "0%", "_", "", "none", "123456789"]:
        got = sorted(r["n"] for r in endings.search(spark, folder, ending).collect())
        assert got == [n for n, i in enumerate(ids) if i is not None and i.endswith(ending)], ending
    plan = endings.search(spark, folder, "77")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(_reversed,77)" in plan
    endings.write(rows.limit(0), "id", str(tmp_path / "none"))
    assert endings.search(spark, str(tmp_path / "none"), "7").count() == 0


def test_bitmaps_count_as_distinct_does(spark):
    rng = random.Random(5)
    day = date(2024, 1, 29)
    rows = [(rng.choice([day + timedelta(rng.randrange(40)), None]), rng.choice([None, 0, 1, -1, -32768, 32768, 32769,
             rng.randrange(10**12), rng.randrange(90)]), rng.randrange(5)) for _ in range(3000)]
    rows.append((date(2025, 1, 1), None, None))
    facts = spark.createDataFrame(rows, "date date, a bigint, b int")
    bitmaps = uniques.daily_bitmaps(facts, ["a", "b"]).checkpoint()
    got = {(r["grain"], r["start"]): (r["a"], r["b"]) for r in uniques.by_grain(bitmaps, ["a", "b"]).collect()}

    def start(grain, d):
        if d is None or grain == "day":
            return d
        return d - timedelta(d.weekday()) if grain == "week" else d.replace(day=1)

    want = {}
    for grain in ("day", "week", "month"):
        for d, a, b in rows:
            held = want.setdefault((grain, start(grain, d)), (set(), set()))
            held[0].add(a)
            held[1].add(b)
    assert got == {k: (len(a - {None}), len(b - {None})) for k, (a, b) in want.items()}
    plan = uniques.daily_bitmaps(facts, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1
    assert uniques.by_grain(bitmaps.limit(0), ["a", "b"]).count() == 0


def test_strewn_ids_cost_no_wide_bitmaps(spark):
    facts = spark.range(2000).selectExpr("date'2024-01-01' AS date", "id * 40000 AS a", "id AS b")
    bitmaps = uniques.daily_bitmaps(facts, ["a", "b"]).checkpoint()
    assert bitmaps.schema["bits"].dataType.simpleString() == "bigint"
    assert {r["what"]: r["count"] for r in bitmaps.groupBy("what").count().collect()} == {"a": 2000, "b": 32}
    assert "SortAggregate" not in uniques.daily_bitmaps(facts, ["a"])._jdf.queryExecution().executedPlan().toString()
