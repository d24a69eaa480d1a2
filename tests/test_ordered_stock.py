"""Running sums, carts that compete, the stock table and admission against it."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shoptally.functions.parts import with_positions
from shoptally.functions.running import placed, running
from shoptally.operators import carts, ledger
from shoptally.sources import balances
from shoptally.streaming import admission, stock, updates

ROW = "product_id string, serial string, type string, quantity bigint"


@pytest.fixture
def uncoalesced(spark):
    """Small ranges stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sums_of_a_hot_group(uncoalesced):
    spark = uncoalesced
    rng = random.Random(1)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {(r["k"], r["i"]): (r["s"], r["n"]) for r in running(df, ["k"], ["i"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    sums, counts = defaultdict(int), defaultdict(int)
    for k, i, v in rows:
        sums[k] += v or 0
        counts[k] += 1
        assert got[k, i] == (sums[k], counts[k])
    spread = placed(df.repartition(8), ["k"], ["i"]).where("k = 'hot'").groupBy("_range").count().collect()
    assert len(spread) > 3 and max(r["count"] for r in spread) < 1500  # no task has the whole group
    assert running(df.limit(0), ["k"], ["i"], {"s": F.col("v")}).count() == 0


def test_positions_are_dense_and_absent_without_a_key(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), ("b", 9)], "k string, i int")
    assert sorted(map(tuple, with_positions(df, ["k"], "i").collect()), key=repr) == sorted(
        [("a", 3, 1), ("a", 1, 0), (None, 2, None), ("b", 9, 0)], key=repr)


CART = "cart_id bigint, sku string, serial string, quantity bigint, price bigint, discount bigint"


def one_by_one(lines, past):
    held, out = defaultdict(lambda: None), {}
    for p, s, t, q in past:
        held[p, s] = (held[p, s] or 0) + (q if t == "import_po" else -q)
    for cart in sorted({r[0] for r in lines}):
        mine = [((r[1], r[2] or None), r[3]) for r in lines if r[0] == cart]
        out[cart] = all(q is not None and q > 0 and held[k] is not None and held[k] - q >= 0 for k, q in mine)
        if out[cart]:
            for k, q in mine:
                held[k] -= q
    return out


def test_the_last_piece_is_sold_once(spark):
    past = [("p", None, "import_po", 3), ("q", "s1", "import_po", 1)]
    lines = [(1, "p", None, 2, 1, 0), (2, "p", "", 2, 1, 0), (3, "p", None, 1, 1, 0), (4, "q", "s1", 1, 1, 0),
             (5, "q", "s1", 1, 1, 0), (6, "none", None, 1, 1, 0), (7, "p", None, None, 1, 0), (8, "q", "s1", 0, 1, 0)]
    got = carts.decide_in_order(spark.createDataFrame(lines, CART), spark.createDataFrame(past, ROW)).collect()
    assert {r["cart_id"]: r["accepted"] for r in got} == one_by_one(lines, past) == {
        1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}
    # each alone, both would get it
    alone = carts.verdicts(carts.judge(spark.createDataFrame(lines[:5], CART), spark.createDataFrame(past, ROW)))
    assert all(r["accepted"] for r in alone.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_competing_carts_against_one_by_one(uncoalesced, seed):
    spark = uncoalesced
    rng = random.Random(seed)
    past = [(f"p{i}", None, "import_po", rng.randint(0, 12)) for i in range(8)] + [("hot", None, "import_po", 40)]
    lines = [(c, "hot" if rng.random() < 0.4 else f"p{rng.randrange(9)}", None, rng.randint(1, 3), 1, 0)
             for c in range(60) for _ in range(rng.randint(1, 3))]
    got = carts.decide_in_order(spark.createDataFrame(lines, CART), spark.createDataFrame(past, ROW)).collect()
    assert len(got) == len({r[0] for r in lines})
    assert {r["cart_id"]: r["accepted"] for r in got} == one_by_one(lines, past)
    assert max(r["round"] for r in got) > 1


def test_no_carts_no_verdicts(spark):
    none = carts.decide_in_order(spark.createDataFrame([], CART), spark.createDataFrame([], ROW))
    assert none.count() == 0 and none.columns == ["cart_id", "accepted", "round"]


def pairs(df):
    return {(r["product_id"], r["serial"]): r["stock"] for r in df.collect()}


def test_stock_table_reads_only_its_buckets_and_compacts(spark, tmp_path):
    folder = str(tmp_path / "stock")
    rows = [(f"p{i}", None if i % 2 else f"s{i}", "import_po", 1 + i) for i in range(200)] + [(None, None, "import_po", 1)]
    balances.create(spark.createDataFrame(rows, ROW), folder, 16)
    asked = spark.createDataFrame([("p3",), ("p3",), ("none",), (None,)], "product_id string")
    held = balances.held(spark, folder, asked)
    assert pairs(held) == {("p3", None): 4}
    assert len({f.split("bucket=")[1].split("/")[0] for f in held.inputFiles()}) <= 2  # of 16
    for n in range(4):
        assert balances.add(spark.createDataFrame([("p3", None, "sell", 1), ("new", "x", "import_po", 1)], ROW), folder, "a", n)
    assert not balances.add(spark.createDataFrame([("p3", None, "sell", 1)], ROW), folder, "a", 3)  # booked already
    assert balances.applied(spark, folder, "a") == 3 and balances.applied(spark, folder, "b") == -1
    before, entries = pairs(balances.whole(spark, folder)), balances.manifest(spark, folder)[1]
    assert before["p3", None] == 0 and before["new", "x"] == 4 and len(before) == 201
    full = balances.compact(spark, folder, 3)
    after = balances.manifest(spark, folder)[1]
    assert 1 <= len(full) <= 2 and not [e for e in after if e[0] == "change"]
    assert {e[2] for e in after if e[0] == "base" and e[1] not in full} == {
        e[2] for e in entries if e[0] == "base" and e[1] not in full}  # untouched buckets keep their files
    assert pairs(balances.whole(spark, folder)) == before and balances.compact(spark, folder, 3) == []


def test_an_unfinished_manifest_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "stock")
    balances.create(spark.createDataFrame([("p", None, "import_po", 5)], ROW), folder, 4)
    (tmp_path / "stock/manifest/version=1").mkdir()  # an attempt that never committed
    assert balances.manifest(spark, folder)[0] == 0 and pairs(balances.whole(spark, folder)) == {("p", None): 5}


def test_admission_against_the_stock_table(spark, tmp_path):
    folder = {n: str(tmp_path / n) for n in ("in", "stock", "log", "refused", "cp", "cp2")}
    batches = [[("p", None, "import_po", 5)], [("p", None, "transfer", 4)],
               [("p", None, "transfer", 4), ("q", None, "import_po", 1)], [("p", None, "transfer", 1)],
               [("q", "s", "adjust_in", 1)], [("q", "s", "adjust_in", 1)], [("q", None, "adjust_in", 1)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{folder['in']}/{n:03d}")
    balances.create(spark.createDataFrame([], ROW), folder["stock"], 4)

    def run(cp):
        moves = (spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
                 .parquet(folder["in"]))
        admission.start_with_stock(moves, folder["stock"], folder["log"], folder["refused"], folder[cp], "t", 2).awaitTermination()

    run("cp")
    want = [(0, "import_po"), (1, "transfer"), (3, "transfer"), (4, "adjust_in")]
    booked = spark.read.parquet(folder["log"])
    assert sorted((r["number"], r["type"]) for r in booked.collect()) == want
    assert pairs(balances.whole(spark, folder["stock"])) == {("p", None): 0, ("q", "s"): 1}
    run("cp2")  # all batches again under the stream's name: every one was booked already
    assert sorted((r["number"], r["type"]) for r in spark.read.parquet(folder["log"]).collect()) == want


def test_rows_of_a_batch_in_order(spark):
    past = spark.createDataFrame([("p", None, "import_po", 5)], ROW)
    batch = spark.createDataFrame(
        [(1, "p", None, "transfer", 4), (2, "p", None, "transfer", 2), (3, "p", None, "import_po", 3)], f"i int, {ROW}")
    got = {r["i"]: r["stock_ok"] for r in ledger.judge(batch, past, "i").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_change_log_is_compacted(spark, tmp_path):
    src, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))

    def arrive(n, rows):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{src}/{n}")
        moves = spark.readStream.schema(ROW).option("recursiveFileLookup", True).parquet(src)
        updates.start(stock.balances(moves), log, cp).awaitTermination()

    arrive(0, [("p", None, "import_po", 5), ("q", None, "import_po", 1)])
    arrive(1, [("p", None, "sell", 2)])
    assert updates.compact(spark, log, ["product_id"]) == updates.compact(spark, log, ["product_id"]) == 1
    arrive(2, [("q", None, "sell", 1)])
    now = updates.latest(spark, log, ["product_id"])
    assert {r["product_id"]: r["stock"] for r in now.collect()} == {"p": 3, "q": 0}
    plan = now._jdf.queryExecution().optimizedPlan().toString() + now._jdf.queryExecution().simpleString()
    assert re.search(r"PartitionFilters: \[[^]]*batch#\d+ > 1", plan)  # older batches are not read
