"""Streams over several micro-batches, numbering, tabbed sheets, log folders."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from shoptally import session
from shoptally.functions.numbering import numbered
from shoptally.operators import clean, ledger
from shoptally.plans import all_queries
from shoptally.session import shared_folder, shuffles_removed
from shoptally.sources import files, ledger_log
from shoptally.streaming import admission, events, stock, updates

ROW = "product_id string, serial string, type string, quantity bigint"


def land(spark, rows, folder, number):
    """One file per batch, so that each is a micro-batch of its own."""
    path = f"{folder}/{number:03d}"
    spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(path)


def arrivals(spark, folder):
    return (spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True).parquet(folder))


def test_later_batches_see_what_earlier_ones_booked(spark, tmp_path):
    src = str(tmp_path / "in")
    land(spark, [("p", None, "import_po", 5)], src, 0)
    land(spark, [("p", None, "transfer", 4)], src, 1)
    land(spark, [("p", None, "transfer", 4), ("q", None, "import_po", 1)], src, 2)
    land(spark, [("p", None, "transfer", 1)], src, 3)
    log, refused = str(tmp_path / "log"), str(tmp_path / "refused")
    none = spark.createDataFrame([], ROW)
    admission.start(arrivals(spark, src), none, log, refused, str(tmp_path / "cp")).awaitTermination()
    booked = spark.read.parquet(log)
    assert sorted((r["number"], r["type"], r["quantity"]) for r in booked.collect()) == [
        (0, "import_po", 5), (1, "transfer", 4), (3, "transfer", 1)]
    bad = spark.read.parquet(refused).collect()
    assert [(r["number"], r["field"], r["value"]) for r in bad if r["field"] == "product_id"] == [
        (2, "product_id", "p")]


def test_balances_grow_with_appends(spark, tmp_path):
    src, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))
    land(spark, [("p", None, "import_po", 5), ("q", None, "gift", 9)], src, 0)
    updates.start(stock.balances(arrivals(spark, src)), log, cp).awaitTermination()
    land(spark, [("p", None, "sell", 2)], src, 1)
    updates.start(stock.balances(arrivals(spark, src)), log, cp).awaitTermination()
    got = {r["product_id"]: r["stock"] for r in updates.latest(spark, log, ["product_id"]).collect()}
    assert got == {"p": 3, "q": 0}


def test_late_events_are_left_out(spark, tmp_path):
    src, log, cp = (str(tmp_path / n) for n in ("in", "log", "cp"))
    schema = "ts timestamp, event_type string, value double"

    def put(rows, number):
        df = spark.createDataFrame(rows, "t string, event_type string, value double")
        df.select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.parquet(
            f"{src}/{number:03d}")

    def run():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", True).parquet(src))
        updates.start(events.tumbling(stream, "1w"), log, cp).awaitTermination()

    put([("2024-01-01 10:00:00", "view", 1.0), ("2024-01-07 23:00:00", "view", 2.0)], 0)
    put([("2024-02-01 00:00:00", "view", 4.0)], 1)
    run()
    put([("2024-01-02 10:00:00", "view", 50.0)], 2)
    run()
    got = {str(r["period"]): float(r["value"]) for r in
           updates.latest(spark, log, ["period", "event_type"]).collect()}
    assert got == {"2024-01-01": 3.0, "2024-01-29": 4.0}


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 5000).alias("k"))
    rows = numbered(df, ["k"], "n", 100).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(100, 5100))


def test_tabs_with_a_title_above_the_header(spark, tmp_path):
    for tab, first in (("imports", 1), ("returns", 5)):
        with open(tmp_path / f"{tab}.csv", "w") as f:
            f.write("Upload form\n,\nid,name\n" + "".join(f"{i},n{i}\n" for i in range(first, first + 3)))
    out = files.tabs(spark, str(tmp_path), ["id", "name"], skip=2)
    assert sorted((r["tab"], r["id"], r["name"]) for r in out.collect()) == [
        *[("imports", str(i), f"n{i}") for i in (1, 2, 3)],
        *[("returns", str(i), f"n{i}") for i in (5, 6, 7)]]


def test_tabs_with_header_on_top(spark, tmp_path):
    with open(tmp_path / "imports.csv", "w") as f:
        f.write("id,name\n1,n1\n")
    assert [tuple(r) for r in files.tabs(spark, str(tmp_path), ["id", "name"]).collect()] == [
        ("1", "n1", "imports")]


def test_unknown_formats_and_missing_files_are_left_out(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    found = files.bundle(spark, {"a": str(tmp_path / "a.parquet"), "b": str(tmp_path / "b.parquet"),
                                 "c": str(tmp_path / "c.docx")})
    assert list(found) == ["a"] and found["a"].count() == 3
    with pytest.raises(ValueError):
        files.load(spark, "notes.docx")


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([("p", None, "import_po", 5)], ROW)
    assert ledger_log.append(rows, folder, "a") == ledger_log.append(rows, folder, "a") == 10_000_000
    assert ledger_log.append(rows, folder, "b") == 10_000_001
    log = ledger_log.read(spark, folder)
    assert log.count() == 2
    assert ledger_log.stamp(rows, log).first()["batch_id"] == 10_000_002


def test_a_new_checkpoint_keeps_what_was_booked(spark, tmp_path):
    log, refused = str(tmp_path / "log"), str(tmp_path / "refused")
    none = spark.createDataFrame([], ROW)
    for run, rows in enumerate([[("p", None, "import_po", 5)], [("p", None, "transfer", 4)],
                                [("p", None, "transfer", 4)]]):
        src = str(tmp_path / f"in{run}")
        land(spark, rows, src, 0)
        admission.start(arrivals(spark, src), none, log, refused, str(tmp_path / f"cp{run}")).awaitTermination()
    booked = spark.read.parquet(log)
    assert sorted((r["type"], r["quantity"]) for r in booked.collect()) == [("import_po", 5), ("transfer", 4)]


def test_a_row_with_an_order_id_refuses_its_batch(spark, tmp_path):
    src, log = str(tmp_path / "in"), str(tmp_path / "log")
    wide = ROW + ", order_id bigint, note string"
    for number, order_id in enumerate((None, 99)):
        spark.createDataFrame([("p", None, "import_po", 5, order_id, "n")], wide).coalesce(1).write.parquet(
            f"{src}/{number}")
    stream = (spark.readStream.schema(wide).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    admission.start(stream, spark.createDataFrame([], ROW), log, str(tmp_path / "bad"),
                    str(tmp_path / "cp")).awaitTermination()
    booked = spark.read.parquet(log).collect()
    assert [(r["order_id"], r["note"]) for r in booked] == [(None, "n")]


def test_lists_and_rows_round_trip(spark):
    rows = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "s")], "cart int, n int, sku string, serial string")
    lists = ledger_log.to_lists(rows, ["cart"], "n", ["sku", "serial"])
    assert lists.first().asDict() == {"cart": 1, "sku": ["a", "b"], "serial": ["s", None]}
    back = ledger_log.to_rows(lists, ["sku", "serial"], ["cart"]).orderBy("pos").collect()
    assert [(r["pos"], r["sku"], r["serial"]) for r in back] == [(0, "a", "s"), (1, "b", None)]


def test_shared_folder_follows_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert os.path.dirname(one) == root.rstrip("/") and one != two


def test_positional_names_keep_extra_columns(spark):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    assert clean.rename_positional(df).columns == ["date", "invoice"]
    wide = spark.createDataFrame([tuple("x" * 28)], ", ".join(f"c{i} string" for i in range(28)))
    assert clean.rename_positional(wide).columns[-2:] == ["sub_cat", "c27"]


def test_three_batches_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from shoptally.plans import streams

    row = "id string, product_id string, serial string, type string, quantity bigint"
    rows = [(str(i), f"p{i}", None, "import_po" if i % 2 else "adjust_out", 1) for i in range(40)]
    monkeypatch.setattr(streams.W, "incoming", lambda s, d: s.createDataFrame(rows, row).repartition(4))
    monkeypatch.setattr(streams.W, "history", lambda s, d: s.createDataFrame(
        [("h", f"p{i}", None, "import_po", 1) for i in range(0, 40, 4)], row))
    monkeypatch.setattr(streams, "shared_folder", lambda s, purpose: str(tmp_path / purpose))
    got = streams.stream_ledger_booked(spark, "")
    assert {(r["id"], r["number"]) for r in got.collect()} == {
        (i, 0) for i, p, _, kind, _ in rows if kind == "import_po" or int(p[1:]) % 4 == 0}
    folder = tmp_path / "stream"
    assert len(list((folder / "in" / "1").glob("*.parquet"))) == 4
    assert sorted(p.name for p in (folder / "refused").glob("stream=*/*")) == ["number=0", "number=1", "number=2"]
    assert spark.read.parquet(str(folder / "refused")).count() > 0


def test_a_stamped_batch_is_judged_once(spark):
    from __spark_entry__ import SMALLEST
    from shoptally.plans.stock import ledger_batch_stamped

    plan = ledger_batch_stamped(spark, SMALLEST)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def recorded_folders(monkeypatch) -> dict[str, str]:
    made, make = {}, session.shared_folder

    def recording(spark, purpose):
        made[purpose] = make(spark, purpose)
        return made[purpose]

    for place in ("shoptally.session", "shoptally.plans.streams", "shoptally.plans.cleaning"):
        monkeypatch.setattr(f"{place}.shared_folder", recording)
    return made


@pytest.mark.parametrize("name, left", [("stream_ledger_booked", ["judged"]),
                                        ("stock_table_after_stream", ["arrived", "judged"])])
def test_streams_keep_no_judged_batches(spark, monkeypatch, name, left):
    made = recorded_folders(monkeypatch)
    assert all_queries()[name].run(spark, "/root/testdata/sf0.001").count() > 0
    assert os.path.exists(made["stream"].removeprefix("file:"))
    assert not [p for p in left if os.path.exists(made[p].removeprefix("file:"))]


def test_rows_of_a_batch_are_moved_once_to_be_judged(spark):
    row = "product_id string, serial string, type string, quantity bigint"
    batch = spark.createDataFrame([("x", "a", None, "sell", 1)], f"id string, {row}")
    past = spark.createDataFrame([("a", None, "import_po", 2)], row)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = ledger.judge(batch, past)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len(moved) > 3 and sum(", id#" in f", {columns}" for columns in moved) == 1


def test_shuffle_files_go_with_their_job(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    def write() -> None:
        rows = spark.range(1000).groupBy((F.col("id") % 70).alias("k")).count()
        rows.write.parquet(shared_folder(spark, "counted"))

    was = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    before = files()
    with shuffles_removed(spark):
        write()
        until = time.time() + 20
        while files() > before and time.time() < until:
            time.sleep(0.2)
        assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was


def test_the_sheet_is_kept_compressed(spark, monkeypatch):
    made = recorded_folders(monkeypatch)
    cleaned = all_queries()["sheet_cleaned_from_csv"].run(spark, "/root/testdata/sf0.001")
    names = [n for n in os.listdir(made["sheet"].removeprefix("file:")) if n.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    assert cleaned.count() > 0
