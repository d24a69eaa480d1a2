"""File sources: by extension, tabbed uploads, changed files, bundles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoptally.plans.registry import query
from shoptally.session import shared_folder
from shoptally.sources import files
from shoptally.sources import warehouse as W


@query("S3 S5", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def load_by_extension(spark, d):
    return files.load(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("S2 S5", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """Written with header as CSV, read back as text."""
    folder = shared_folder(spark, "table") + ".csv"
    rows = W.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    rows.write.option("header", True).csv(folder)
    return files.load(spark, folder)


TABS_SQL = "SELECT p_type AS tab, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part"


@query("S4", TABS_SQL)
def workbook_tabs(spark, d):
    """One CSV folder per tab, read as one frame with the tab's name."""
    folder = shared_folder(spark, "workbook")
    part = W.table(spark, d, "part").select(
        F.col("p_type").alias("tab"), F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"))
    part.write.partitionBy("tab").option("header", True).csv(folder)
    return files.tabs(spark, folder, ["id", "name"])


@query("S5", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("orders", "lineitem", "customer")))
def bundle_row_counts(spark, d):
    """A bundle of named files; one is missing and one has an unknown format."""
    names = ("orders", "lineitem", "customer", "no_such_table")
    found = files.bundle(spark, {
        **{n: f"{d}/{n}.parquet" for n in names}, "notes": f"{d}/notes.docx"})
    counts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows")
              for n, df in found.items()]
    return reduce(DataFrame.unionByName, counts)


@query("S7", "SELECT count(*) AS n_rows FROM lineitem")
def changed_since(spark, d):
    """Files changed after 1960: all of them."""
    rows = files.modified_after(spark, f"{d}/lineitem.parquet", datetime(1960, 1, 1))
    return rows.agg(F.count("*").alias("n_rows"))
