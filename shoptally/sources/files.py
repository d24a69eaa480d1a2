"""File sources: sales sheets, any known format by its extension, tabbed uploads, new files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"csv": "csv", "parquet": "parquet", "json": "json", "orc": "orc"}


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def sheet(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """A CSV sheet with header, every column as text: types are decided by the cleaning step.
    With ``names`` the header is not read up front."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if names:
        return reader.schema(text_schema(names)).option("enforceSchema", True).csv(path)
    return reader.option("inferSchema", False).csv(path)


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by extension (or ``fmt``)."""
    kind = FORMATS.get((fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower())
    if kind is None:
        raise ValueError(f"cannot read {path!r}: known formats are {', '.join(FORMATS)}")
    if kind == "csv":
        return sheet(spark, path)
    return spark.read.option("ignoreMissingFiles", True).format(kind).load(path)


def bundle(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The readable ones of several named files; unknown formats and missing files are left out."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = load(spark, path)
        except Exception as problem:  # a broken file must not hide the others
            if not _unreadable(problem):
                raise
    return found


def _unreadable(problem: Exception) -> bool:
    from pyspark.errors import AnalysisException

    return isinstance(problem, (ValueError, AnalysisException))


def file_name(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _tab(path: Column) -> Column:
    folder = F.nullif(F.regexp_extract(path, "/tab=([^/]+)/", 1), F.lit(""))
    return F.coalesce(folder, file_name(path))


def tabs(spark: SparkSession, folder: str, names: list[str], skip: int = 0) -> DataFrame:
    """A workbook kept as one CSV (``orders.csv``, or a folder ``tab=orders``) per tab: all tabs in
    one frame with the ``tab`` they came from.

    ``skip`` (0 to 3) lines stand above the header of each tab.
    """
    if not 0 <= skip <= 3:
        raise ValueError("a tab's header is in one of its first four lines")
    if skip == 0:
        rows = sheet(spark, folder, names)
        return rows.select(*names, _tab(F.col("_metadata.file_path")).alias("tab"))
    # Line numbers are only needed at the top of each file: rows of the first block are counted
    # from the first row id the scan gave that file.
    lines = spark.read.text(folder).select(
        "value", F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("slot"))
    top = lines.where(F.col("block") == 0).groupBy("path").agg(F.min("slot").alias("top"))
    below = (F.col("block") > 0) | (F.col("slot") - F.col("top") > skip)
    body = lines.join(top, "path").where(below & (F.trim("value") != ""))
    parsed = F.from_csv("value", ", ".join(f"`{n}` string" for n in names))
    return body.select(parsed.alias("r"), _tab(F.col("path")).alias("tab")).select(
        "r.*", "tab")


def modified_after(spark: SparkSession, path: str, moment: datetime, fmt: str = "parquet"
                   ) -> DataFrame:
    """Rows of the files changed after ``moment``; older files are not opened."""
    return spark.read.format(fmt).option(
        "modifiedAfter", moment.strftime("%Y-%m-%dT%H:%M:%S")).load(path)


def new_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet"
              ) -> DataFrame:
    """A stream over the files of a folder; its checkpoint remembers which were read. Run it with
    ``trigger(availableNow=True)`` to take what is new and stop."""
    return spark.readStream.format(fmt).schema(schema).load(folder)
