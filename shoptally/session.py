"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: the JVM compiles no method above 8000 bytes: wide projections run faster split up
_METHOD, _COMPILED = "spark.sql.codegen.hugeMethodLimit", "8000"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(app: str = "shoptally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even when the split costs one more exchange
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        _METHOD: _COMPILED,
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for ``purpose`` under the cluster's checkpoint folder."""
    use_checkpoints(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the cluster's shared folder: lineage ends here and nothing is computed
    twice. The files outlive a lost executor; the cluster's clean-up of the folder removes them."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def stored_meanwhile(df: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """``stored``, for as long as the block runs: then the files are deleted."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, purpose)
    try:
        df.write.option("compression", "zstd").parquet(folder)
        yield spark.read.schema(df.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """While the block runs, shuffle files go when the job that made them ends, also in streams that
    start in it. Otherwise they stay until the driver happens to collect its garbage, so a query of
    several jobs holds the files of all of them. For jobs whose results are written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def use_compiled_methods(spark: SparkSession) -> None:
    """For wide projections, in a session that ``build`` did not make. A lower limit is kept."""
    if int(spark.conf.get(_METHOD)) > int(_COMPILED):
        spark.conf.set(_METHOD, _COMPILED)


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable. The folder the cluster names is kept; only a local
    session that names none gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="shoptally-")
    context.setCheckpointDir(root)
