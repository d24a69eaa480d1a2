"""From raw documents to training sequences: five filtering stages, each a table of its own.

Every stage reads what the stage before it kept, and its decisions take effect: toxic texts go, texts
of no known language go, one of equal texts stays, one of each class of near duplicates stays, and
what remains is packed. All stages but the last return the columns of the table they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptally.llm import exact_dedup, language, near_dedup, packing, toxicity
from shoptally.llm.common import fold, table, written


def _row(docs: DataFrame):
    """All columns as one, so a column of any name can go along."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rows predicted toxic go."""
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, net, [_row(docs)], F.col("text")).where("predicted = 0").select("_row.*")


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rows the language models reject go."""
    model = language.trained(docs, F.coalesce(fold(F.col("doc_id"), 3) != 1, F.lit(True)))
    return language.predict(docs, model, [_row(docs)], F.col("text")).where("NOT rejected").select("_row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the row with the smallest id stays."""
    return exact_dedup.survivors(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of a class of near duplicates the row with the smallest id stays."""
    return near_dedup.survivors(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the pieces of all that is left."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("language", of_known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: trained models and sampled signatures have no SQL form: see tests/llm
ORACLE_SQL = None
