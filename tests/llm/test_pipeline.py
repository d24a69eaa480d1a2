"""The pipeline's stages on the smallest tables, and the contract of the registered queries."""

import random
import zlib

import corpus_pipeline
import pytest
from messy import TEXTS, empty, table

from shoptally.llm import queries
from shoptally.llm.common import table as read

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_only_drop_rows(spark):
    docs = read(spark, FOLDER, "documents")
    before = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        assert set(rows) <= before and len(rows) == len(set(rows)), name
        assert len(rows) > 0.75 * len(before), name
        docs, before = spark.createDataFrame(rows, docs.schema), set(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r[0] for r in before}


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (table(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, FOLDER).count() <= len(TEXTS) * 50


def test_texts_of_every_learned_language_stay(spark):
    rng = random.Random(2)
    rows = []
    for i in range(270):
        own = [chr(0x4E00 + 6 * i + k) for k in range(6)]
        words = 60 if i < 262 else 40
        rows += [(f"l{i}", " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(words))) for _ in range(6)]
    docs = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.of_known_language(spark, docs, FOLDER)
    assert {r["lang"] for r in kept.select("lang").distinct().collect()} >= {
        lang for n, (lang, _) in enumerate(rows) if zlib.crc32(str(n).encode()) % 3 != 1}


def test_all_operators_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    from parity import compare, connect

    from shoptally.plans.registry import Query

    query = Query(name, queries.queries()[name], queries.oracle_sql()[name], ())
    verdict, _, _ = compare(spark, connect(FOLDER), FOLDER, query)
    assert verdict.startswith("same"), verdict
