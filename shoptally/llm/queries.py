"""Registered queries of this subpackage, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoptally.llm import (
    exact_dedup, filter_audit, hamming, language, licences, near_dedup, packing, pieces, sharding, spelling, top_k,
    toxicity, warc)

Run = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Run]:
    return {
        "op1_licence_scan": licences.op1,
        "op2_language_id": language.op2,
        "op3_toxicity": toxicity.op3,
        "op4_near_dedup": near_dedup.op4,
        "op5_piece_sampling": pieces.op5,
        "op6_packing": packing.op6,
        "op7_warc": warc.op7,
        "op8_sharding": sharding.op8,
        "op9_exact_dedup": exact_dedup.op9,
        "op10_exact_top_k": top_k.op10,
        "op11_filter_audit": filter_audit.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_nearest_neighbours": hamming.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licence_scan": licences.SQL,
        "op7_warc": warc.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
        "op10_exact_top_k": top_k.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_spelling_variants": spelling.SQL,
    }
