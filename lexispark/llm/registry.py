"""Queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, license_scan, mixing, neardup, passages, quality, repeats, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_decontaminate": decontam.op3_decontaminate,
        "op4_chat_format": chat.op4_chat_format,
        "op5_minhash_dedup": neardup.op5_minhash_dedup,
        "op6_minimax_shards": sharding.op6_minimax_shards,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_passage_chains": passages.op8_passage_chains,
        "op9_suffix_dedup": repeats.op9_suffix_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op2_quality_rules": quality.oracle(),
        "op3_decontaminate": decontam.oracle(),
        "op4_chat_format": chat.oracle(),
        "op5_minhash_dedup": neardup.oracle(),
        "op7_mix_sources": mixing.oracle(),
    }
