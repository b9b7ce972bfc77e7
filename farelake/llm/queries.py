"""All queries of this package: name -> builder, and name -> DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import q_chat_format, q_hard_negatives, q_language_mix, q_merkle, q_minhash_dedup, q_multi_index, q_packing, q_quality_rules, q_secret_scans, q_source_mix, q_surrogates, q_warc, q_winnowing

MODULES = [q_language_mix, q_chat_format, q_quality_rules, q_surrogates, q_winnowing, q_secret_scans, q_source_mix, q_warc, q_minhash_dedup, q_packing, q_hard_negatives, q_multi_index, q_merkle]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for m in MODULES for name, (build, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
