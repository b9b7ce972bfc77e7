"""The corpus pipeline: quality rules, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir), with docs as the stage before left them, and returns a DataFrame that is
written as Parquet and read again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import minhash_dedup, packing, quality_rules, secret_scans, source_mix
from farelake.llm.tables import documents, ready, stored

#: Near-duplicates in the pipeline: word shingles of five, similarity of 0.8 or more.
SHINGLE_WORDS, PERCENT = 5, 80
#: Bytes of rows that a task hands to Python at once, where the session does not say; a longer row goes alone.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 20


def _prepared(spark: SparkSession) -> None:
    """Whole texts go to Python by bytes, not by thousands of rows: a task's memory does not follow their length."""
    ready(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    _prepared(spark)
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    _prepared(spark)
    return minhash_dedup.drop_near_duplicates(docs, k=SHINGLE_WORDS, percent=PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret, in any layer, is masked; n_chars follows the text."""
    _prepared(spark)
    return secret_scans.redact(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources come near their targets."""
    _prepared(spark)
    return source_mix.resampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their ids."""
    _prepared(spark)
    return packing.pieces(docs, packing.default_vocabulary(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each),
    ("secret scans", without_secrets),
    ("source mix", to_weights),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Seeded selection, recursive decoding and token ids have no SQL form; tests hold run() against its stages one by one, and the stages against plain versions.
ORACLE_SQL = None
