"""Query of the source mix over all documents (seeded selection has no SQL form; tests hold it against a plain version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import source_mix as X
from farelake.llm.tables import documents


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_source_mix": (op7_source_mix, None)}
