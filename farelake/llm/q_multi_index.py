"""Query of nearest neighbours over all embeddings (found by an approximate index: tests measure recall against brute force)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm import multi_index as I
from farelake.llm.tables import table


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


QUERIES = {"op12_multi_index": (op12_multi_index, None)}
