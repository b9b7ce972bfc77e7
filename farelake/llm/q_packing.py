"""Query of packing over all documents (token ids have no SQL form; tests hold it against the plain tokenizer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import packing as P
from farelake.llm.tables import documents


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pieces(documents(spark, sf_dir), P.default_vocabulary())


QUERIES = {"op10_packing": (op10_packing, None)}
