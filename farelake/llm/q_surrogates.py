"""Query of personal-data surrogates over all documents (keyed hashing to words has no SQL form; tests check its promises)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm import surrogates as P
from farelake.llm.tables import documents


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), found="entities")
    kinds = F.transform("entities", lambda e: e["kind"])
    counts = [F.size(F.filter(kinds, _is(kind))).cast("long").alias(f"n_{kind}") for kind in P.KINDS]
    return docs.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), *counts, F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["surrogate"])), "\n").alias("surrogates"))


def _is(kind: str):
    return lambda k: k == kind


QUERIES = {"op4_surrogates": (op4_surrogates, None)}
