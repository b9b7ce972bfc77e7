"""Query of the secret scan over all documents (recursive decoding has no SQL form; tests hold it against a plain version)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm import secret_scans as S
from farelake.llm.tables import documents


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.scan(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of(kind))).cast("long").alias(f"n_{kind}") for kind in S.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op6_secret_scans": (op6_secret_scans, None)}
