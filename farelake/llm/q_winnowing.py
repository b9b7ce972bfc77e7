"""Query of winnowing fingerprints over all documents, their edited texts and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm import winnowing as W
from farelake.llm.neighbours import following, ranged
from farelake.llm.tables import documents


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Texts move once, by key range; fingerprints are made where the rows then are."""
    rows = ranged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    order = following("text")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)))
    rows = W.with_fingerprint(W.with_fingerprint(rows, "text", "own"), "edited", "changed")
    rows = rows.select("doc_id", "_order", "_range", "_ghost", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), W.written("own").alias("fingerprint"), W.written("changed").alias("edited_fingerprint"), W.hashes("own").alias("own"), W.hashes("changed").alias("changed"))
    rows = rows.withColumn("after", F.lead("own").over(order)).where("not _ghost")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", W.likeness("own", "changed").alias("near_edited"), W.likeness("own", "after").alias("near_next"))


QUERIES = {"op5_winnowing": (op5_winnowing, None)}
