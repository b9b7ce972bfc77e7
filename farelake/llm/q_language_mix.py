"""Query of language identification over all documents (held-out accuracy and a plain version are in the tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm import language_mix as L
from farelake.llm.tables import documents


def op1_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = L.Model.fit(docs.where(fold != 1))
    found = L.identify(docs, model)
    shares = F.array_join(F.transform("mixture", lambda m: F.concat_ws(":", m["lang"], F.format_number(m["share"], 4))), ",")
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", shares.alias("languages"))


QUERIES = {"op1_language_mix": (op1_language_mix, None)}
