"""Small fixtures that every operator is tried on."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, target string, _key string"


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows and keys, columns named like outputs."""
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x", "t", "k"),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "x", "t", "k"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, "", "", ""),
        (4, " \n\t ", "de", "b", 4, None, None, None),
        (None, "alpha beta gamma delta epsilon zeta eta theta", None, "a", None, None, None, None),
        (None, "only this row says so", None, None, None, None, None, None),
        (5, long_text, "en", "c", len(long_text), None, None, None),
        (6, "ÄÖÜ ß 漢字 😀 é", "de", "c", 1, None, None, None),
        (7, "one", "fr", "a", 3, None, None, None),
        (7, "two", "fr", "a", 3, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="sf0.001", n=None):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
