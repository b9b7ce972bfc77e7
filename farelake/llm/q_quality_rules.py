"""Query of the quality-rule cascade over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import quality_rules as Q
from farelake.llm.tables import documents


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.verdicts(documents(spark, sf_dir), stats=True)
    return out.select("doc_id", *Q.STATS, "base_failed", "kept")


#: \x20 and \x09-\x0D end a word; list_* functions stay inside one row, only windows are unnested.
SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
  GROUP BY rid
), s AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines,
         len(list_filter(ws, lambda x: length(regexp_replace(x, '[^A-Z]', '', 'g')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_upper,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words
            OR 100 * n_upper > 30 * n_words OR 100 * n_stutter > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM s
"""

QUERIES = {"op3_quality_rules": (op3_quality_rules, SQL)}
