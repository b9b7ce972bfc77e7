"""Query of near-duplicate detection over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import minhash_dedup as M
from farelake.llm.tables import documents


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


#: Every pair that shares a shingle, counted exactly; components by repeated least labels.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
rare AS (SELECT * FROM sh WHERE g IN (SELECT g FROM sh GROUP BY g HAVING count(*) > 1)),
links AS (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM rare x JOIN rare y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

QUERIES = {"op9_minhash_dedup": (op9_minhash_dedup, SQL)}
