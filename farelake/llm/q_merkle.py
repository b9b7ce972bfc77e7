"""Query of the Merkle manifest of all documents, with the proof of every row checked (some against tampered rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.llm import merkle as M
from farelake.llm.tables import documents


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = ([F.col(c) for c in names] for names in (("doc_id", "source", "lang"), ("text",)))
    leaf = M.leaf_of(*before, F.col("n_chars"), *after)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, M.leaf_of(*before, F.col("n_chars") + 1, *after)).otherwise(leaf)
    made = M.manifest(documents(spark, sf_dir), "doc_id", "lang", leaf, shown=tampered)
    out = M.checked(M.proofs(made, made.leaves), "shown")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf(n_chars: str) -> str:
    written = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(written)})"


#: All levels by repeated pairing, each row's siblings by position, and its fold step by step. The checksum is made bit by bit.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, xor(list_reduce(
      list_concat([4294967295], flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END
    ), 4294967295) AS crc, {_leaf("n_chars + 1")} AS changed FROM documents)
), nodes AS (
  SELECT lang, n, 0 AS level, pos, leaf AS h FROM d
  UNION ALL
  SELECT lang, (n + 1) // 2, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, n, level, pos // 2
), tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), top AS (
  SELECT n, 0 AS level, pos, subroot AS h FROM tops
  UNION ALL
  SELECT (n + 1) // 2, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY n, level, pos // 2
), own AS (
  SELECT d.doc_id, d.leaf, d.lang, d.pos, d.n, t.pos AS top_pos, t.n AS n_top, t.subroot, CASE WHEN d.crc % 7 = 0 THEN d.changed ELSE d.leaf END AS shown
  FROM d JOIN tops t ON d.lang IS NOT DISTINCT FROM t.lang
), siblings AS (
  SELECT o.doc_id, s.level, s.h FROM (SELECT *, unnest(range(0, 40)) AS level FROM own) o
  JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.level = o.level AND s.pos = xor(o.pos >> o.level, 1)
  UNION ALL
  SELECT o.doc_id, 100 + s.level, s.h FROM (SELECT *, unnest(range(0, 40)) AS level FROM own) o
  JOIN top s ON s.level = o.level AND s.pos = xor(o.top_pos >> o.level, 1)
), steps AS (
  SELECT doc_id, lang, shown AS h, pos, n, 0 AS level FROM own
  UNION ALL
  SELECT f.doc_id, f.lang, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END, f.pos // 2, (f.n + 1) // 2, f.level + 1
  FROM steps f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
), top_steps AS (
  SELECT f.doc_id, f.h, o.top_pos AS pos, o.n_top AS n, 0 AS level FROM steps f JOIN own o USING (doc_id) WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.pos % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END, f.pos // 2, (f.n + 1) // 2, f.level + 1
  FROM top_steps f LEFT JOIN top s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1
)
SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM own o CROSS JOIN (SELECT h FROM top WHERE n = 1) r JOIN top_steps f ON f.doc_id = o.doc_id AND f.n = 1
LEFT JOIN (SELECT doc_id, string_agg(h, '' ORDER BY level) AS proof FROM siblings GROUP BY doc_id) p ON p.doc_id = o.doc_id
"""

QUERIES = {"op13_merkle": (op13_merkle, SQL)}
