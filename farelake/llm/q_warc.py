"""Query of the WARC round trip over all pages. The SQL has the digest as base32 from the hex SHA-1, five bits a letter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.llm import warc as W
from farelake.llm.tables import table


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = W.read(W.write(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
bits AS (
  SELECT h, string_agg(lpad(bin(CAST('0x' || substr(h, i, 8) AS BIGINT)), 32, '0'), '' ORDER BY i) AS s
  FROM (SELECT DISTINCT h FROM p), (SELECT unnest(range(1, 41, 8)) AS i) GROUP BY h
), b32 AS (
  SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(substr(s, i + k, 1) AS INTEGER) * (16 >> k))) AS INTEGER), 1), '' ORDER BY i) AS d
  FROM bits, (SELECT unnest(range(1, 161, 5)) AS i) GROUP BY h
)
SELECT page_id, octet_length(b) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN last USING (h) JOIN b32 USING (h)
"""

QUERIES = {"op8_warc": (op8_warc, SQL)}
