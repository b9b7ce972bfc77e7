"""Train/test partitioning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.functions.stats import cents
from farelake.operators import splits as SP
from farelake.plans import datasets as D
from farelake.plans.oracle_base import cents as cents_sql
from farelake.plans.oracle_base import with_base
from farelake.plans.registry import register

def _text_sql(c: str) -> str:
    return f"coalesce(length({c}) || ':' || {c}, 'N')"


def _number_sql(c: str) -> str:
    return f"coalesce(CAST(CAST(round({c} * 1000000) AS BIGINT) AS VARCHAR), 'N')"


KEY_SQL = f"md5(concat_ws('|', {', '.join([*map(_text_sql, SP.ROW_KEY_COLUMNS), *map(_number_sql, SP.ROW_KEY_NUMBERS)])}, '42'))"


def _split_summary(df):
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(cents("price")).alias("price_cents"),
        F.count_distinct("route").alias("routes"),
    )


_SUMMARY_SQL = f"SELECT split, count(*) AS rows, CAST(sum({cents_sql('price')}) AS BIGINT) AS price_cents, count(DISTINCT route) AS routes"


@register(
    "f1_random_holdout",
    sql=with_base(
        f"""{_SUMMARY_SQL} FROM (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {KEY_SQL}) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM fares) GROUP BY split"""
    ),
)
def f1_random_holdout(spark, sf):
    """Random-row holdout: exactly ceil(0.2 n) test rows in seeded md5 order (no global sort)."""
    return _split_summary(SP.random_holdout(D.fares(spark, sf)))


_GROUPS_SQL = """route_groups AS (SELECT DISTINCT source_city || ' → ' || destination_city AS grp FROM fares),
held_routes AS (
  SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY md5(grp || '|42')) AS rn, count(*) OVER () AS g FROM route_groups)
  WHERE rn <= ceil(g * 0.2)),
src_groups AS (SELECT DISTINCT source_city AS grp FROM fares),
held_src AS (
  SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY md5(grp || '|42')) AS rn, count(*) OVER () AS g FROM src_groups)
  WHERE rn <= ceil(g * 0.2))"""


@register("f2_route_group_holdout", sql=with_base("SELECT grp FROM held_routes", _GROUPS_SQL))
def f2_route_group_holdout(spark, sf):
    """Held-out routes: ceil(0.2 G) whole routes in seeded md5 order."""
    return SP.held_out_groups(D.fares(spark, sf), SP.group_col_route())


@register("f3_airport_group_holdout", sql=with_base("SELECT grp FROM held_src", _GROUPS_SQL))
def f3_airport_group_holdout(spark, sf):
    """Held-out origin cities: ceil(0.2 G) whole origins."""
    return SP.held_out_groups(D.fares(spark, sf), F.col("source_city"))


@register(
    "f4_temporal_holdout",
    sql=with_base(
        f"""{_SUMMARY_SQL}, max(days_left) AS max_days, min(days_left) AS min_days, count(days_left) AS days_known FROM (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY days_left DESC NULLS LAST, {KEY_SQL}) <= floor(count(*) OVER () * 0.8)
    THEN 'train' ELSE 'test' END AS split FROM fares) GROUP BY split"""
    ),
)
def f4_temporal_holdout(spark, sf):
    """Temporal holdout: earliest-booked first (days_left desc, NULLs last); first int(0.8 n) train."""
    df = SP.temporal_holdout(D.fares(spark, sf))
    return df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.sum(cents("price")).alias("price_cents"),
        F.count_distinct("route").alias("routes"),
        F.max("days_left").alias("max_days"),
        F.min("days_left").alias("min_days"),
        F.count("days_left").alias("days_known"),
    )


@register(
    "f5_route_split_audit",
    sql=with_base(
        """SELECT 'test' AS split, grp, count(*) AS rows, 1 AS groups, 0 AS overlap FROM r WHERE split = 'test' GROUP BY grp
UNION ALL SELECT split, NULL, count(*) AS rows, count(DISTINCT grp) AS groups,
  (SELECT count(*) FROM held_routes WHERE grp IN (SELECT grp FROM r WHERE split = 'train')) AS overlap
FROM (SELECT source_city || ' → ' || destination_city AS grp,
        CASE WHEN source_city || ' → ' || destination_city IN (SELECT grp FROM held_routes) THEN 'test' ELSE 'train' END AS split
      FROM fares) GROUP BY split""",
        _GROUPS_SQL + """,
r AS (SELECT source_city || ' → ' || destination_city AS grp,
        CASE WHEN source_city || ' → ' || destination_city IN (SELECT grp FROM held_routes) THEN 'test' ELSE 'train' END AS split
      FROM fares)""",
    ),
)
def f5_route_split_audit(spark, sf):
    """Split audit for the route holdout: rows, groups, held-out list, zero overlap."""
    return SP.split_audit(SP.group_holdout(D.fares(spark, sf), SP.group_col_route()))


@register(
    "f6_logo_folds",
    sql=with_base(
        """SELECT route, count(*) AS test_rows, (SELECT count(*) FROM fares) - count(*) AS train_rows,
  (SELECT count(*) FROM fares) - count(*) < 3 AS skipped FROM fares GROUP BY route"""
    ),
)
def f6_logo_folds(spark, sf):
    """Leave-one-route-out fold sizes from per-group counts (no fold copies of the data)."""
    return SP.logo_folds(D.fares(spark, sf), "route")
