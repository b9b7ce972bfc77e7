"""Profiling queries (C1-C10) over the enriched fares table."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators import profile as P
from farelake.plans import datasets as D
from farelake.plans.oracle_base import money_pct, rnd, with_base
from farelake.plans.registry import register
from farelake.session import written_table

FARE_COLS = [
    "airline", "flight", "source_city", "departure_time", "stops", "arrival_time", "destination_city", "class",
    "duration", "days_left", "price", "route", "source_lat", "source_lon", "destination_lat", "destination_lon",
    "distance_km", "log_days_left", "duration_distance_ratio", "speed_kmh", "route_id", "airline_route_id",
]
NUM_COLS = [
    "duration", "days_left", "price", "source_lat", "source_lon", "destination_lat", "destination_lon",
    "distance_km", "log_days_left", "duration_distance_ratio", "speed_kmh",
]


@register(
    "c1_shape",
    sql=with_base(
        "SELECT position, name AS column, dtype, (SELECT count(*) FROM fares) AS rows FROM (VALUES "
        + ", ".join(f"({i}, '{c}', '{'double' if c in NUM_COLS else 'string'}')" for i, c in enumerate(FARE_COLS))
        + ") AS v(position, name, dtype)"
    ),
)
def c1_shape(spark, sf):
    """Column names, positions, Spark types and row count (metadata + one count)."""
    return P.shape(D.fares(spark, sf))


@register(
    "c2_missing_counts",
    sql=with_base(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column, 'missing' AS metric, count(*) FILTER (WHERE \"{c}\" IS NULL"
            + (f" OR isnan(\"{c}\")" if c in NUM_COLS else "")
            + ") AS value FROM fares"
            for c in FARE_COLS
        )
    ),
)
def c2_missing_counts(spark, sf):
    """Missing values per column (long form)."""
    return P.missing_counts(D.fares(spark, sf))


@register(
    "c3_duplicate_rows",
    sql=with_base(
        "SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM fares)) AS distinct_rows, "
        "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fares)) AS duplicate_rows FROM fares"
    ),
)
def c3_duplicate_rows(spark, sf):
    """Rows beyond the first copy."""
    return P.duplicate_rows(D.fares(spark, sf))


@register(
    "c4_distinct_values",
    sql=with_base(
        " UNION ALL ".join(f"SELECT '{c}' AS column, 'unique' AS metric, count(DISTINCT \"{c}\") AS value FROM fares" for c in FARE_COLS)
    ),
)
def c4_distinct_values(spark, sf):
    """Distinct non-null values per column."""
    return P.distinct_counts(D.fares(spark, sf))


@register(
    "c4_distinct_sketches",
    sql=with_base(
        " UNION ALL ".join(f"SELECT '{c}' AS column, count(DISTINCT \"{c}\") AS exact, true AS within_bound FROM fares" for c in FARE_COLS)
    ),
)
def c4_distinct_sketches(spark, sf):
    """Distinct values estimated from one kept sketch per class and column, merged; held against the exact counts."""
    f = D.fares(spark, sf)
    kept = written_table(P.distinct_sketches(f.withColumn("_part", F.col("class")), ["_part"]), "sketches")
    estimated = P.merged_distinct(kept).select("column", F.col("value").alias("estimate"))
    exact = P.distinct_counts(f).select("column", F.col("value").alias("exact")).join(estimated, "column")
    return exact.select("column", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= P.sketch_bound() * F.col("exact")).alias("within_bound"))


def _stats_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        for m, e in [("min", f"min({x})"), ("max", f"max({x})"), ("mean", f"avg({x})"), ("median", f"median({x})"), ("std", f"stddev_samp({x})")]:
            parts.append(f"SELECT '{c}' AS column, '{m}' AS metric, {rnd(e, 6)} AS value FROM {table} HAVING count({x}) > 0")
    return " UNION ALL ".join(parts)


@register("c5_numeric_stats", sql=with_base(_stats_sql("fares", NUM_COLS)))
def c5_numeric_stats(spark, sf):
    """min/max/mean/median/std per numeric column."""
    return P.numeric_stats(D.fares(spark, sf), NUM_COLS)


def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"""SELECT '{c}' AS column, 'outliers' AS metric, count(*) FILTER (WHERE "{c}" < q1 - 1.5 * (q3 - q1) OR "{c}" > q3 + 1.5 * (q3 - q1)) AS value
  FROM {table}, (SELECT quantile_cont("{c}", 0.25) AS q1, quantile_cont("{c}", 0.75) AS q3 FROM {table}) b HAVING count("{c}") > 0"""
        )
    return " UNION ALL ".join(parts)


@register("c6_iqr_outliers", sql=with_base(_iqr_sql("fares", NUM_COLS)))
def c6_iqr_outliers(spark, sf):
    """IQR outlier counts per numeric column."""
    return P.iqr_outliers(D.fares(spark, sf), NUM_COLS)


@register(
    "c7_target_stats",
    sql=with_base(
        _stats_sql("(SELECT TRY_CAST(CAST(price AS VARCHAR) AS DOUBLE) AS price FROM raw_tickets_final)", ["price"])
    ),
)
def c7_target_stats(spark, sf):
    """Statistics of the coerced target on the raw table."""
    return P.target_stats(D.raw_tickets(spark, sf))


@register(
    "c8_price_terciles",
    sql=with_base(f"SELECT {rnd(money_pct('price', 0.33), 4)} AS budget_max, {rnd(money_pct('price', 0.66), 4)} AS high_min FROM fares"),
)
def c8_price_terciles(spark, sf):
    """Fare band cut points at the 0.33 / 0.66 quantiles."""
    return P.price_terciles(D.fares(spark, sf))


_CATALOGUE_SQL = """SELECT 'airlines' AS item, string_agg(DISTINCT airline, '|' ORDER BY airline) AS value FROM fares
UNION ALL SELECT 'stops', string_agg(DISTINCT stops, '|' ORDER BY stops) FROM fares
UNION ALL SELECT 'departure_times', string_agg(DISTINCT departure_time, '|' ORDER BY departure_time) FROM fares
UNION ALL SELECT 'arrival_times', string_agg(DISTINCT arrival_time, '|' ORDER BY arrival_time) FROM fares
UNION ALL SELECT 'cities', string_agg(DISTINCT c, '|' ORDER BY c) FROM (SELECT source_city AS c FROM fares UNION ALL SELECT destination_city FROM fares)
UNION ALL SELECT 'classes', string_agg(DISTINCT class, '|' ORDER BY class) FROM fares
UNION ALL SELECT 'route_count', CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT source_city, destination_city FROM fares)
UNION ALL SELECT 'rows_' || class, CAST(count(*) AS VARCHAR) FROM fares GROUP BY class"""


@register("c9_domain_catalogue", sql=with_base(_CATALOGUE_SQL))
def c9_domain_catalogue(spark, sf):
    """Sorted domains, route count and rows per class."""
    return P.domain_catalogue(D.fares(spark, sf))


@register(
    "c10_public_classes",
    sql=with_base("SELECT DISTINCT class FROM fares WHERE lower(class) <> 'unknown'"),
)
def c10_public_classes(spark, sf):
    """Classes offered publicly (everything except Unknown)."""
    return D.fares(spark, sf).select("class").distinct().filter(F.lower("class") != "unknown")
