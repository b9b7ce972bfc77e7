"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.functions import labels as L
from farelake.operators import clean as C
from farelake.plans import datasets as D
from farelake.plans.oracle_base import (
    airline_sql,
    city_sql,
    class_sql,
    num_sql,
    strip,
    stops_sql,
    time_sql,
    with_base,
)
from farelake.plans.registry import register

RAW_COLS = "airline, flight, source_city, departure_time, stops, arrival_time, destination_city, class, duration, days_left, price"


@register("b1_drop_unnamed", sql=with_base(f"SELECT {RAW_COLS} FROM raw_tickets_final"))
def b1_drop_unnamed(spark, sf):
    """Raw tickets without spreadsheet index columns."""
    return C.drop_unnamed(D.raw_tickets(spark, sf))


@register(
    "b2_duplicate_rows",
    sql=with_base(
        f"""SELECT count(*) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT {RAW_COLS} FROM raw_tickets_final)) AS rows_distinct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {RAW_COLS} FROM raw_tickets_final)) AS duplicates_removed
FROM raw_tickets_final"""
    ),
)
def b2_duplicate_rows(spark, sf):
    """Exact-duplicate removal count (nulls equal)."""
    raw = C.drop_unnamed(D.raw_tickets(spark, sf))
    n_in = raw.agg(F.count("*").alias("rows_in"))
    n_d = C.drop_exact_duplicates(raw).agg(F.count("*").alias("rows_distinct"))
    return n_in.crossJoin(n_d).withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_distinct"))


def _mapping_query(raw_col: str, fn, sql_fn):
    def build(spark, sf):
        raw = C.drop_unnamed(D.raw_tickets(spark, sf))
        return raw.groupBy(F.col(raw_col).alias("raw_value")).agg(F.count("*").alias("rows")).withColumn(
            "normalized", fn(F.col("raw_value"))
        )

    sql = with_base(
        f"""SELECT raw_value, rows, {sql_fn('raw_value')} AS normalized
FROM (SELECT {raw_col} AS raw_value, count(*) AS rows FROM raw_tickets_final GROUP BY {raw_col})"""
    )
    return build, sql


for _name, _col, _fn, _sql in [
    ("b3_airline_normalise", "airline", L.normalize_airline, airline_sql),
    ("b4_departure_time_bins", "departure_time", L.normalize_time_bin, time_sql),
    ("b4_arrival_time_bins", "arrival_time", L.normalize_time_bin, time_sql),
    ("b5_stops_normalise", "stops", L.normalize_stops, stops_sql),
    ("b6_class_normalise", "class", L.normalize_class, class_sql),
    ("b7_city_repair", "source_city", L.repair_city, city_sql),
]:
    _b, _s = _mapping_query(_col, _fn, _sql)
    _b.__doc__ = f"Distinct raw {_col} values, their row counts and the normalised value."
    register(_name, sql=_s)(_b)


@register(
    "b8_numeric_coercion",
    sql=with_base(
        f"""SELECT count(*) AS rows,
  count(*) FILTER (WHERE {num_sql('duration')} IS NULL) AS duration_null,
  count(*) FILTER (WHERE {num_sql('days_left')} IS NULL) AS days_left_null,
  count(*) FILTER (WHERE {num_sql('price')} IS NULL) AS price_null,
  round(sum({num_sql('duration')}), 4) AS duration_sum
FROM raw_tickets_final"""
    ),
)
def b8_numeric_coercion(spark, sf):
    """Text -> double with bad values as NULL; NULL counts after coercion."""
    df = C.coerce_numeric(C.drop_unnamed(D.raw_tickets(spark, sf)))
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("duration").isNull()).alias("duration_null"),
        F.count_if(F.col("days_left").isNull()).alias("days_left_null"),
        F.count_if(F.col("price").isNull()).alias("price_null"),
        F.round(F.sum("duration"), 4).alias("duration_sum"),
    )


_REASONS_SQL = """list_filter([
    CASE WHEN duration IS NULL THEN 'duration_missing' END,
    CASE WHEN duration <= 0 THEN 'duration_not_positive' END,
    CASE WHEN price IS NULL THEN 'price_missing' END,
    CASE WHEN price <= 0 THEN 'price_not_positive' END,
    CASE WHEN coalesce(source_city = destination_city, false) THEN 'same_city' END], lambda x: x IS NOT NULL)"""


@register(
    "b9_quarantine_reasons",
    sql=with_base(
        f"""SELECT reason, count(*) AS rows FROM (
  SELECT unnest({_REASONS_SQL}) AS reason FROM tickets_norm) GROUP BY reason"""
    ),
)
def b9_quarantine_reasons(spark, sf):
    """Rejected rows per reason (null-safe predicates, nothing silently dropped)."""
    q = C.quarantine(D.raw_tickets(spark, sf))
    return q.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


@register("b10_route_counts", sql=with_base("SELECT route, count(*) AS rows FROM tickets GROUP BY route"))
def b10_route_counts(spark, sf):
    """Route key source_destination and rows per route."""
    return D.tickets(spark, sf).groupBy("route").agg(F.count("*").alias("rows"))


@register("b12_clean_tickets", sql=with_base("SELECT * FROM tickets"))
def b12_clean_tickets(spark, sf):
    """End-to-end cleaning job B1 -> B10."""
    return D.tickets(spark, sf)


@register(
    "b11_label_normaliser",
    sql=with_base(
        f"""SELECT raw_value, rows,
  coalesce(
    CASE replace(replace(lower({strip('raw_value')}), '-', ' '), '__', '_')
      {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STOPS_MAP.items())} END,
    CASE lower({strip('raw_value')})
      {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STOPS_MAP.items())} END,
    {strip('raw_value')}) AS normalized
FROM (SELECT stops AS raw_value, count(*) AS rows FROM raw_tickets_final GROUP BY stops)"""
    ),
)
def b11_label_normaliser(spark, sf):
    """Generic label normaliser applied to raw stops."""
    raw = D.raw_tickets(spark, sf)
    return raw.groupBy(F.col("stops").alias("raw_value")).agg(F.count("*").alias("rows")).withColumn(
        "normalized", L.normalize_label(F.col("raw_value"), L.STOPS_MAP)
    )


def _second_source(spark, sf):
    """Second-source extract (A2 shape) derived from raw tickets: Title-case columns, text durations."""
    raw = C.drop_unnamed(D.raw_tickets(spark, sf))
    dur = F.when(F.col("duration").rlike(r"^[0-9.]+$"), F.col("duration").try_cast("double"))
    h, m = F.floor(dur / 3), F.pmod(dur.cast("int") * 7, F.lit(60))
    text = F.when(dur.isNull(), F.col("duration")).when(h == 0, F.concat(m.cast("string"), F.lit("m"))).when(m == 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(
        F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))
    )
    return raw.select(
        F.col("airline").alias("Airline"),
        F.col("source_city").alias("Source"),
        F.col("destination_city").alias("Destination"),
        F.col("departure_time").alias("Dep_Time"),
        F.col("arrival_time").alias("Arrival_Time"),
        text.alias("Duration"),
        F.col("stops").alias("Total_Stops"),
        F.lit("No info").alias("Additional_Info"),
        F.col("price").cast("long").alias("Price"),
    )


_SECOND_SQL = """second_src AS (
  SELECT airline AS Airline, source_city AS Source, destination_city AS Destination, departure_time AS Dep_Time,
    arrival_time AS Arrival_Time,
    CASE WHEN NOT coalesce(regexp_full_match(duration, '[0-9.]+'), false) OR TRY_CAST(duration AS DOUBLE) IS NULL THEN duration
         WHEN floor(CAST(duration AS DOUBLE) / 3) = 0 THEN CAST((CAST(CAST(duration AS DOUBLE) AS INTEGER) * 7) % 60 AS VARCHAR) || 'm'
         WHEN (CAST(CAST(duration AS DOUBLE) AS INTEGER) * 7) % 60 = 0 THEN CAST(CAST(floor(CAST(duration AS DOUBLE) / 3) AS BIGINT) AS VARCHAR) || 'h'
         ELSE CAST(CAST(floor(CAST(duration AS DOUBLE) / 3) AS BIGINT) AS VARCHAR) || 'h ' || CAST((CAST(CAST(duration AS DOUBLE) AS INTEGER) * 7) % 60 AS VARCHAR) || 'm' END AS Duration,
    stops AS Total_Stops, 'No info' AS Additional_Info, CAST(price AS BIGINT) AS Price
  FROM raw_tickets_final),
second_h AS (
  SELECT DISTINCT * FROM second_src),
second_hours AS (
  SELECT *, CASE WHEN regexp_extract(Duration, '(\\d+)\\s*h', 1) <> '' OR regexp_extract(Duration, '(\\d+)\\s*m', 1) <> ''
    THEN coalesce(TRY_CAST(nullif(regexp_extract(Duration, '(\\d+)\\s*h', 1), '') AS DOUBLE), 0.0)
       + coalesce(TRY_CAST(nullif(regexp_extract(Duration, '(\\d+)\\s*m', 1), '') AS DOUBLE), 0.0) / 60.0 END AS hours
  FROM second_h)"""


@register(
    "b14_merge_sources",
    sql=with_base(
        """SELECT source, class, count(*) AS rows, count(days_left) AS days_known, round(sum(duration_h), 4) AS duration_hours
FROM (SELECT 'primary' AS source, class, days_left, TRY_CAST(duration AS DOUBLE) AS duration_h FROM raw_tickets_final
      UNION ALL SELECT 'second', 'Unknown', NULL, hours FROM second_hours) GROUP BY source, class""",
        _SECOND_SQL,
    ),
)
def b14_merge_sources(spark, sf):
    """Harmonise a second extract (rename, class Unknown, days NULL, text durations) and union by name."""
    primary = C.drop_unnamed(D.raw_tickets(spark, sf)).withColumn("source", F.lit("primary"))
    second = _second_source(spark, sf)
    merged = primary.unionByName(
        C.harmonise_second_source(second).withColumn("source", F.lit("second")), allowMissingColumns=True
    )
    return merged.groupBy("source", "class").agg(
        F.count("*").alias("rows"),
        F.count("days_left").alias("days_known"),
        F.round(F.sum(F.col("duration").try_cast("double")), 4).alias("duration_hours"),
    )


@register(
    "b15_duration_text",
    sql=with_base(
        "SELECT Duration AS duration_text, count(*) AS rows, round(max(hours), 6) AS hours FROM second_hours GROUP BY Duration",
        _SECOND_SQL,
    ),
)
def b15_duration_text(spark, sf):
    """Duration text ('2h 50m', '19h', '5m') to decimal hours."""
    second = _second_source(spark, sf).dropDuplicates()
    return second.groupBy(F.col("Duration").alias("duration_text")).agg(
        F.count("*").alias("rows"), F.round(F.max(C.duration_text_to_hours(F.col("Duration"))), 6).alias("hours")
    )


@register(
    "b16_duplicate_dataset_check",
    sql=with_base(
        f"""SELECT sum(na) AS rows_a, sum(nb) AS rows_b, sum(greatest(na - nb, 0)) AS only_in_a,
  sum(greatest(nb - na, 0)) AS only_in_b, sum(greatest(na - nb, 0)) = 0 AND sum(greatest(nb - na, 0)) = 0 AS identical
FROM (SELECT coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM
  (SELECT {RAW_COLS}, count(*) AS n FROM raw_tickets_final GROUP BY ALL) a
  FULL OUTER JOIN (SELECT {RAW_COLS}, count(*) AS n FROM (SELECT DISTINCT {RAW_COLS} FROM raw_tickets_final) GROUP BY ALL) b
  ON {' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in RAW_COLS.split(', '))})"""
    ),
)
def b16_duplicate_dataset_check(spark, sf):
    """Multiset comparison: raw tickets vs their de-duplicated copy."""
    raw = C.drop_unnamed(D.raw_tickets(spark, sf))
    res = C.same_multiset(raw, raw.dropDuplicates())
    return res.select(
        F.col("rows_a").cast("long").alias("rows_a"),
        F.col("rows_b").cast("long").alias("rows_b"),
        F.col("only_in_a").cast("long").alias("only_in_a"),
        F.col("only_in_b").cast("long").alias("only_in_b"),
        "identical",
    )


@register(
    "b17_row_accounting",
    sql=with_base(
        f"""SELECT class, count(*) AS rows_after_dedupe,
  count(*) FILTER (WHERE len({_REASONS_SQL}) > 0) AS rows_invalid,
  count(*) FILTER (WHERE len({_REASONS_SQL}) = 0) AS rows_out,
  (SELECT count(*) FROM raw_tickets_final) AS rows_in
FROM tickets_norm GROUP BY class"""
    ),
)
def b17_row_accounting(spark, sf):
    """Rows in / after dedupe / invalid / out per class."""
    return C.row_accounting(D.raw_tickets(spark, sf))
