"""Readers and sinks on real volume (A1, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.functions.stats import cents
from farelake.plans import datasets as D
from farelake.plans.oracle_base import cents as cents_sql
from farelake.plans.oracle_base import with_base
from farelake.plans.registry import register
from farelake.session import shared_path
from farelake.sources.tables import read_ticket_csv


@register(
    "a1_ticket_csv",
    sql=with_base(
        """SELECT nullif(airline, '') AS airline, nullif(stops, '') AS stops, nullif(class, '') AS class, count(*) AS rows,
  count(nullif(CAST(duration AS VARCHAR), '')) AS durations, count(nullif(CAST(days_left AS VARCHAR), '')) AS days
FROM raw_tickets_final GROUP BY 1, 2, 3"""
    ),
)
def a1_ticket_csv(spark, sf):
    """Raw tickets written as header CSV and read back as text (an empty field is missing), counted by their labels."""
    path = shared_path(spark, "tickets-csv")
    raw = D.raw_tickets(spark, sf)
    texts = raw.select(*(F.col(c).cast("string").alias(c) for c in raw.columns))
    texts.write.option("header", True).options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    back = read_ticket_csv(spark, path).filter("_corrupt_record IS NULL")
    return back.groupBy("airline", "stops", "class").agg(F.count(F.lit(1)).alias("rows"), F.count("duration").alias("durations"), F.count("days_left").alias("days"))


@register(
    "a5_enriched_table",
    sql=with_base(f"SELECT class, count(*) AS rows, CAST(sum({cents_sql('price')}) AS BIGINT) AS price_cents, count(DISTINCT route) AS routes, count(distance_km) AS located FROM fares GROUP BY class"),
)
def a5_enriched_table(spark, sf):
    """The written fares table read back: rows, money, routes and located rows per class."""
    return D.fares(spark, sf).groupBy("class").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cents("price")).alias("price_cents"), F.count_distinct("route").alias("routes"), F.count("distance_km").alias("located")
    )
