"""Derived datasets every query starts from (Spark side).

``fares`` = raw tickets -> B12 clean -> D8 geo -> E4 features: the enriched ticket
table, written once as Parquet. Queries read only the columns and classes they need of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelake.functions.features import add_engineered_features
from farelake.operators import clean, locations
from farelake.session import table_state, written_table
from farelake.sources import adapter


def airports_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.airports(spark, sf_dir)


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.airport_dimension(airports_raw(spark, sf_dir))


def name_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.name_index(airports_raw(spark, sf_dir), airports(spark, sf_dir))


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.raw_tickets(spark, sf_dir)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 output."""
    return clean.clean_tickets(raw_tickets(spark, sf_dir))


def fares_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched tickets (A5 output shape). The cleaned tickets are read twice, for their places and for the join with
    them, so they are written first: cleaning runs once."""
    cleaned = written_table(tickets(spark, sf_dir), "tickets")
    geo = locations.add_geographic_features(cleaned, airports(spark, sf_dir), name_index(spark, sf_dir))
    return add_engineered_features(geo)


_FARES: dict[tuple, DataFrame] = {}


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the enriched ticket table, written as Parquet and read back.

    Every analysis reads this table instead of cleaning and resolving again; it is written anew when the input
    folder has changed. It is not partitioned: Spark would sort the whole rows of every task by cabin class before writing
    them, and spill where a task's rows exceed its memory.
    """
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, sf_dir))
    if key not in _FARES:
        _FARES[key] = written_table(fares_lazy(spark, sf_dir), "fares")
    return _FARES[key]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.requests(spark, sf_dir)
