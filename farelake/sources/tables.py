"""Readers for the driver's Parquet tables and the reference-shaped file inputs."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Parquet keeps column pruning and filter pushdown at the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


TICKET_COLUMNS = "airline flight source_city departure_time stops arrival_time destination_city class duration days_left price".split()


def read_ticket_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2: header CSV, every column as text (B8 coerces later, nothing is inferred); lines that do not fit the header
    land in ``_corrupt_record``. The columns are those of the file, so either extract's names and extras are kept."""
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_corrupt_record"]])
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    return spark.read.schema(schema).options(**options).csv(path)


AIRPORT_REQUIRED = ["city", "airport", "iata", "state", "country", "latitude", "longitude"]


def read_airports_csv(spark: SparkSession, path: str) -> DataFrame:
    """A3: airport catalogue; fails fast (metadata only, no job) when required columns are missing.

    A file sequence number is attached so "first row per IATA" / "last writer wins" stay
    defined after a distributed read (input file name + row position within the file).
    """
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(AIRPORT_REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"Airport dataset missing columns: {missing}")
    if "aliases" not in df.columns:
        df = df.withColumn("aliases", F.lit(""))
    # monotonically_increasing_id is ordered within and across partitions of one file read.
    return df.withColumn("seq", F.monotonically_increasing_id())


OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("route", T.StringType()),
        T.StructField("source_iata", T.StringType()),
        T.StructField("destination_iata", T.StringType()),
        T.StructField("source_city", T.StringType()),
        T.StructField("destination_city", T.StringType()),
        T.StructField("airline", T.StringType()),
        T.StructField("cabin", T.StringType()),
        T.StructField("stops", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("distance_km", T.DoubleType()),
        T.StructField("days_until_departure", T.IntegerType()),
        T.StructField("current_fare", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def read_observations_json(spark: SparkSession, path: str) -> DataFrame:
    """A4: JSON array of market observations with a declared schema."""
    return spark.read.schema(OBSERVATION_SCHEMA).option("multiLine", True).json(path)


def read_comparables_history(spark: SparkSession, path: str) -> DataFrame:
    """Enriched history; keep positive priced rows with a distance. Filters reach the scan. An absent path is an
    empty history; any other trouble with it is an error."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as trouble:
        if trouble.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "price double, distance_km double")
    return df.filter(F.col("price").isNotNull() & (F.col("price") > 0) & F.col("distance_km").isNotNull())
