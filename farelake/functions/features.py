"""Feature expressions (E1-E3, E13, E14) as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values ---
DAYS_FILL_FEATURES = 15.0      # days_left fill for engineered features
DURATION_FILL_H = 2.0
DURATION_FLOOR_H = 0.25
DISTANCE_FILL_KM = 1000.0
DISTANCE_FLOOR_KM = 50.0
SMEARING_FACTOR = 1.01388      # log-retransformation bias factor
PRICE_FLOOR = 500.0            # commercial fare floor (INR)
# Feature roles of the fare model.
CATEGORICAL_CORE = ["airline", "departure_time", "arrival_time", "stops", "source_city", "destination_city", "route_id"]
CATEGORICAL_WITH_CLASS = ["class"] + CATEGORICAL_CORE
NUMERICAL_CORE = [
    "duration", "days_left", "log_days_left", "distance_km", "duration_distance_ratio", "speed_kmh",
    "source_lat", "source_lon", "destination_lat", "destination_lon",
]
# --- end of fixed values ---


def add_engineered_features(df: DataFrame) -> DataFrame:
    """log_days_left, duration_distance_ratio, speed_kmh, route_id, airline_route_id."""
    cols = set(df.columns)
    if "days_left" in cols:
        days = F.coalesce(F.col("days_left").try_cast("double"), F.lit(DAYS_FILL_FEATURES))
        log_days = F.log1p(F.greatest(days, F.lit(0.0)))
    else:
        log_days = F.log1p(F.lit(DAYS_FILL_FEATURES))
    dur = F.col("duration").try_cast("double") if "duration" in cols else F.lit(None).cast("double")
    dist = F.col("distance_km").try_cast("double") if "distance_km" in cols else F.lit(None).cast("double")
    dur = F.greatest(F.coalesce(dur, F.lit(DURATION_FILL_H)), F.lit(DURATION_FLOOR_H))
    dist = F.greatest(F.coalesce(dist, F.lit(DISTANCE_FILL_KM)), F.lit(DISTANCE_FLOOR_KM))
    if {"source_city", "destination_city"} <= cols:
        route_id = F.concat(F.col("source_city"), F.lit("_"), F.col("destination_city"))
    else:
        route_id = F.lit("unknown_route")
    out = df.withColumns(
        {
            "log_days_left": log_days,
            "duration_distance_ratio": dur / dist,
            "speed_kmh": dist / dur,
            "route_id": route_id,
        }
    )
    airline_route = (
        F.concat(F.col("airline"), F.lit("_"), F.col("route_id")) if "airline" in cols else F.lit("unknown_airline_route")
    )
    return out.withColumn("airline_route_id", airline_route)
