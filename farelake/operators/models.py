"""Fare models.

Two kinds:
* closed-form, SQL-checkable models fitted with one aggregate (per-class log-linear fit via
  ``regr_slope``/``regr_intercept``) — used by the router (G18), calibration records and
  the estimate chain so every step has an oracle;
* Spark ML estimators (G1-G9) on an assembled feature vector: the distributed twins of the
  reference's candidates, fitted and scored on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelake.functions.features import PRICE_FLOOR

ROUTED_CLASSES = ["Economy", "Business"]


def routed_class(c: Column) -> Column:
    """Title-cased class; Economy / Business keep their model, anything else -> Economy (global)."""
    t = F.initcap(F.trim(c))
    return F.when(t.isin(*ROUTED_CLASSES), t).otherwise(F.lit("Economy"))


def fit_class_loglinear(train: DataFrame, x: str = "distance_km", y: str = "price") -> DataFrame:
    """Per-class fit of log1p(price) = a + b * x (one aggregate; at most 2 rows out)."""
    ly = F.log1p(F.col(y))
    return (
        train.filter(F.col("class").isin(*ROUTED_CLASSES))
        .groupBy(F.col("class").alias("model_class"))
        .agg(F.regr_slope(ly, F.col(x)).alias("slope"), F.regr_intercept(ly, F.col(x)).alias("intercept"))
    )


def route_predict(df: DataFrame, coefs: DataFrame, x: str = "distance_km", out: str = "pred") -> DataFrame:
    """Route each row to its class model, back-transform with expm1, floor at 500."""
    c = coefs
    j = df.withColumn("model_class", routed_class(F.col("class"))).join(c, "model_class", "left")
    pred = F.greatest(F.expm1(F.col("intercept") + F.col("slope") * F.col(x)), F.lit(PRICE_FLOOR))
    return j.withColumn(out, pred).drop("slope", "intercept")
