"""Aggregate helpers: exact money aggregates, regression metrics, interval critical values."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(c: Column | str) -> Column:
    """Money as integral cents, so sums/averages/medians are exact and order independent."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("long")


def money_sum(c) -> Column:
    return F.sum(cents(c)) / 100.0


def money_avg(c) -> Column:
    return F.avg(cents(c)) / 100.0


def regression_metrics(y: Column, pred: Column, guard_sst: bool = False) -> list[Column]:
    """G13/G14 in one aggregate: MAE, MSE, RMSE, R² (SST guarded by 1e-8 when asked).

    R² = 1 - SSE/SST with SST = Σ(y-ȳ)² computed as n·var_pop(y), numerically stable.
    """
    err = y - pred
    sse = F.sum(err * err)
    sst = F.var_pop(y) * F.count(y)
    if guard_sst:
        sst = F.greatest(sst, F.lit(1e-8))
    mse = F.avg(err * err)
    return [
        F.avg(F.abs(err)).alias("mae"),
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (1 - sse / sst).alias("r2"),
    ]


def z_critical(confidence: float) -> float:
    """Two-sided standard-normal critical value (driver scalar)."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


def chi2_quantile_wh(p: float, dof: Column) -> Column:
    """χ² quantile by the Wilson–Hilferty cube approximation, as a column of the d.o.f."""
    z = NormalDist().inv_cdf(p)
    k = dof.cast("double")
    base = 1 - 2 / (9 * k) + z * F.sqrt(2 / (9 * k))
    return k * base * base * base
