"""Market calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.functions.stats import regression_metrics
from farelake.operators import calibrate as CAL
from farelake.operators import models as M
from farelake.plans import datasets as D
from farelake.plans.oracle_base import rnd, with_base
from farelake.plans.oracle_requests import loro_1d_sql, metrics_sql, observations_sql
from farelake.plans.registry import register
from farelake.session import written_table

_OBS = observations_sql()
_LORO = _OBS + ",\n" + loro_1d_sql("route", "lr") + ",\n" + loro_1d_sql("corridor", "lc")


def observations(spark, sf):
    f = D.fares(spark, sf)
    return CAL.observation_records(f, M.fit_class_loglinear(f))


def _rounded_metrics(df, y, p):
    m = df.agg(*regression_metrics(F.col(y), F.col(p)))
    return m.select(*[F.round(c, 4).alias(c) for c in ("mae", "mse", "rmse")], F.round("r2", 6).alias("r2"))


@register(
    "h1_observation_records",
    sql=with_base("SELECT route, corridor, airline, cabin, days_left, round(hist_pred, 2) AS hist_pred, distance_km, market_fare FROM obs", _OBS),
)
def h1_observation_records(spark, sf):
    """Observation records: route, corridor, cabin, days, smeared historical prediction, market fare."""
    o = observations(spark, sf)
    return o.select("route", "corridor", "airline", "cabin", "days_left", F.round("hist_pred", 2).alias("hist_pred"), "distance_km", "market_fare")


@register("h2_loro_ridge_1d", sql=with_base(f"SELECT count(*) AS rows, {metrics_sql('market_fare', 'oof_pred')} FROM lr_oof", _LORO))
def h2_loro_ridge_1d(spark, sf):
    """Leave-one-route-out ridge (one feature): out-of-fold metrics from per-route sufficient statistics."""
    of = CAL.with_features(observations(spark, sf))
    oof = CAL.out_of_fold(of, CAL.loro_coefficients(of, "route", CAL.LOG_HIST_FEATURES), "route", CAL.LOG_HIST_FEATURES)
    return oof.groupBy().agg(F.count("*").alias("rows")).crossJoin(_rounded_metrics(oof, "market_fare", "oof_pred"))


@register("h2_loco_ridge_1d", sql=with_base(f"SELECT count(*) AS rows, {metrics_sql('market_fare', 'oof_pred')} FROM lc_oof", _LORO))
def h2_loco_ridge_1d(spark, sf):
    """Leave-one-corridor-out ridge (one feature) out-of-fold metrics."""
    of = CAL.with_features(observations(spark, sf))
    oof = CAL.out_of_fold(of, CAL.loro_coefficients(of, "corridor", CAL.LOG_HIST_FEATURES), "corridor", CAL.LOG_HIST_FEATURES)
    return oof.groupBy().agg(F.count("*").alias("rows")).crossJoin(_rounded_metrics(oof, "market_fare", "oof_pred"))


@register("h2_loro_ridge_full", sql=None)
def h2_loro_ridge_full(spark, sf):
    """Leave-one-route-out ridge on the five calibration features (folds solved together in mapInPandas)."""
    of = CAL.with_features(observations(spark, sf))
    oof = CAL.out_of_fold(of, CAL.loro_coefficients(of, "route", CAL.FULL_FEATURES), "route", CAL.FULL_FEATURES)
    return oof.groupBy().agg(F.count("*").alias("rows")).crossJoin(_rounded_metrics(oof, "market_fare", "oof_pred"))


@register(
    "h3_global_inflation",
    sql=with_base(
        f"""SELECT round(f.factor, 6) AS factor, {rnd('avg(abs(o.market_fare - o.hist_pred * f.factor))', 4)} AS mae
FROM obs o, (SELECT median(market_fare / hist_pred) AS factor FROM obs) f GROUP BY f.factor""",
        _OBS,
    ),
)
def h3_global_inflation(spark, sf):
    """Global inflation baseline: median market/historical ratio and its MAE."""
    o = observations(spark, sf)
    fac = CAL.global_factor(o)
    j = o.crossJoin(F.broadcast(fac))
    return j.groupBy("factor").agg(F.round(F.avg(F.abs(F.col("market_fare") - F.col("hist_pred") * F.col("factor"))), 4).alias("mae")).select(
        F.round("factor", 6).alias("factor"), "mae"
    )


@register("h4_no_calibration", sql=with_base(f"SELECT {metrics_sql('market_fare', 'hist_pred')} FROM obs", _OBS))
def h4_no_calibration(spark, sf):
    """Baseline metrics without calibration."""
    return _rounded_metrics(observations(spark, sf), "market_fare", "hist_pred")


CANDIDATES_SQL = """SELECT 'none' AS candidate, 0 AS ordinal, round(avg(abs(market_fare - hist_pred)), 4) AS mae, CAST(NULL AS DOUBLE) AS loco_mae FROM obs
UNION ALL SELECT 'global_inflation', 1, round(avg(abs(market_fare - hist_pred * factor)), 4), NULL FROM obs, (SELECT median(market_fare / hist_pred) AS factor FROM obs)
UNION ALL SELECT 'ridge', 2, (SELECT round(avg(abs(market_fare - oof_pred)), 4) FROM lr_oof), (SELECT round(avg(abs(market_fare - oof_pred)), 4) FROM lc_oof)"""


@register("h5_candidate_table", sql=with_base(CANDIDATES_SQL, _LORO))
def h5_candidate_table(spark, sf):
    """Candidate table: none / global inflation / ridge with LORO MAE and leave-one-corridor-out MAE."""
    c = CAL.candidate_table(observations(spark, sf), CAL.LOG_HIST_FEATURES)
    return c.select("candidate", "ordinal", F.round("mae", 4).alias("mae"), F.round("loco_mae", 4).alias("loco_mae"))


def _rounded_candidates(c):
    return c.select("candidate", "ordinal", *(F.round(m, 4).alias(m) for m in ("mae", "rmse", "r2", "loco_mae")))


@register("h5_candidate_table_robust", sql=None)
def h5_candidate_table_robust(spark, sf):
    """None, inflation, ridge and huber on the five features: LORO metrics and leave-one-corridor-out MAE (all folds at once)."""
    o = written_table(observations(spark, sf), "observations")  # read by every candidate and pass
    huber = CAL.huber_folds(CAL.with_features(o), CAL.FULL_FEATURES)
    return _rounded_candidates(CAL.candidate_table(o, CAL.FULL_FEATURES, huber=huber))


@register("h5_candidate_trees", sql=None)
def h5_candidate_trees(spark, sf):
    """Forest and boosting calibrators with whole groups of routes (corridors) held out: metrics of out-of-fold predictions."""
    return _rounded_candidates(CAL.tree_candidates(observations(spark, sf), CAL.FULL_FEATURES))


@register("h6_h9_selection_robust", sql=None)
def h6_h9_selection_robust(spark, sf):
    """Selection and status among none, inflation, ridge and huber on the five features."""
    c = CAL.calibrator(observations(spark, sf), CAL.FULL_FEATURES, robust=True)
    return c.select("best_model", F.round("mae_after", 4).alias("mae_after"), "status", *(F.round(f"b{i}", 6).alias(f"b{i}") for i in range(6)))


@register(
    "h6_h9_selection",
    sql=with_base(
        """SELECT best_model, round(mae_after, 4) AS mae_after,
  CASE WHEN best_model = 'ridge' AND mae_ridge < 0.85 * mae_none THEN 'validated_loro' ELSE 'experimental' END AS status FROM (
  SELECT *, CASE WHEN mae_ridge < mae_none THEN 'ridge' WHEN mae_inflation < mae_none THEN 'global_inflation' ELSE 'none' END AS best_model,
    CASE WHEN mae_ridge < mae_none THEN mae_ridge WHEN mae_inflation < mae_none THEN mae_inflation ELSE mae_none END AS mae_after FROM (
  SELECT (SELECT avg(abs(market_fare - hist_pred)) FROM obs) AS mae_none,
    (SELECT avg(abs(market_fare - hist_pred * factor)) FROM obs, (SELECT median(market_fare / hist_pred) AS factor FROM obs)) AS mae_inflation,
    (SELECT avg(abs(market_fare - oof_pred)) FROM lr_oof) AS mae_ridge))""",
        _LORO,
    ),
)
def h6_h9_selection(spark, sf):
    """Selection (strict improvement, listed order) and validation status (< 0.85 x uncalibrated MAE)."""
    s = CAL.select_calibrator(CAL.candidate_table(observations(spark, sf), CAL.LOG_HIST_FEATURES))
    return s.select("best_model", F.round("mae_after", 4).alias("mae_after"), "status")


@register(
    "h7_final_fit",
    sql=with_base(
        """SELECT round((t.sy / t.n) - (t.sx / t.n) * b1, 6) AS b0, round(b1, 6) AS b1 FROM lr_t t,
  (SELECT (sxy - n * (sx / n) * (sy / n)) / ((sxx - n * (sx / n) * (sx / n)) + 0.5) AS b1 FROM lr_t)""",
        _LORO,
    ),
)
def h7_final_fit(spark, sf):
    """Final ridge (one feature) on all observations."""
    c = CAL.fit_all(CAL.with_features(observations(spark, sf)), CAL.LOG_HIST_FEATURES)
    return c.select(F.round("b0", 6).alias("b0"), F.round("b1", 6).alias("b1"))


@register(
    "h8_route_table",
    sql=with_base(
        """SELECT route, count(*) AS observations, round(avg(hist_pred), 0) AS historical_ml, round(avg(oof_pred), 0) AS calibrated_oof,
  round(avg(market_fare), 0) AS market_fare, round((avg(oof_pred) - avg(market_fare)) / avg(market_fare) * 100, 1) AS error_pct, true AS out_of_fold
FROM lr_oof GROUP BY route""",
        _LORO,
    ),
)
def h8_route_table(spark, sf):
    """Per-route validation table of out-of-fold predictions."""
    return CAL.route_table(observations(spark, sf), CAL.LOG_HIST_FEATURES)


@register(
    "h10_summary",
    sql=with_base(
        "SELECT count(*) AS observation_count, count(DISTINCT route) AS unique_routes, count(DISTINCT corridor) AS unique_corridors FROM obs",
        _OBS,
    ),
)
def h10_summary(spark, sf):
    """Observation, route and corridor counts."""
    o = observations(spark, sf)
    return o.agg(
        F.count("*").alias("observation_count"), F.count_distinct("route").alias("unique_routes"), F.count_distinct("corridor").alias("unique_corridors")
    )


@register("h12_in_sample_check", sql=None)
def h12_in_sample_check(spark, sf):
    """In-sample check of the final five-feature ridge: MAE before/after, R², mean residual, the 15-day slice and each of its rows."""
    return CAL.in_sample_check(observations(spark, sf), CAL.FULL_FEATURES)
