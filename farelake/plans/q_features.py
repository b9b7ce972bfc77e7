"""Feature engineering and preprocessing-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators import encode as EN
from farelake.operators import ranks as R
from farelake.functions import features as FE
from farelake.operators import models as M
from farelake.operators import splits as SP
from farelake.plans import datasets as D
from farelake.plans.oracle_base import rnd, with_base
from farelake.plans.q_splits import KEY_SQL
from farelake.plans.registry import register
from farelake.session import written_table

NUM = FE.NUMERICAL_CORE
CAT = FE.CATEGORICAL_WITH_CLASS

SPLIT_SQL = f"""fares_split AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {KEY_SQL}) <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split
  FROM fares),
train AS (SELECT * FROM fares_split WHERE split = 'train'),
test AS (SELECT * FROM fares_split WHERE split = 'test')"""


def _train_test(spark, sf):
    s = SP.random_holdout(D.fares(spark, sf))
    return s.filter("split = 'train'"), s.filter("split = 'test'")


@register(
    "e4_engineered_features",
    sql=with_base(
        "SELECT airline, flight, route, price, round(log_days_left, 6) AS log_days_left, "
        "round(duration_distance_ratio, 9) AS duration_distance_ratio, round(speed_kmh, 6) AS speed_kmh, route_id, airline_route_id FROM fares"
    ),
)
def e4_engineered_features(spark, sf):
    """log_days_left, duration/distance ratio, speed, route and airline-route ids."""
    f = D.fares(spark, sf)
    return f.select(
        "airline", "flight", "route", "price",
        F.round("log_days_left", 6).alias("log_days_left"),
        F.round("duration_distance_ratio", 9).alias("duration_distance_ratio"),
        F.round("speed_kmh", 6).alias("speed_kmh"),
        "route_id", "airline_route_id",
    )


@register(
    "e5_experiment_subset",
    sql=with_base(
        """SELECT class, count(*) AS rows, round(avg(ln(1 + days_left)), 6) AS mean_log_days,
  round(avg(duration / greatest(distance_km, 50.0)), 9) AS mean_ratio, round(avg(distance_km / greatest(duration, 0.5)), 6) AS mean_speed
FROM fares WHERE class IN ('Economy', 'Business') AND days_left IS NOT NULL GROUP BY class"""
    ),
)
def e5_experiment_subset(spark, sf):
    """Known class and booking window only, with the experiment's feature variants."""
    f = D.fares(spark, sf).filter(F.col("class").isin("Economy", "Business") & F.col("days_left").isNotNull())
    return f.groupBy("class").agg(
        F.count("*").alias("rows"),
        F.round(F.avg(F.log1p("days_left")), 6).alias("mean_log_days"),
        F.round(F.avg(F.col("duration") / F.greatest("distance_km", F.lit(50.0))), 9).alias("mean_ratio"),
        F.round(F.avg(F.col("distance_km") / F.greatest("duration", F.lit(0.5))), 6).alias("mean_speed"),
    )


@register("e6_feature_projection", sql=with_base(f"SELECT {', '.join(CAT)}, price FROM fares"))
def e6_feature_projection(spark, sf):
    """Model feature frame: categorical features with class, plus the target."""
    return D.fares(spark, sf).select(*CAT, "price")


@register(
    "e7_median_imputation",
    sql=with_base(" UNION ALL ".join(f"SELECT '{c}' AS column, {rnd(f'median({c})', 6)} AS median FROM train" for c in NUM), SPLIT_SQL),
)
def e7_median_imputation(spark, sf):
    """Median of every numeric feature on the training split (interpolated, exact)."""
    train, _ = _train_test(spark, sf)
    wide = R.column_quantiles(train, NUM, {"median": 0.5})
    args = ", ".join(f"'{c}', round(`{c}`.median, 6)" for c in NUM)
    return wide.selectExpr(f"stack({len(NUM)}, {args}) AS (column, median)")


@register(
    "e8_mode_imputation",
    sql=with_base(
        " UNION ALL ".join(
            f"(SELECT '{c}' AS column, v AS mode FROM (SELECT \"{c}\" AS v, count(*) AS n FROM train WHERE \"{c}\" IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"
            for c in CAT
        ),
        SPLIT_SQL,
    ),
)
def e8_mode_imputation(spark, sf):
    """Most frequent value of every categorical feature on the training split (ties -> smallest)."""
    train, _ = _train_test(spark, sf)
    wide = train.agg(*[F.mode(c, True).alias(c) for c in CAT])
    args = ", ".join(f"'{c}', `{c}`" for c in CAT)
    return wide.selectExpr(f"stack({len(CAT)}, {args}) AS (column, mode)")


@register(
    "e9_standardise_stats",
    sql=with_base(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column, {rnd(f'avg({c})', 6)} AS mean, {rnd(f'stddev_pop({c})', 6)} AS std FROM train" for c in NUM
        ),
        SPLIT_SQL,
    ),
)
def e9_standardise_stats(spark, sf):
    """Scaler statistics on the training split: mean and population standard deviation."""
    train, _ = _train_test(spark, sf)
    wide = train.agg(*[x for c in NUM for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    args = ", ".join(f"'{c}', round(`m_{c}`, 6), round(`s_{c}`, 6)" for c in NUM)
    return wide.selectExpr(f"stack({len(NUM)}, {args}) AS (column, mean, std)")


def _apply_sql(impute: bool = True) -> str:
    parts = []
    for c in NUM:
        value = f"coalesce(t.{c}, s.med)" if impute else f"t.{c}"
        parts.append(
            f"""SELECT '{c}' AS column, {rnd(f"avg(CASE WHEN s.sd = 0 THEN 0.0 ELSE ({value} - s.mu) / s.sd END)", 6)} AS mean_scaled
  FROM test t, (SELECT median({c}) AS med, avg({c}) AS mu, stddev_pop({c}) AS sd FROM train) s"""
        )
    return " UNION ALL ".join(parts)


def _preprocessed(spark, sf, impute: bool):
    """Mean scaled value per numeric column of the test part, by statistics of the training part alone."""
    split = written_table(SP.random_holdout(D.fares(spark, sf).select(*NUM, *[c for c in (*SP.ROW_KEY_COLUMNS, *SP.ROW_KEY_NUMBERS) if c not in NUM])), "split")
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    stats = train.agg(*[x for c in NUM for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))])
    if impute:
        stats = stats.crossJoin(F.broadcast(R.column_quantiles(train, NUM, {"median": 0.5}).select(*(F.col(f"{c}.median").alias(f"med_{c}") for c in NUM))))
    j = test.crossJoin(F.broadcast(written_table(stats, "scales")))  # one row
    value = {c: F.coalesce(F.col(c), F.col(f"med_{c}")) if impute else F.col(c) for c in NUM}
    scaled = {c: F.when(F.col(f"sd_{c}") == 0, F.lit(0.0)).otherwise((value[c] - F.col(f"mu_{c}")) / F.col(f"sd_{c}")) for c in NUM}
    wide = j.agg(*[F.avg(e).alias(c) for c, e in scaled.items()])
    args = ", ".join(f"'{c}', round(`{c}`, 6)" for c in NUM)
    return wide.selectExpr(f"stack({len(NUM)}, {args}) AS (column, mean_scaled)")


@register("e11_preprocess_apply", sql=with_base(_apply_sql(), SPLIT_SQL))
def e11_preprocess_apply(spark, sf):
    """Fit median-impute + standardise on train, apply to test (no leakage); mean scaled value per column."""
    return _preprocessed(spark, sf, impute=True)


@register("e12_preprocess_without_imputation", sql=with_base(_apply_sql(impute=False), SPLIT_SQL))
def e12_preprocess_without_imputation(spark, sf):
    """The legacy preprocessor: standardised as E11 but nothing imputed, so missing values stay missing."""
    return _preprocessed(spark, sf, impute=False)


_DICTIONARY_SQL = """dictionary AS (
  SELECT ord, col, value, row_number() OVER (ORDER BY ord, value) - 1 AS slot FROM (
""" + " UNION ALL ".join(f"SELECT DISTINCT {i} AS ord, '{c}' AS col, \"{c}\" AS value FROM train WHERE \"{c}\" IS NOT NULL" for i, c in enumerate(CAT)) + "))"


@register("e10_category_dictionary", sql=with_base("SELECT col, value, CAST(slot AS INTEGER) AS slot FROM dictionary", SPLIT_SQL + ",\n" + _DICTIONARY_SQL))
def e10_category_dictionary(spark, sf):
    """One-hot dictionary of the training part: a slot for every value of every categorical feature."""
    train, _ = _train_test(spark, sf)
    return EN.dictionary(train, CAT)


@register(
    "e10_one_hot_slots",
    sql=with_base(
        "SELECT airline, flight, price, duration, "
        + "concat_ws(',', " + ", ".join(f"CAST((SELECT min(slot) FROM dictionary d WHERE d.col = '{c}' AND d.value = t.\"{c}\") AS VARCHAR)" for c in CAT) + ") AS slots FROM test t",
        SPLIT_SQL + ",\n" + _DICTIONARY_SQL,
    ),
)
def e10_one_hot_slots(spark, sf):
    """Sparse one-hot slots of every test row by the training dictionary; a null or unseen value sets none."""
    train, test = _train_test(spark, sf)
    coded = EN.one_hot(test, EN.dictionary(train, CAT), CAT)
    return coded.select("airline", "flight", "price", "duration", F.array_join("slots", ",").alias("slots"))


ROUTER_SQL = """coefs AS (
  SELECT class AS model_class, regr_slope(ln(1 + price), distance_km) AS slope, regr_intercept(ln(1 + price), distance_km) AS intercept
  FROM fares WHERE class IN ('Economy', 'Business') GROUP BY class),
routed AS (
  SELECT f.*, greatest(exp(c.intercept + c.slope * f.distance_km) - 1, 500.0) AS pred
  FROM fares f JOIN coefs c ON c.model_class = CASE WHEN f.class IN ('Economy', 'Business') THEN f.class ELSE 'Economy' END)"""


@register(
    "e14_log_target",
    sql=with_base(
        """SELECT class, count(*) AS rows, round(avg(ln(1 + price)), 6) AS mean_log_price,
  round(exp(avg(ln(1 + price))) - 1, 2) AS back_transformed,
  round(avg(exp(ln(1 + price) - (c.intercept + c.slope * distance_km))), 6) AS smearing_factor
FROM fares JOIN coefs c ON c.model_class = class GROUP BY class""",
        ROUTER_SQL,
    ),
)
def e14_log_target(spark, sf):
    """Log target per class, its back-transform, and the smearing factor estimated as mean exp(residual)."""
    f = D.fares(spark, sf).filter(F.col("class").isin(*M.ROUTED_CLASSES))
    coefs = M.fit_class_loglinear(D.fares(spark, sf))
    j = f.join(F.broadcast(coefs), f["class"] == coefs["model_class"])
    ly = F.log1p("price")
    return j.groupBy("class").agg(
        F.count("*").alias("rows"),
        F.round(F.avg(ly), 6).alias("mean_log_price"),
        F.round(F.expm1(F.avg(ly)), 2).alias("back_transformed"),
        F.round(F.avg(F.exp(ly - (F.col("intercept") + F.col("slope") * F.col("distance_km")))), 6).alias("smearing_factor"),
    )
