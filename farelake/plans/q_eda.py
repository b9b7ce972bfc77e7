"""Exploratory aggregates and interval estimates (K1-K21) over the enriched fares."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators import ranks as R
from farelake.plans import datasets as D
from farelake.functions import stats as S
from farelake.plans.oracle_base import money_avg, money_median, rnd, with_base
from farelake.plans.registry import register


@register(
    "k16_price_by_class_route",
    sql=with_base(
        f"""SELECT class, route, count(*) AS flights, {rnd(money_avg('price'), 2)} AS mean_price,
       {rnd(money_median('price'), 2)} AS median_price, {rnd('avg(distance_km)', 2)} AS mean_distance_km
FROM fares GROUP BY class, route"""
    ),
)
def k16_price_by_class_route(spark, sf):
    """Flagship: flights, mean/median price and mean distance per class and route."""
    return _with_median(
        D.fares(spark, sf),
        ["class", "route"],
        F.count("*").alias("flights"),
        F.round(S.money_avg("price"), 2).alias("mean_price"),
        F.round(F.avg("distance_km"), 2).alias("mean_distance_km"),
    )


def _with_median(df, keys, *aggs):
    """Aggregates per key, and the exact median price beside them."""
    medians = R.quantiles(df.select(*keys, S.cents("price").alias("_cents")), keys, "_cents", {"_median": 0.5})
    out = R.joined(df.groupBy(*keys).agg(*aggs), medians, keys)
    return out.withColumn("median_price", F.round(F.col("_median") / 100.0, 2)).drop("_median")


# ---------------------------------------------------------------------------
# K1-K21
# ---------------------------------------------------------------------------
from farelake.functions.stats import chi2_quantile_wh, z_critical  # noqa: E402
from farelake.operators import eda as K  # noqa: E402
from farelake.plans.oracle_base import cents, money_pct, money_sum  # noqa: E402
from farelake.plans.q_features import ROUTER_SQL  # noqa: E402
from farelake.plans.q_splits import KEY_SQL  # noqa: E402

DESCRIBE_COLS = ["price", "duration", "days_left", "distance_km"]


def _describe_sql(cols):
    parts = []
    for c in cols:
        for m, e in [
            ("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})"),
            ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)"),
            ("max", f"max({c})"),
        ]:
            parts.append(f"SELECT '{c}' AS column, '{m}' AS stat, {rnd(e, 4)} AS value FROM fares")
    return " UNION ALL ".join(parts)


@register("k1_describe", sql=with_base(_describe_sql(DESCRIBE_COLS)))
def k1_describe(spark, sf):
    """count/mean/std/min/quartiles/max of the numeric columns (exact interpolated quartiles)."""
    return K.describe(D.fares(spark, sf), DESCRIBE_COLS)


@register(
    "k2_info",
    sql=with_base(" UNION ALL ".join(f"SELECT '{c}' AS column, count(\"{c}\") AS non_null FROM fares" for c in
                                     ["airline", "flight", "source_city", "departure_time", "stops", "arrival_time", "destination_city", "class", "duration", "days_left", "price"])),
)
def k2_info(spark, sf):
    """Non-null count per column (dtypes are metadata: ``df.dtypes``)."""
    cols = ["airline", "flight", "source_city", "departure_time", "stops", "arrival_time", "destination_city", "class", "duration", "days_left", "price"]
    return K.non_null_counts(D.fares(spark, sf), cols)


@register(
    "k3_global_summary",
    sql=with_base(f"SELECT {rnd(money_avg('price'), 2)} AS mean_price, count(DISTINCT airline) AS airlines, count(DISTINCT stops) AS stops_values FROM fares"),
)
def k3_global_summary(spark, sf):
    """Global mean price, number of airlines and of stops values."""
    return D.fares(spark, sf).agg(
        F.round(S.money_avg("price"), 2).alias("mean_price"),
        F.count_distinct("airline").alias("airlines"),
        F.count_distinct("stops").alias("stops_values"),
    )


@register(
    "k4_stops_per_airline_top10",
    sql=with_base("SELECT airline, count(stops) AS stops_count FROM fares GROUP BY airline ORDER BY stops_count DESC, airline LIMIT 10"),
)
def k4_stops_per_airline_top10(spark, sf):
    """Non-null stops count per airline, top 10 (a top-k report)."""
    g = D.fares(spark, sf).groupBy("airline").agg(F.count("stops").alias("stops_count"))
    return g.orderBy(F.desc("stops_count"), "airline").limit(10)


@register(
    "k5_filter_project",
    sql=with_base("SELECT airline, flight, destination_city, price FROM fares WHERE source_city = 'Bangalore' AND price > 4600"),
)
def k5_filter_project(spark, sf):
    """Conjunctive predicate + projection (source Bangalore, price > 4600)."""
    f = D.fares(spark, sf)
    return f.filter((F.col("source_city") == "Bangalore") & (F.col("price") > 4600)).select("airline", "flight", "destination_city", "price")


@register(
    "k6_price_range_labels",
    sql=with_base(
        f"""SELECT price_range, count(airline) AS airlines FROM (
  SELECT airline, CASE WHEN price - m > 500 THEN 'Price far above average'
                       WHEN price - m >= 0 AND price - m <= 500 THEN 'Price in the average range'
                       ELSE 'Price far below average' END AS price_range
  FROM fares, (SELECT {money_avg('price')} AS m FROM fares) s) GROUP BY price_range"""
    ),
)
def k6_price_range_labels(spark, sf):
    """Label each row against the global mean (>500 above, 0..500 average, else below); count per label."""
    return K.price_range_labels(D.fares(spark, sf))


@register(
    "k7_price_extremes",
    sql=with_base(
        """SELECT 'max' AS extreme, airline, flight, route, price FROM fares WHERE price = (SELECT max(price) FROM fares)
UNION ALL SELECT 'min', airline, flight, route, price FROM fares WHERE price = (SELECT min(price) FROM fares)"""
    ),
)
def k7_price_extremes(spark, sf):
    """All rows attaining the maximum and the minimum price (ties kept)."""
    return K.extremes(D.fares(spark, sf), "price", ["airline", "flight", "route", "price"])


@register("k8_mean_price_by_duration", sql=with_base(f"SELECT duration, {rnd(money_avg('price'), 2)} AS mean_price FROM fares GROUP BY duration"))
def k8_mean_price_by_duration(spark, sf):
    """Mean price per raw duration value."""
    return D.fares(spark, sf).groupBy("duration").agg(F.round(S.money_avg("price"), 2).alias("mean_price"))


def _hist_sql(n):
    return f"""SELECT {n} AS bins, b.bin, coalesce(h.rows, 0) AS rows, round(m.mn + (b.bin - 1) * (m.mx - m.mn) / {n}, 4) AS lower_edge
FROM (SELECT unnest(range(1, {n} + 1)) AS bin) b
CROSS JOIN (SELECT min(price) AS mn, max(price) AS mx FROM fares) m
LEFT JOIN (SELECT least({n}, CAST(floor((price - mn) * {n} / (mx - mn)) AS BIGINT) + 1) AS bin, count(*) AS rows
           FROM fares, (SELECT min(price) AS mn, max(price) AS mx FROM fares) GROUP BY 1) h ON h.bin = b.bin"""


@register("k9_price_histograms", sql=with_base(" UNION ALL ".join(_hist_sql(n) for n in (30, 40, 100))))
def k9_price_histograms(spark, sf):
    """Equal-width price histograms with 30, 40 and 100 bins (empty bins kept)."""
    f = D.fares(spark, sf)
    out = None
    for n in (30, 40, 100):
        h = K.histogram(f, "price", n)
        out = h if out is None else out.unionByName(h)
    return out


CORR_COLS = ["price", "duration", "days_left", "distance_km"]


@register(
    "k10_correlations",
    sql=with_base(
        " UNION ALL ".join(
            f"SELECT CASE WHEN grouping(stops) = 1 THEN 'ALL' ELSE coalesce(stops, 'NULL') END AS hue, '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM fares GROUP BY GROUPING SETS ((stops), ())"
            for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]
        )
    ),
)
def k10_correlations(spark, sf):
    """Pairwise Pearson correlations of numeric columns, overall and per stops category."""
    return K.correlations(D.fares(spark, sf), CORR_COLS, "stops")


@register(
    "k11_price_by_stops_box",
    sql=with_base(
        f"""SELECT f.stops, {rnd(money_avg('price'), 2)} AS mean_price, round(any_value(q.q1), 4) AS q1, round(any_value(q.q2), 4) AS median,
  round(any_value(q.q3), 4) AS q3,
  min(price) FILTER (WHERE price >= q.q1 - 1.5 * (q.q3 - q.q1)) AS whisker_low,
  max(price) FILTER (WHERE price <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_high
FROM fares f JOIN (SELECT stops, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS q2, quantile_cont(price, 0.75) AS q3
                   FROM fares GROUP BY stops) q ON f.stops IS NOT DISTINCT FROM q.stops
GROUP BY f.stops"""
    ),
)
def k11_price_by_stops_box(spark, sf):
    """Mean price and box statistics (quartiles, whiskers at 1.5 IQR) per stops category."""
    return K.box_stats(D.fares(spark, sf), "stops", "price")


SAMPLE_SQL = f"""sample100 AS (SELECT * FROM fares ORDER BY md5({KEY_SQL} || '|sample') LIMIT 100)"""


@register(
    "k12_seeded_sample",
    sql=with_base(
        f"""SELECT (SELECT count(*) FROM sample100) AS sample_rows, (SELECT count(*) FROM fares) AS population_rows,
  (SELECT {rnd(money_avg('price'), 2)} FROM sample100) AS sample_mean, (SELECT {rnd(money_avg('price'), 2)} FROM fares) AS population_mean""",
        SAMPLE_SQL,
    ),
)
def k12_seeded_sample(spark, sf):
    """Reproducible sample of 100 rows (seeded hash order, top-k not full sort) vs population mean."""
    f = D.fares(spark, sf)
    s = K.seeded_sample(f, 100)
    a = s.agg(F.count("*").alias("sample_rows"), F.round(S.money_avg("price"), 2).alias("sample_mean"))
    b = f.agg(F.count("*").alias("population_rows"), F.round(S.money_avg("price"), 2).alias("population_mean"))
    return a.crossJoin(b).select("sample_rows", "population_rows", "sample_mean", "population_mean")


@register(
    "k13_resampled_means",
    sql=with_base(
        f"""SELECT rep, {rnd(money_avg('price'), 4)} AS mean_price FROM (
  SELECT r.rep, s.price FROM (SELECT unnest(range(0, 1000)) AS rep) r, (SELECT unnest(range(0, 30)) AS j) d,
     (SELECT price, row_number() OVER (ORDER BY md5({KEY_SQL} || '|sample')) - 1 AS idx FROM sample100) s
  WHERE s.idx = ('0x' || substr(md5(CAST(r.rep AS VARCHAR) || ':' || CAST(d.j AS VARCHAR) || ':42'), 1, 8))::BIGINT % (SELECT count(*) FROM sample100))
GROUP BY rep""",
        SAMPLE_SQL,
    ),
)
def k13_resampled_means(spark, sf):
    """1000 resamples (with replacement, size 30) of the 100-row sample; mean of each."""
    s = K.seeded_sample(D.fares(spark, sf), 100)
    return K.resample_means(s, "price", reps=1000, size=30)


Z95, Z90 = z_critical(0.95), z_critical(0.90)


@register(
    "k14_z_intervals",
    sql=with_base(
        f"""SELECT count(price) AS n, round(avg(price), 4) AS mean,
  round(avg(price) - CAST({Z95} AS DOUBLE) * 14.6 / sqrt(count(price)), 4) AS lo_known_sigma, round(avg(price) + CAST({Z95} AS DOUBLE) * 14.6 / sqrt(count(price)), 4) AS hi_known_sigma,
  round(avg(price) - CAST({Z90} AS DOUBLE) * stddev_samp(price) / sqrt(count(price)), 4) AS lo_sample_var,
  round(avg(price) + CAST({Z90} AS DOUBLE) * stddev_samp(price) / sqrt(count(price)), 4) AS hi_sample_var
FROM fares"""
    ),
)
def k14_z_intervals(spark, sf):
    """95 % z-interval with known sigma 14.6 and 90 % interval with the sample variance."""
    return K.z_intervals(D.fares(spark, sf), "price", known_sigma=14.6)


def _chi_sql():
    from statistics import NormalDist

    zs = {p: NormalDist().inv_cdf(p) for p in (0.975, 0.025)}
    k = "CAST(count(price) - 1 AS DOUBLE)"

    def q(p):
        b = f"(1 - 2 / (9 * {k}) + {zs[p]} * sqrt(2 / (9 * {k})))"
        return f"({k} * {b} * {b} * {b})"

    return f"""SELECT count(price) AS n, round(stddev_samp(price), 4) AS std,
  round(sqrt({k} * var_samp(price) / {q(0.975)}), 4) AS std_lo, round(sqrt({k} * var_samp(price) / {q(0.025)}), 4) AS std_hi FROM fares"""


@register("k15_std_interval", sql=with_base(_chi_sql()))
def k15_std_interval(spark, sf):
    """95 % chi-square interval for the standard deviation (Wilson–Hilferty quantiles)."""
    return K.std_interval(D.fares(spark, sf), "price")


@register(
    "k16_airline_stats",
    sql=with_base(
        f"""SELECT airline, count(*) AS flights, {rnd(money_avg('price'), 2)} AS mean_price, {rnd(money_median('price'), 2)} AS median_price,
  round(stddev_samp(price), 2) AS std_price FROM fares GROUP BY airline"""
    ),
)
def k16_airline_stats(spark, sf):
    """count/mean/median/std of price per airline (report sorted by mean)."""
    g = _with_median(
        D.fares(spark, sf),
        ["airline"],
        F.count("*").alias("flights"),
        F.round(S.money_avg("price"), 2).alias("mean_price"),
        F.round(F.stddev_samp("price"), 2).alias("std_price"),
    )
    return g.orderBy(F.desc("mean_price"))


@register(
    "k17_booking_window_trend",
    sql=with_base(f"SELECT days_left, {rnd(money_avg('price'), 2)} AS mean_price FROM fares WHERE days_left IN (1, 15, 30, 45) GROUP BY days_left"),
)
def k17_booking_window_trend(spark, sf):
    """Mean price per booking window, looked up at 1/15/30/45 days."""
    f = D.fares(spark, sf).filter(F.col("days_left").isin(1, 15, 30, 45))
    return f.groupBy("days_left").agg(F.round(S.money_avg("price"), 2).alias("mean_price"))


@register(
    "k18_route_coverage_top10",
    sql=with_base(
        """SELECT source_city, destination_city, count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT source_city, destination_city FROM fares)) AS routes
FROM fares GROUP BY source_city, destination_city ORDER BY rows DESC, source_city, destination_city LIMIT 10"""
    ),
)
def k18_route_coverage_top10(spark, sf):
    """Rows per directed route (top 10 report) with the number of routes."""
    f = D.fares(spark, sf)
    per = f.groupBy("source_city", "destination_city").agg(F.count("*").alias("rows"))
    n = per.agg(F.count("*").alias("routes"))
    return per.orderBy(F.desc("rows"), "source_city", "destination_city").limit(10).crossJoin(n)


BUCKETS = [(0, 300, "0-300 km"), (300, 700, "300-700 km"), (700, 1500, "700-1500 km"), (1500, 2500, "1500-2500 km"), (2500, 10000, "2500+ km")]


@register(
    "k19_error_by_distance_bucket",
    sql=with_base(
        f"SELECT b.bucket, count(r.price) AS records, {rnd(money_avg('r.price'), 2)} AS actual_mean_price, round(avg(r.pred), 2) AS pred_mean_price, "
        "round(avg(abs(r.price - r.pred)), 2) AS mae FROM (VALUES "
        + ", ".join(f"({lo}, {hi}, '{lab}')" for lo, hi, lab in BUCKETS)
        + ") b(lo, hi, bucket) LEFT JOIN routed r ON r.distance_km >= b.lo AND r.distance_km < b.hi GROUP BY b.bucket",
        ROUTER_SQL,
    ),
)
def k19_error_by_distance_bucket(spark, sf):
    """Router error per distance bucket; empty buckets kept with count 0."""
    from farelake.operators import models as M

    f = D.fares(spark, sf)
    scored = M.route_predict(f, M.fit_class_loglinear(f))
    return K.error_by_bucket(scored, "distance_km", BUCKETS, "price", "pred")


@register(
    "k20_business_questions",
    sql=with_base(
        f"""SELECT (SELECT airline FROM air_means ORDER BY m DESC, airline LIMIT 1) AS dearest_airline,
       (SELECT airline FROM air_means ORDER BY m ASC, airline LIMIT 1) AS cheapest_airline,
       (SELECT count(*) FROM fares WHERE price > (SELECT {money_avg('price')} FROM fares)) AS flights_above_mean,
       (SELECT max(longest) FROM air_means) AS longest_duration""",
        f"air_means AS (SELECT airline, {money_avg('price')} AS m, max(duration) AS longest FROM fares GROUP BY airline)",
    ),
)
def k20_business_questions(spark, sf):
    """Dearest / cheapest airline by mean price, flights above the mean, longest duration."""
    return K.business_questions(D.fares(spark, sf))


@register(
    "k21_share_below_threshold",
    sql=with_base("SELECT stops, round(avg(CASE WHEN price < 10000 THEN 1.0 ELSE 0.0 END), 6) AS share_below_10000 FROM fares GROUP BY stops"),
)
def k21_share_below_threshold(spark, sf):
    """Share of flights under 10,000 per stops category."""
    f = D.fares(spark, sf)
    return f.groupBy("stops").agg(F.round(F.avg((F.col("price") < 10000).cast("double")), 6).alias("share_below_10000"))
