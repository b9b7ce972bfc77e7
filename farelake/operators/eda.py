"""Exploratory aggregates and interval estimates.

All are single- or two-pass aggregates; scalar results of a first pass (means, bounds,
quartiles) are joined back as 1-row broadcasts, never collected and re-sent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelake.functions import stats as S
from farelake.operators import ranks as R
from farelake.operators.splits import row_key

DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """K1: pandas-style describe (exact interpolated quartiles)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}_n"), F.avg(x).alias(f"{c}_avg"), F.stddev_samp(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    wide = df.agg(*aggs).crossJoin(F.broadcast(R.column_quantiles(df, cols, {"q1": 0.25, "q2": 0.5, "q3": 0.75})))  # one row each
    parts = lambda c: [f"{c}_n", f"{c}_avg", f"{c}_std", f"{c}_min", f"{c}.q1", f"{c}.q2", f"{c}.q3", f"{c}_max"]
    wide = wide.select(*(F.round(F.col(e), 4).alias(f"{c}__{i}") for c in cols for i, e in enumerate(parts(c))))
    pairs = ", ".join(f"'{c}', '{s}', `{c}__{i}`" for c in cols for i, s in enumerate(DESCRIBE_STATS))
    return wide.selectExpr(f"stack({len(cols) * len(DESCRIBE_STATS)}, {pairs}) AS (column, stat, value)")


def non_null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """K2: non-null count per column."""
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, non_null)")


def price_range_labels(df: DataFrame, col: str = "price") -> DataFrame:
    """K6: label against the global mean; count per label."""
    m = df.agg(S.money_avg(col).alias("_m"))
    d = F.col(col) - F.col("_m")
    label = (
        F.when(d > 500, "Price far above average")
        .when((d >= 0) & (d <= 500), "Price in the average range")
        .otherwise("Price far below average")
    )
    j = df.crossJoin(F.broadcast(m))  # 1-row scalar
    return j.groupBy(label.alias("price_range")).agg(F.count("airline").alias("airlines"))


def extremes(df: DataFrame, col: str, keep: list[str]) -> DataFrame:
    """K7: all rows attaining max and min (ties kept) via a join on the 1-row extremes."""
    mm = df.agg(F.max(col).alias("_mx"), F.min(col).alias("_mn"))
    j = df.crossJoin(F.broadcast(mm))
    hi = j.filter(F.col(col) == F.col("_mx")).select(F.lit("max").alias("extreme"), *keep)
    lo = j.filter(F.col(col) == F.col("_mn")).select(F.lit("min").alias("extreme"), *keep)
    return hi.unionByName(lo)


def histogram(df: DataFrame, col: str, n: int) -> DataFrame:
    """K9: equal-width histogram (last bin closed, like numpy); empty bins kept."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    x = F.col(col)
    b = F.least(F.lit(n).cast("long"), F.floor((x - F.col("_mn")) * n / (F.col("_mx") - F.col("_mn"))).cast("long") + 1)
    counts = df.crossJoin(F.broadcast(mm)).groupBy(b.alias("bin")).agg(F.count("*").alias("rows"))
    bins = df.sparkSession.range(1, n + 1).withColumnRenamed("id", "bin").crossJoin(F.broadcast(mm))
    out = bins.join(counts, "bin", "left")
    return out.select(
        F.lit(n).alias("bins"),
        "bin",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.round(F.col("_mn") + (F.col("bin") - 1) * (F.col("_mx") - F.col("_mn")) / n, 4).alias("lower_edge"),
    )


def correlations(df: DataFrame, cols: list[str], hue: str) -> DataFrame:
    """Pearson correlation per column pair, overall ('ALL') and per hue value ('NULL' for missing)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = [F.round(F.corr(a, b), 6).alias(f"{a}__{b}") for a, b in pairs]
    per = df.groupBy(F.coalesce(F.col(hue), F.lit("NULL")).alias("hue")).agg(*aggs)
    tot = df.agg(*aggs).withColumn("hue", F.lit("ALL"))
    wide = per.unionByName(tot)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in pairs)
    return wide.selectExpr("hue", f"stack({len(pairs)}, {stack}) AS (x, y, corr)")


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Mean, quartiles and 1.5 IQR whiskers per group (two passes; quartiles joined back)."""
    q = R.quantiles(df, [group], col, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    qb = q.select(F.col(group).alias("_g"), F.array("q1", "q2", "q3").alias("_q"))
    j = df.join(qb, df[group].eqNullSafe(qb["_g"]))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    x = F.col(col)
    return j.groupBy(group).agg(
        F.round(S.money_avg(col), 2).alias("mean_price"),
        F.round(F.any_value(q1), 4).alias("q1"),
        F.round(F.any_value(F.col("_q")[1]), 4).alias("median"),
        F.round(F.any_value(q3), 4).alias("q3"),
        F.min(F.when(x >= q1 - 1.5 * (q3 - q1), x)).alias("whisker_low"),
        F.max(F.when(x <= q3 + 1.5 * (q3 - q1), x)).alias("whisker_high"),
    )


def seeded_sample(df: DataFrame, n: int, salt: str = "sample") -> DataFrame:
    """Reproducible sample of n rows: the n smallest salted row hashes (top-k, no full sort)."""
    k = F.md5(F.concat(row_key(), F.lit(f"|{salt}")))
    return df.withColumn("_skey", k).orderBy("_skey").limit(n)


def resample_means(sample: DataFrame, col: str, reps: int = 1000, size: int = 30, seed: int = 42) -> DataFrame:
    """Bootstrap means; draw j of replicate r takes sample row md5(r:j:seed) mod |sample|.

    The sample is bounded (n rows by construction), so it is indexed with a window and broadcast.
    """
    idx = sample.withColumn("_idx", F.row_number().over(Window.orderBy("_skey")) - 1)
    n = idx.agg(F.count("*").alias("_n"))
    spark = sample.sparkSession
    draws = spark.range(reps).withColumnRenamed("id", "rep").crossJoin(spark.range(size).withColumnRenamed("id", "j"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("j").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    draws = draws.crossJoin(F.broadcast(n)).withColumn("_idx", F.pmod(h.cast("long"), F.col("_n")))
    j = draws.join(F.broadcast(idx.select("_idx", col)), "_idx")
    return j.groupBy("rep").agg(F.round(S.money_avg(col), 4).alias("mean_price"))


def z_intervals(df: DataFrame, col: str, known_sigma: float) -> DataFrame:
    """95 % interval with known sigma; 90 % interval with the sample standard deviation."""
    z95, z90 = S.z_critical(0.95), S.z_critical(0.90)
    a = df.agg(F.count(col).alias("n"), F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    se_k = F.lit(known_sigma) / F.sqrt("n")
    se_s = F.col("_s") / F.sqrt("n")
    return a.select(
        "n",
        F.round("_m", 4).alias("mean"),
        F.round(F.col("_m") - z95 * se_k, 4).alias("lo_known_sigma"),
        F.round(F.col("_m") + z95 * se_k, 4).alias("hi_known_sigma"),
        F.round(F.col("_m") - z90 * se_s, 4).alias("lo_sample_var"),
        F.round(F.col("_m") + z90 * se_s, 4).alias("hi_sample_var"),
    )


def std_interval(df: DataFrame, col: str, confidence: float = 0.95) -> DataFrame:
    """Chi-square interval for the standard deviation."""
    alpha = 1 - confidence
    a = df.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("_s"), F.var_samp(col).alias("_v"))
    k = (F.col("n") - 1).cast("double")
    hi_q = S.chi2_quantile_wh(1 - alpha / 2, F.col("n") - 1)
    lo_q = S.chi2_quantile_wh(alpha / 2, F.col("n") - 1)
    return a.select(
        "n",
        F.round("_s", 4).alias("std"),
        F.round(F.sqrt(k * F.col("_v") / hi_q), 4).alias("std_lo"),
        F.round(F.sqrt(k * F.col("_v") / lo_q), 4).alias("std_hi"),
    )


def error_by_bucket(scored: DataFrame, xcol: str, buckets, y: str, pred: str) -> DataFrame:
    """Metrics per value bucket [lo, hi); every bucket present even when empty."""
    label = None
    for lo, hi, lab in buckets:
        cond = (F.col(xcol) >= lo) & (F.col(xcol) < hi)
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
    agg = scored.groupBy(label.alias("bucket")).agg(
        F.count(y).alias("records"),
        S.money_avg(y).alias("_am"),
        F.avg(pred).alias("_pm"),
        F.avg(F.abs(F.col(y) - F.col(pred))).alias("_mae"),
    )
    lit_b = scored.sparkSession.createDataFrame([(b[2],) for b in buckets], "bucket string")
    out = lit_b.join(agg, "bucket", "left")
    return out.select(
        "bucket",
        F.coalesce("records", F.lit(0)).alias("records"),
        F.round("_am", 2).alias("actual_mean_price"),
        F.round("_pm", 2).alias("pred_mean_price"),
        F.round("_mae", 2).alias("mae"),
    )


def business_questions(df: DataFrame) -> DataFrame:
    """dearest/cheapest airline by mean price (ties -> name), flights above mean, longest duration."""
    per = df.groupBy("airline").agg(S.money_avg("price").alias("_m"), F.max("duration").alias("_longest"))
    best = per.agg(
        F.min_by("airline", F.struct((-F.col("_m")).alias("a"), F.col("airline").alias("b"))).alias("dearest_airline"),
        F.min_by("airline", F.struct(F.col("_m").alias("a"), F.col("airline").alias("b"))).alias("cheapest_airline"),
        F.max("_longest").alias("longest_duration"),
    )
    m = df.agg(S.money_avg("price").alias("_gm"))
    above = df.crossJoin(F.broadcast(m)).agg(F.count_if(F.col("price") > F.col("_gm")).alias("flights_above_mean"))
    return best.crossJoin(above).select("dearest_airline", "cheapest_airline", "flights_above_mean", "longest_duration")
