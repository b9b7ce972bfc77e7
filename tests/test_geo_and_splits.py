"""Geo properties and split invariants."""

import math

from pyspark.sql import functions as F

from farelake.functions import geo as G
from farelake.operators import splits as SP
from farelake.plans import datasets as D
from tests.conftest import SF_SMALL


def test_haversine_symmetric_and_zero(spark):
    df = spark.createDataFrame([(28.56, 77.10, 19.09, 72.87)], "a double, b double, c double, d double")
    r = df.select(
        G.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ab"),
        G.haversine_km(F.col("c"), F.col("d"), F.col("a"), F.col("b")).alias("ba"),
        G.haversine_km(F.col("a"), F.col("b"), F.col("a"), F.col("b")).alias("aa"),
    ).first()
    assert abs(r.ab - r.ba) < 1e-9 and r.aa == 0.0 and 1100 < r.ab < 1200


def test_corridor_and_duration(spark):
    df = spark.createDataFrame([("DEL -> BLR",), ("BLR -> DEL",)], "r string")
    assert [x[0] for x in df.select(G.corridor_key(F.col("r"))).collect()] == ["BLR_DEL", "BLR_DEL"]
    rows = [(1148.22, "zero"), (1708.8, "zero"), (1708.8, "one"), (253.0, "zero"), (None, "zero")]
    d = spark.createDataFrame(rows, "km double, s string")
    got = [x[0] for x in d.select(G.suggested_duration(F.col("km"), F.col("s"))).collect()]
    assert got == [2.25, 3.25, 5.75, 0.75, 2.25]


def test_random_holdout_exact_count(spark):
    f = D.fares(spark, SF_SMALL)
    n = f.count()
    s = SP.random_holdout(f)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["test"] == math.ceil(0.2 * n) and counts["test"] + counts["train"] == n


def test_group_holdout_pure(spark):
    f = D.fares(spark, SF_SMALL)
    s = SP.group_holdout(f, SP.group_col_route())
    audit = SP.split_audit(s).collect()
    assert all(r.overlap == 0 for r in audit)
    groups = f.select(SP.group_col_route()).distinct().count()
    held = SP.held_out_groups(f, SP.group_col_route()).count()
    assert held == math.ceil(0.2 * groups)


SCHEMA = "rid int, airline string, flight string, source_city string, departure_time string, stops string, arrival_time string, destination_city string, class string, price double, duration double, days_left double"


def fare_rows(spark, values):
    """(price, duration, days_left) rows of one and the same flight."""
    return spark.createDataFrame([(i, "A", None, "X|Y", "m", "zero", "n", "Z", "E", *v) for i, v in enumerate(values)], SCHEMA)


def test_splits_keep_every_row_once(spark):
    rows = [(100.0, 2.001, 5.0), (100.0, 2.002, 5.0), (100.0, 2.001, 5.0), (None, None, None), (1.5, 0.0, -1.0), (1.5, 0.0, 0.5), (2.0, 1.0, 2_000_000.0)] * 3
    df = fare_rows(spark, rows)
    for out, head, n in ((SP.random_holdout(df), "test", 5), (SP.temporal_holdout(df), "train", 16)):
        got = out.collect()
        assert sorted(r.rid for r in got) == list(range(21))
        assert sum(r.split == head for r in got) == n
    assert SP.random_holdout(df.limit(0)).count() == 0 and SP.temporal_holdout(df.limit(0)).count() == 0


def test_temporal_order_of_negative_fractional_and_null_days(spark):
    days = [-1.0, 0.5, 0.25, 7.0, 1e7, None, -3.5, 2.0, 2.0, 2.0]
    got = {r.rid: r.split for r in SP.temporal_holdout(fare_rows(spark, [(1.0 + i, 1.0, d) for i, d in enumerate(days)]), train_ratio=0.6).collect()}
    train = {days[i] for i, s in got.items() if s == "train"}
    assert train == {1e7, 7.0, 2.0, 0.5} and sum(s == "train" for s in got.values()) == 6
    half = SP.temporal_holdout(fare_rows(spark, [(1.0 + i, 1.0, d) for i, d in enumerate(days)]), train_ratio=0.4).collect()
    assert sorted(r.days_left for r in half if r.split == "train") == [2.0, 2.0, 7.0, 1e7]


def test_temporal_by_date_and_as_is(spark):
    df = fare_rows(spark, [(1.0, 1.0, float(i)) for i in range(10)])
    dated = df.withColumn("flight_date", F.when(F.col("rid") != 9, F.date_add(F.lit("2024-01-01").cast("date"), -F.col("rid"))))
    got = {r.rid: r.split for r in SP.temporal_holdout(dated).collect()}
    assert {k for k, s in got.items() if s == "test"} == {0, 9}
    as_is = SP.temporal_holdout(df, order=F.col("rid").cast("double")).collect()
    assert {r.rid for r in as_is if r.split == "test"} == {8, 9}


def test_split_plans_do_not_shuffle_rows(spark):
    f = D.fares(spark, SF_SMALL)
    plan = SP.random_holdout(f)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert all("_prefix" in line or "_groupingexpression" in line for line in moved), moved


def test_exact_quantiles_equal_percentile(spark):
    from farelake.operators import ranks as R

    rows = [(g, None if i % 11 == 0 else float((i * 7919) % 503) * (1e9 if i == 5 else 1)) for g in ("a", None, "c") for i in range(700)] + [("d", 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.a, r.b, r.c) for r in R.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).collect()}
    want = {r.g: tuple(r.p) for r in df.groupBy("g").agg(F.percentile("v", [0.25, 0.5, 0.99]).alias("p")).filter("p is not null").collect()}
    assert got.keys() == want.keys() and all(abs(x - y) <= 1e-9 * abs(y) for g in got for x, y in zip(got[g], want[g]))
    total = R.cumulative(df, [], "v").agg(F.sum("n").alias("n"), F.max("total").alias("t")).first()
    assert total.n == total.t == df.filter("v is not null").count()
