"""Presentation texts and offer statistics on literal cases."""

from pyspark.sql import functions as F

from farelake.operators import estimate as EST


def shown(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r.s for r in df.select("i", fn(F.col("v")).alias("s")).orderBy("i").collect()]


def test_texts(spark):
    assert shown(spark, [2.0, 2 + 5 / 60, 0.75, 0.0, None, 1.999, float("nan")], EST.format_duration) == ["2h", "2h 5m", "45m", "—", "—", "1h 60m", "—"]
    assert shown(spark, [1148.22, 123456.0, 0.0, None, 999.5], EST.format_km) == ["~1,148 km", "~1,23,456 km", "~0 km", "—", "~1,000 km"]
    assert shown(spark, [1234567.4, 999.0, 1000.0, 0.0, None, -45678.0], EST.format_inr) == ["₹12,34,567", "₹999", "₹1,000", "₹0", "—", "-₹45,678"]
    assert shown(spark, [1234567.891, 5.0, None, -0.5], EST.format_number) == ["12,34,567.89", "5.00", "—", "-0.50"]
    stops = spark.createDataFrame([("zero",), ("one",), ("two_or_more",), ("x",), (None,)], "v string").select(EST.format_stops(F.col("v")).alias("s"))
    assert [r.s for r in stops.collect()] == ["Non-stop", "1 Stop", "2+ Stops", "x", None]


def test_offers_keep_every_query(spark):
    offers = spark.createDataFrame([(1, "10", "B"), (1, "30", "A"), (1, "20", ""), (1, "x", "Z"), (1, "40", "A"), (2, "n/a", "A"), (2, None, "B"), (4, "0", "A"), (4, "-3", "B")], "query_id long, amount string, carrier string")
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    got = {r.query_id: tuple(r)[1:] for r in EST.offer_stats(offers, queries).collect()}
    assert got == {1: ("live_offers_retrieved", 4, 10.0, 30.0, 40.0, "A|B"), 2: ("live_offers_retrieved", 0, None, None, None, ""), 3: ("no_offers_found", 0, None, None, None, ""), 4: ("live_offers_retrieved", 2, -3.0, 0.0, 0.0, "A|B")}
    positive = {r.query_id: tuple(r)[1:] for r in EST.offer_stats(offers, queries, positive_only=True).collect()}
    assert positive[4] == ("live_offers_retrieved", 0, None, None, None, "") and positive[1] == got[1]
