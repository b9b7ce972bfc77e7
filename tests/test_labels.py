"""Literal edge rows for the normalisers (expected values from the reference's rules)."""

from pyspark.sql import functions as F

from farelake.functions import labels as L
from farelake.operators.clean import duration_text_to_hours


def _map(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_airline(spark):
    got = _map(spark, L.normalize_airline, ["air_india", "AKASA AIR", "Jet Airways Business", "foo_bar"])
    assert got == ["Air India", "SpiceJet", "Jet Airways Business", "foo bar"]


def test_time_bins(spark):
    got = _map(spark, L.normalize_time_bin, ["early_morning", "Late-Night", "22:20", "01:10 22 Mar", "04:00", "x 13:05", "tbd"])
    assert got == ["Early Morning", "Late Night", "Night", "Late Night", "Early Morning", "Afternoon", "Tbd"]


def test_stops_and_class(spark):
    assert _map(spark, L.normalize_stops, ["non-stop", "1 stop", "4 stops", None]) == ["zero", "one", "two_or_more", None]
    assert _map(spark, L.normalize_class, [None, "", "none", " BUSINESS "]) == ["Unknown", "Unknown", "Unknown", "Business"]


def test_city_repair(spark):
    assert _map(spark, L.repair_city, ["Banglore", " New Delhi", "Cochin"]) == ["Bangalore", "Delhi", "Kochi"]


def test_duration_text(spark):
    got = _map(spark, duration_text_to_hours, ["2h 50m", "19h", "5m"])
    assert abs(got[0] - 2.833333) < 1e-5 and got[1] == 19.0 and abs(got[2] - 0.083333) < 1e-5
