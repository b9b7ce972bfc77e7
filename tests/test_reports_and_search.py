"""Search by grams, mergeable sketches, the calibration report's grid and the diagnostic grid."""

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from farelake.operators import calibrate as CAL
from farelake.operators import comparables as CMP
from farelake.operators import estimate as EST
from farelake.operators import locations as LO
from farelake.operators import profile as P
from farelake.plans import datasets as D
from farelake.plans.q_estimate import fitted_chain, priced
from tests.conftest import SF_SMALL

DIM = "iata string, city string, airport string, state string, country string, latitude double, longitude double, aliases string, seq long"
AIRPORTS = [
    ("DEL", "Delhi", "Indira Gandhi International", "Delhi", "India", 28.5, 77.1, "New Delhi|Dilli", 0),
    ("BOM", "Mumbai", None, "Maharashtra", "India", 19.1, 72.9, "Bombay", 1),
    ("GOI", "Goa", "Dabolim Airport", None, "India", 15.4, 73.8, "", 2),
    ("ZRH", "Zürich", "Flughafen Zürich", "ZH", "Schweiz", 47.5, 8.5, None, 3),
    ("X", "Q", "b", "", "", 0.0, 0.0, " padded alias |aa", 4),
]
QUERIES = ["del", " DELHI ", "d", "ai", "bay", "zür", "ü", "internationa", "aaa", "xyz", "", "  ", None, "new d", "dehli", "goa", "padded alias", "a", "a"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_equals_a_scan_and_joins_on_equality(spark):
    dim = spark.createDataFrame(AIRPORTS, DIM)
    qs = spark.createDataFrame([(q,) for q in QUERIES], "q string")
    found = LO.search(qs, dim, limit=3)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    got = {(r.q, r["rank"], r.score, r.iata) for r in found.collect()}

    want = set()
    for q in {q for q in QUERIES if q and q.strip()}:
        k, hits = q.strip().lower(), []
        for iata, city, airport, state, _, _, _, aliases, seq in AIRPORTS:
            c, i, a = city.lower(), iata.lower(), (airport or "").lower()
            tokens = [t.strip().lower() for t in [city, airport or "", iata, state or "", *(aliases or "").split("|")]]
            score = 0 if k == i else 1 if c.startswith(k) or i.startswith(k) else 2 if k in c or k in i else 3 if k in a or any(k in t for t in tokens) else None
            if score is not None:
                hits.append((score, city, seq, iata))
        want |= {(q, n + 1, h[0], h[3]) for n, h in enumerate(sorted(hits)[:3])}
    assert got == want


def test_search_of_no_airports_and_of_no_queries(spark):
    dim, qs = spark.createDataFrame(AIRPORTS, DIM), spark.createDataFrame([("del",)], "q string")
    assert LO.search(qs, dim.limit(0)).count() == 0
    assert LO.search(qs.limit(0), dim).count() == 0


def test_sketches_merge_to_one_pass_within_the_bound(spark):
    rows = spark.range(60000).select(
        (F.col("id") % 7).alias("day"),
        F.when(F.col("id") % 3 != 0, F.col("id") % 20011).alias("many"),
        F.concat(F.lit("k"), F.col("id") % 9).alias("few"),
        F.lit(None).cast("double").alias("none"),
    )
    kept = P.distinct_sketches(rows, ["day"])
    assert kept.count() == 7 * 3
    got = {r.column: r.value for r in P.merged_distinct(kept).collect()}
    one = {r.column: r.value for r in P.merged_distinct(P.distinct_sketches(rows.withColumn("all", F.lit(0)), ["all"], ["many", "few", "none"])).collect()}
    exact = rows.agg(*(F.count_distinct(c).alias(c) for c in one)).first().asDict()
    for column, n in exact.items():
        assert abs(got[column] - n) <= P.sketch_bound() * n and abs(one[column] - n) <= P.sketch_bound() * n
    # a later day is added without the earlier days' rows, and order does not matter
    days = [kept.filter(F.col("day") == d) for d in (5, 1, 6, 0, 3, 2, 4)]
    assert {r.column: r.value for r in P.merged_distinct(reduce(lambda a, b: a.unionByName(b), days)).collect()} == got
    by_day = {r.day: r.value for r in P.merged_distinct(kept, ["day"]).filter("column = 'few'").collect()}
    assert by_day == {d: 9 for d in range(7)}
    assert P.distinct_sketches(rows.limit(0), ["day"]).count() == 0


def test_probe_grid_asks_the_calibrator(spark):
    obs = spark.createDataFrame([("A_B", "Economy", 4000.0, 900.0), ("A_B", "Economy", 5000.0, 900.0), ("A_C", "Business", 300.0, 100.0)], "corridor string, cabin string, hist_pred double, distance_km double")
    fitted = spark.createDataFrame([(True, 1.0, 0.9, 0.1, -0.2, 0.05, 0.3, 1.5)], "fitted boolean, b0 double, b1 double, b2 double, b3 double, b4 double, b5 double, factor double")
    got = {(r.corridor, r.days_left): r for r in CAL.probe_grid(obs, fitted).collect()}
    assert len(got) == 6
    for (corridor, days), r in got.items():
        hist, km, business = (4500.0, 900.0, 0.0) if corridor == "A_B" else (300.0, 100.0, 1.0)
        line = 1.0 + 0.9 * np.log(max(500.0, hist)) + 0.1 * km / 1000 - 0.2 * days / 15 + 0.05 * np.log1p(days) + 0.3 * business
        assert r.hist == hist and abs(r.calibrated - max(500.0, round(float(np.exp(line)), 2))) < 0.011
    plain = {r.corridor: r.calibrated for r in CAL.probe_grid(obs, fitted.withColumn("fitted", F.lit(False))).collect()}
    assert plain == {"A_B": 6750.0, "A_C": 500.0}


def test_diagnostic_grid_against_brute_force(spark):
    fares = D.fares(spark, SF_SMALL)
    grid = EST.scenario_grid(fares)
    rows = grid.collect()
    flown = fares.filter(F.col("class").isin("Economy", "Business") & F.col("airline").isNotNull() & F.col("stops").isNotNull())
    routes = flown.select("source_city", "destination_city", "class").distinct().count()
    assert len(rows) == 4 * routes == len({r.request_id for r in rows})
    counts = {}
    for r in flown.groupBy("source_city", "destination_city", "class", "airline", "stops").count().collect():
        counts.setdefault((r.source_city, r.destination_city, r["class"]), []).append((-r["count"], r.airline, r.stops))
    for r in rows:
        assert (r.airline, r.stops) == min(counts[r.source_city, r.destination_city, r["class"]])[1:]
    some = grid.filter(F.xxhash64("request_id") % 40 == 0)
    valid = EST.validate_requests(some, EST.catalogue(fares), D.airports(spark, SF_SMALL), D.name_index(spark, SF_SMALL)).filter("valid")
    queries = EST.comparable_queries(valid)
    chain = priced(valid, fitted_chain(spark, SF_SMALL))
    pick = lambda find: sorted(map(tuple, EST.diagnostics(chain, CMP.summarize(find(queries, fares, k=CMP.PREDICTION_K), queries)).collect()))
    got = pick(CMP.nearest_comparables)
    assert got and got == pick(CMP.brute_force_comparables)
    for r in got:
        predicted, median, difference = r[8], r[9], r[13]
        assert difference == (abs(round(predicted - median, 2)) if median is not None else None)
