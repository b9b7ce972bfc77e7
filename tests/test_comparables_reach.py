"""Comparables of queries far outside of history, of round trips, and without tables held in the driver."""

import random

from pyspark.sql import functions as F

from farelake.operators import comparables as CMP
from tests.test_comparables_and_entry import _rows

HISTORY = (
    "price double, source_city string, destination_city string, airline string, stops string, duration double, days_left double, "
    "flight string, departure_time string, arrival_time string, class string, distance_km double"
)
ASKED = "request_id long, class string, airline string, stops string, duration double, days_left double, distance_km double, source_city string, destination_city string"


def _tables(spark):
    dice = random.Random(5)
    places = {"Aa": 0.0, "Bb": 700.0, "Cc": 1500.0}
    ends = [(a, b) for a in places for b in places]
    pick = lambda: (*dice.choice(ends),)
    rows = []
    for i in range(900):
        a, b = pick()
        rows.append((100.0 + i % 37, a, b, dice.choice(["X", "Y"]), dice.choice(["zero", "one"]), float(dice.randint(1, 48)), dice.choice([None, *map(float, range(50))]), f"F{i % 9}", "Morning", "Night", dice.choice(["Economy", "Business"]), abs(places[a] - places[b])))
    asked = [(i, dice.choice(["Economy", "Business", "First"]), "X", "one", dice.choice([2.0, 7.5, 48.0]), float(dice.choice([0, 20, 60, 365])), abs(places[a] - places[b]), a, b) for i, (a, b) in ((i, pick()) for i in range(60))]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, HISTORY)


def test_far_queries_and_round_trips_equal_brute_force(spark):
    q, h = _tables(spark)
    got = CMP.nearest_comparables(q, h, k=6)
    assert _rows(got) == _rows(CMP.brute_force_comparables(q, h, k=6))


def test_a_far_query_touches_few_cells(spark):
    q, h = _tables(spark)
    grid = CMP.Grid(CMP.prepare_history(h, 6))
    far = CMP._placed(CMP.prepare_queries(q.limit(1).withColumn("days_left", F.lit(365.0)), ["Economy", "Business"], "request_id")).limit(1)
    last = max(grid.edges["w"])
    cells = grid.ball(far, F.lit((365.0 / 8 - last) ** 2 + 1.0))
    assert {r.k_w for r in cells.select("k_w").collect()} == {int(last)} and cells.count() <= 9


def test_no_table_of_queries_is_broadcast(spark):
    q, h = _tables(spark)
    plan = CMP.nearest_comparables(q, h, k=6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
