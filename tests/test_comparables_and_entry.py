"""Pruned top-k similarity join equals brute force; driver entry points run."""

from farelake.operators import comparables as CMP
from farelake.operators import estimate as EST
from farelake.plans import datasets as D
from farelake.plans.q_comparables import valid_requests
from tests.conftest import SF_SMALL


def test_pruned_equals_brute_force(spark):
    q = EST.comparable_queries(valid_requests(spark, SF_SMALL)).cache()
    h = D.fares(spark, SF_SMALL)
    assert q.count() > 0
    cols = ["qid", "rank", "score", "price", "source_city", "destination_city", "airline", "stops", "duration", "days_left", "match_type"]
    fast = sorted(tuple(r) for r in CMP.nearest_comparables(q, h, k=6).select(*cols).collect())
    slow = sorted(tuple(r) for r in CMP.brute_force_comparables(q, h, k=6).select(*cols).collect())
    assert fast == slow


def _rows(df):
    cols = ["qid", "rank", "score", "price", "source_city", "destination_city", "airline", "stops", "duration", "days_left", "match_type"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_far_equal_and_unmatched_queries(spark):
    h = D.fares(spark, SF_SMALL).limit(400).cache()
    some = h.select("source_city", "destination_city").first()
    schema = "request_id long, class string, airline string, stops string, duration double, days_left double, distance_km double, source_city string, destination_city string"
    odd = [
        (1, "Economy", "Indigo", "zero", 48.0, 365.0, 19000.0, "Nowhere", "Elsewhere"),
        (2, "Economy", None, None, None, None, None, None, None),
        (3, "Unknown", "Indigo", "one", 3.0, 10.0, 900.0, some[0], some[1]),
        (4, "Business", "", "zero", 0.0, 0.0, 0.0, "", ""),
        (5, "economy", "indigo", "ZERO", 2.0, 10.0, 900.0, some[1], some[0]),
        (6, "Economy", "Indigo", "zero", 2.0, 10.0, 900.0, some[0], some[0]),
    ]
    same = [(100 + i, "Economy", "Indigo", "zero", 2.5, 12.0, 800.0, some[0], some[1]) for i in range(40)]  # a busy query
    q = spark.createDataFrame(odd + same, schema)
    for few in (h, h.limit(3)):
        few = few.cache()
        assert _rows(CMP.nearest_comparables(q, few, k=6)) == _rows(CMP.brute_force_comparables(q, few, k=6))
    assert CMP.nearest_comparables(q, h.limit(0), k=6).count() == 0
    assert CMP.nearest_comparables(q.limit(0), h, k=6).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0 and "mean_price" in df.columns
    qs, sqls = E.queries(), E.oracle_sql()
    assert len(qs) >= 100 and set(sqls) <= set(qs)
