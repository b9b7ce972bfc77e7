"""Nearest-comparables queries (I1-I8) for every valid estimate request."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators import comparables as CMP
from farelake.operators import estimate as EST
from farelake.plans import datasets as D
from farelake.plans.oracle_base import with_base
from farelake.plans.oracle_requests import REQUESTS_VALID_SQL, comparables_sql
from farelake.plans.registry import register
from farelake.session import cut_lineage


def valid_requests(spark, sf):
    f = D.fares(spark, sf)
    return EST.validate_requests(D.requests(spark, sf), EST.catalogue(f), D.airports(spark, sf), D.name_index(spark, sf))


def comparables(spark, sf, k=CMP.PREDICTION_K):
    # The validated query table feeds several join branches: write it once (reliable checkpoint).
    q = cut_lineage(EST.comparable_queries(valid_requests(spark, sf)))
    return q, CMP.nearest_comparables(q, D.fares(spark, sf), k=k)


_CTES = REQUESTS_VALID_SQL + ",\n" + comparables_sql(CMP.PREDICTION_K)


# Brute-force SQL over all (request, history) pairs is too slow on whole tables; these queries are
# checked against ``brute_force_comparables`` on the small fixture in tests/ instead.
I4_BRUTE_FORCE_SQL = with_base(
    "SELECT qid, rank, score, source_city, destination_city, airline, stops, duration, days_left, distance_km, price, match_type FROM comps",
    _CTES,
)


@register("i4_comparables_top6", sql=None)
def i4_comparables_top6(spark, sf):
    """Top-6 historical comparables per valid request (exact top-k similarity join, pruned by grid bounds)."""
    return comparables(spark, sf)[1]


@register("i6_comparables_summary", sql=None)
def i6_comparables_summary(spark, sf):
    """Per request: count, median, mean, min, max of comparable prices and the route-match verdict."""
    q, c = comparables(spark, sf)
    return CMP.summarize(c, q)


@register(
    "i8_rule_based_comparables",
    sql=with_base(
        """SELECT b.source_city, b.destination_city, b.rows, b.mean_km, b.mean_duration, b.mean_price, b.min_price, b.max_price,
  coalesce(w.rows_12_18, 0) AS rows_12_18 FROM (
  SELECT source_city, destination_city, count(*) AS rows, round(avg(distance_km), 2) AS mean_km, round(avg(duration), 4) AS mean_duration,
    round(avg(price), 2) AS mean_price, min(price) AS min_price, max(price) AS max_price
  FROM fares WHERE distance_km <= 550.0 AND airline = 'Indigo' AND class = 'Economy' AND stops = 'zero' GROUP BY 1, 2) b
LEFT JOIN (SELECT source_city, destination_city, count(*) AS rows_12_18 FROM fares
  WHERE distance_km <= 550.0 AND airline = 'Indigo' AND class = 'Economy' AND stops = 'zero' AND days_left BETWEEN 12 AND 18 GROUP BY 1, 2) w
USING (source_city, destination_city)"""
    ),
)
def i8_rule_based_comparables(spark, sf):
    """Rule-based comparables (<= 550 km, Indigo, Economy, non-stop) and the 12..18-day window."""
    return CMP.rule_based(D.fares(spark, sf))
