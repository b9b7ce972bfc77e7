"""Location and geography queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.functions import geo as G
from farelake.functions.labels import KNOWN_TRAINING_CITIES, strip_ws
from farelake.operators import locations as LO
from farelake.plans import datasets as D
from farelake.plans.oracle_base import haversine_sql, rnd, search_scored_sql, strip, with_base
from farelake.plans.registry import register

KNOWN_SQL = "(" + ", ".join(f"'{c.lower()}'" for c in KNOWN_TRAINING_CITIES) + ")"


@register("d1_airport_dimension", sql=with_base("SELECT iata, city, airport, state, country, latitude, longitude, aliases, seq FROM airport_dim"))
def d1_airport_dimension(spark, sf):
    """Airport dimension: normalised, coordinates required, first row per IATA."""
    return D.airports(spark, sf)


@register("d2_name_index", sql=with_base("SELECT key, iata FROM name_index"))
def d2_name_index(spark, sf):
    """Lookup key (IATA, city, alias) -> IATA; last row wins for names."""
    return D.name_index(spark, sf)


@register(
    "d3_lookup_iata",
    sql=with_base(
        f"""SELECT code, n_requests, d.iata IS NOT NULL AS found, d.city
FROM (SELECT source_iata AS code, count(*) AS n_requests FROM requests WHERE source_iata IS NOT NULL GROUP BY source_iata) r
LEFT JOIN airport_dim d ON upper({strip('code')}) = d.iata"""
    ),
)
def d3_lookup_iata(spark, sf):
    """Exact IATA lookup of request codes; missing -> found = false."""
    r = D.requests(spark, sf).filter(F.col("source_iata").isNotNull())
    codes = r.groupBy(F.col("source_iata").alias("code")).agg(F.count("*").alias("n_requests"))
    dim = D.airports(spark, sf).select("iata", "city")
    j = codes.join(dim, F.upper(strip_ws(F.col("code"))) == dim["iata"], "left")
    return j.select("code", "n_requests", F.col("iata").isNotNull().alias("found"), "city")


@register(
    "d4_lookup_city",
    sql=with_base(
        f"""SELECT name, n_requests, ni.iata
FROM (SELECT source_city AS name, count(*) AS n_requests FROM requests WHERE source_city IS NOT NULL GROUP BY source_city) r
LEFT JOIN (SELECT key, iata FROM name_index) ni ON lower({strip('name')}) = ni.key"""
    ),
)
def d4_lookup_city(spark, sf):
    """Exact city/alias lookup (case-folded) of request city names."""
    r = D.requests(spark, sf).filter(F.col("source_city").isNotNull())
    names = r.groupBy(F.col("source_city").alias("name")).agg(F.count("*").alias("n_requests"))
    idx = D.name_index(spark, sf)
    j = names.join(idx, F.lower(strip_ws(F.col("name"))) == idx["key"], "left")
    return j.select("name", "n_requests", "iata")


@register("d5_resolve_places", sql=with_base("SELECT q, iata FROM place_resolved"))
def d5_resolve_places(spark, sf):
    """Resolve cascade for every distinct place string of the ticket table."""
    t = D.tickets(spark, sf)
    names = t.select(F.explode(F.array("source_city", "destination_city")).alias("q")).filter(F.col("q").isNotNull())
    return LO.resolve(names, D.airports(spark, sf), D.name_index(spark, sf)).select("q", "iata")


_PREFIX_SQL = """search_q AS (SELECT DISTINCT lower(substr(trim(source_city), 1, 2)) AS q FROM raw_tickets_final
  UNION SELECT DISTINCT source_city FROM raw_tickets_final UNION SELECT DISTINCT destination_city FROM raw_tickets_final)"""


@register(
    "d6_search_top8",
    sql=with_base(
        f"""SELECT q, rank, score, iata, city FROM (
  SELECT q, score, iata, city, row_number() OVER (PARTITION BY q ORDER BY score, city, seq) AS rank
  FROM ({search_scored_sql('search_q')})) WHERE rank <= 8""",
        _PREFIX_SQL,
    ),
)
def d6_search_top8(spark, sf):
    """Ranked place search (score, city, file order), top 8 per query; queries = the places as written, and their 2-letter prefixes."""
    raw = D.raw_tickets(spark, sf)
    texts = F.array(F.lower(F.substring(F.trim("source_city"), 1, 2)), F.col("source_city"), F.col("destination_city"))
    qs = raw.select(F.explode(texts).alias("q"))
    hits = LO.search(qs, D.airports(spark, sf), limit=8)
    return hits.select("q", F.col("rank").cast("long").alias("rank"), "score", "iata", "city")


@register(
    "d7_route_distance_km",
    sql=with_base("SELECT DISTINCT source_city, destination_city, round(distance_km, 2) AS distance_km FROM fares"),
)
def d7_route_distance_km(spark, sf):
    """Great-circle distance per directed route of the fares table (rounded 2)."""
    f = D.fares(spark, sf)
    return f.select("source_city", "destination_city", F.round("distance_km", 2).alias("distance_km")).distinct()


@register(
    "d8_geo_features",
    sql=with_base(
        "SELECT airline, flight, source_city, destination_city, class, price, source_lat, source_lon, "
        "destination_lat, destination_lon, distance_km FROM fares"
    ),
)
def d8_geo_features(spark, sf):
    """Ticket table with source/destination coordinates and distance_km."""
    return D.fares(spark, sf).select(
        "airline", "flight", "source_city", "destination_city", "class", "price",
        "source_lat", "source_lon", "destination_lat", "destination_lon", "distance_km",
    )


@register(
    "d8_unresolved_places",
    sql=with_base(
        """SELECT q, count(*) AS rows FROM (SELECT source_city AS q FROM tickets UNION ALL SELECT destination_city FROM tickets)
WHERE q NOT IN (SELECT q FROM place_resolved WHERE iata IS NOT NULL) GROUP BY q"""
    ),
)
def d8_unresolved_places(spark, sf):
    """Place strings the cascade cannot resolve (strict mode would fail on any)."""
    return LO.unresolved_places(D.tickets(spark, sf), D.airports(spark, sf), D.name_index(spark, sf))


@register(
    "d9_request_route_distance",
    sql=with_base(
        f"""SELECT source_iata, destination_iata, n_requests,
  CASE WHEN a.iata IS NULL OR b.iata IS NULL THEN NULL WHEN a.iata = b.iata THEN NULL
       ELSE {rnd(haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude'), 2)} END AS distance_km,
  CASE WHEN a.iata IS NULL OR b.iata IS NULL THEN 'location_not_found' WHEN a.iata = b.iata THEN 'same_airport' END AS reason
FROM (SELECT source_iata, destination_iata, count(*) AS n_requests FROM requests
      WHERE source_iata IS NOT NULL AND destination_iata IS NOT NULL GROUP BY ALL) r
LEFT JOIN airport_dim a ON upper({strip('r.source_iata')}) = a.iata
LEFT JOIN airport_dim b ON upper({strip('r.destination_iata')}) = b.iata"""
    ),
)
def d9_request_route_distance(spark, sf):
    """Distance for requested IATA pairs; unknown code / same airport rejected with a reason."""
    r = D.requests(spark, sf).filter(F.col("source_iata").isNotNull() & F.col("destination_iata").isNotNull())
    pairs = r.groupBy("source_iata", "destination_iata").agg(F.count("*").alias("n_requests"))
    return LO.route_distances(pairs, D.airports(spark, sf))


@register(
    "d9_distance_matrix",
    sql=with_base(
        f"""SELECT a.iata AS source_iata, b.iata AS destination_iata,
  {rnd(haversine_sql('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude'), 2)} AS distance_km
FROM airport_dim a JOIN airport_dim b ON a.iata <> b.iata"""
    ),
)
def d9_distance_matrix(spark, sf):
    """Distance between every ordered pair of distinct airports."""
    return LO.distance_matrix(D.airports(spark, sf))


@register(
    "d10_ood_flags",
    sql=with_base(
        f"""SELECT source_city, destination_city, count(*) AS rows,
  lower(source_city) IN {KNOWN_SQL} AS source_city_known, lower(destination_city) IN {KNOWN_SQL} AS destination_city_known,
  NOT (lower(source_city) IN {KNOWN_SQL} AND lower(destination_city) IN {KNOWN_SQL}) AS out_of_training_distribution
FROM fares GROUP BY source_city, destination_city"""
    ),
)
def d10_ood_flags(spark, sf):
    """Known-training-city flags and out-of-distribution flag per route."""
    routes = D.fares(spark, sf).groupBy("source_city", "destination_city").agg(F.count("*").alias("rows"))
    return LO.known_city_flags(routes)


@register(
    "d11_reliability_tier",
    sql=with_base(
        f"""SELECT tier, count(*) AS rows FROM (
  SELECT CASE WHEN distance_km < {G.TIER_MIN_KM} OR distance_km > {G.TIER_MAX_KM} THEN '{G.TIER_OOD}'
              WHEN NOT (lower(source_city) IN {KNOWN_SQL} AND lower(destination_city) IN {KNOWN_SQL}) THEN '{G.TIER_LIMITED}'
              ELSE '{G.TIER_GOOD}' END AS tier FROM fares) GROUP BY tier"""
    ),
)
def d11_reliability_tier(spark, sf):
    """Reliability tier counts (distance bounds, then out-of-distribution)."""
    f = LO.known_city_flags(D.fares(spark, sf).select("source_city", "destination_city", "distance_km"))
    tier = G.reliability_tier(F.col("distance_km"), F.col("out_of_training_distribution"))
    return f.groupBy(tier.alias("tier")).agg(F.count("*").alias("rows"))


@register("d12_all_locations", sql=with_base("SELECT iata, city, airport, state, country, latitude, longitude FROM airport_dim"))
def d12_all_locations(spark, sf):
    """All locations of the dimension."""
    return D.airports(spark, sf).select("iata", "city", "airport", "state", "country", "latitude", "longitude")


@register(
    "d13_suggested_duration",
    sql=with_base(
        f"""SELECT route, stops, round(distance_km, 2) AS distance_km,
  CASE WHEN distance_km IS NULL OR distance_km <= 0 THEN {G.DEFAULT_SUGGESTED_H}
       ELSE greatest({G.MIN_SUGGESTED_H}, floor((distance_km / {G.CRUISE_KMH} + {G.OVERHEAD_H}
         + CASE stops WHEN 'one' THEN {G.LAYOVER_H['one']} WHEN 'two_or_more' THEN {G.LAYOVER_H['two_or_more']} ELSE 0.0 END) * 4 + 0.5) / 4) END
    AS suggested_duration
FROM (SELECT DISTINCT route, stops, distance_km FROM fares)"""
    ),
)
def d13_suggested_duration(spark, sf):
    """Quarter-hour block time suggested from distance and stops."""
    f = D.fares(spark, sf).select("route", "stops", "distance_km").distinct()
    return f.select(
        "route", "stops", F.round("distance_km", 2).alias("distance_km"),
        G.suggested_duration(F.col("distance_km"), F.col("stops")).cast("double").alias("suggested_duration"),
    )


@register(
    "d14_corridor_key",
    sql=with_base(
        """SELECT route, array_to_string(list_sort(list_transform(string_split(replace(route, ' ', ''), '->'), lambda p: trim(p))), '_') AS corridor
FROM (SELECT DISTINCT source_city || ' -> ' || destination_city AS route FROM fares)"""
    ),
)
def d14_corridor_key(spark, sf):
    """Undirected corridor key of 'A -> B' routes."""
    routes = D.fares(spark, sf).select(F.concat_ws(" -> ", "source_city", "destination_city").alias("route")).distinct()
    return routes.withColumn("corridor", G.corridor_key(F.col("route")))
