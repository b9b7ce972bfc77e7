"""SQL twins for request validation, comparables (brute force) and calibration (1-feature ridge)."""

from __future__ import annotations

from farelake.functions import labels as L
from farelake.operators import comparables as CMP
from farelake.plans.oracle_base import case_map, haversine_sql, initcap, q, rnd, search_scored_sql, strip
from farelake.plans.q_features import ROUTER_SQL


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


KNOWN = "(" + ", ".join(q(c.lower()) for c in L.KNOWN_TRAINING_CITIES) + ")"
_MERGED_STOPS = {**L.STOPS_MAP, **L.REQUEST_STOPS_EXTRA}


def _req_time(c: str) -> str:
    return f"coalesce({case_map(L.TIME_MAP, f'replace(lower({strip(c)}), {q(chr(45))}, {q(chr(32))})')}, {strip(c)})"


REQUESTS_VALID_SQL = f"""req_names AS (
  SELECT DISTINCT qq AS q FROM (
    SELECT source_city AS qq FROM requests WHERE {blank('source_iata')}
    UNION ALL SELECT destination_city FROM requests WHERE {blank('destination_iata')}) WHERE NOT {blank('qq')}),
req_hits AS (
  SELECT q, iata FROM ({search_scored_sql('req_names')})
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY score, city, seq) = 1),
req_resolved AS (
  SELECT p.q, d.iata, d.city, d.latitude, d.longitude FROM req_names p
  LEFT JOIN name_index ni ON lower({strip('p.q')}) = ni.key
  LEFT JOIN req_hits h ON p.q = h.q
  LEFT JOIN airport_dim d ON d.iata = coalesce(ni.iata, h.iata)),
req_ep AS (
  SELECT r.*,
    NOT {blank('r.source_iata')} OR NOT {blank('r.source_city')} AS src_given,
    CASE WHEN NOT {blank('r.source_iata')} THEN sa.iata ELSE sr.iata END AS src_iata,
    CASE WHEN NOT {blank('r.source_iata')} THEN sa.city ELSE sr.city END AS src_resolved_city,
    CASE WHEN NOT {blank('r.source_iata')} THEN sa.latitude ELSE sr.latitude END AS src_lat,
    CASE WHEN NOT {blank('r.source_iata')} THEN sa.longitude ELSE sr.longitude END AS src_lon,
    NOT {blank('r.destination_iata')} OR NOT {blank('r.destination_city')} AS dst_given,
    CASE WHEN NOT {blank('r.destination_iata')} THEN da.iata ELSE dr.iata END AS dst_iata,
    CASE WHEN NOT {blank('r.destination_iata')} THEN da.city ELSE dr.city END AS dst_resolved_city,
    CASE WHEN NOT {blank('r.destination_iata')} THEN da.latitude ELSE dr.latitude END AS dst_lat,
    CASE WHEN NOT {blank('r.destination_iata')} THEN da.longitude ELSE dr.longitude END AS dst_lon
  FROM requests r
  LEFT JOIN airport_dim sa ON upper({strip('r.source_iata')}) = sa.iata
  LEFT JOIN req_resolved sr ON r.source_city = sr.q AND {blank('r.source_iata')}
  LEFT JOIN airport_dim da ON upper({strip('r.destination_iata')}) = da.iata
  LEFT JOIN req_resolved dr ON r.destination_city = dr.q AND {blank('r.destination_iata')}),
cat_airlines AS (SELECT lower(airline) AS k, min(airline) AS cat_airline FROM fares GROUP BY 1),
req_norm AS (
  SELECT e.*,
    coalesce({case_map(L.AIRLINE_MAP, f"lower({strip('e.airline')})")}, {strip('e.airline')}) AS airline_req,
    {_req_time('e.departure_time')} AS departure_time_n,
    {_req_time('e.arrival_time')} AS arrival_time_n,
    coalesce({case_map(_MERGED_STOPS, f"replace(lower({strip('e.stops')}), '_', ' ')")},
             {case_map(L.STOPS_MAP, f"lower({strip('e.stops')})")}, {strip('e.stops')}) AS stops_n,
    {initcap(strip('e.class'))} AS cls,
    {rnd(haversine_sql('e.src_lat', 'e.src_lon', 'e.dst_lat', 'e.dst_lon'), 2)} AS distance_km
  FROM req_ep e),
req_valid AS (
  SELECT n.*, ca.cat_airline AS airline_n,
    CASE WHEN n.cls IN ('Economy', 'Business') THEN n.cls ELSE 'Economy' END AS class_n,
    NOT (lower(n.src_resolved_city) IN {KNOWN} AND lower(n.dst_resolved_city) IN {KNOWN}) AS ood,
    list_filter([
      CASE WHEN {blank('n.airline')} THEN 'blank_airline' END,
      CASE WHEN {blank('n.departure_time')} THEN 'blank_departure_time' END,
      CASE WHEN {blank('n.arrival_time')} THEN 'blank_arrival_time' END,
      CASE WHEN {blank('n.stops')} THEN 'blank_stops' END,
      CASE WHEN {blank('n.class')} THEN 'blank_class' END,
      CASE WHEN NOT coalesce(n.duration > 0 AND n.duration <= 48.0, false) THEN 'duration_out_of_range' END,
      CASE WHEN NOT coalesce(n.days_left >= 0 AND n.days_left <= 365, false) THEN 'days_left_out_of_range' END,
      CASE WHEN NOT n.src_given OR NOT n.dst_given THEN 'location_missing' END,
      CASE WHEN n.src_given AND n.src_iata IS NULL THEN 'source_not_found' END,
      CASE WHEN n.dst_given AND n.dst_iata IS NULL THEN 'destination_not_found' END,
      CASE WHEN coalesce(n.src_iata = n.dst_iata, false) THEN 'same_airport' END,
      CASE WHEN ca.cat_airline IS NULL THEN 'unknown_airline' END,
      CASE WHEN NOT coalesce(n.departure_time_n IN (SELECT DISTINCT departure_time FROM fares), false) THEN 'unknown_departure_time' END,
      CASE WHEN NOT coalesce(n.arrival_time_n IN (SELECT DISTINCT arrival_time FROM fares), false) THEN 'unknown_arrival_time' END,
      CASE WHEN NOT coalesce(n.stops_n IN (SELECT DISTINCT stops FROM fares WHERE stops IS NOT NULL), false) THEN 'unknown_stops' END
    ], lambda x: x IS NOT NULL) AS reasons
  FROM req_norm n LEFT JOIN cat_airlines ca ON ca.k = lower(n.airline_req)),
cq AS (
  SELECT request_id, class_n AS class, airline_n AS airline, stops_n AS stops, CAST(duration AS DOUBLE) AS duration,
    CAST(days_left AS DOUBLE) AS days_left, distance_km, src_resolved_city AS source_city, dst_resolved_city AS destination_city
  FROM req_valid WHERE len(reasons) = 0)"""


def comparables_sql(k: int) -> str:
    """Brute force: every valid request against its whole class pool (DuckDB), top k by score + tie-break."""
    tie = ", ".join(f"h.{c} ASC NULLS FIRST" for c in CMP.TIE_BREAK)
    t = lambda x: initcap(f"trim({x})")
    return f"""hist AS (
  SELECT *, {t('class')} AS h_class, {t('source_city')} AS h_src, {t('destination_city')} AS h_dst,
    lower(airline) AS h_airline, lower(stops) AS h_stops, distance_km AS h_km, coalesce(days_left, {CMP.HIST_DAYS_FILL}) AS h_days
  FROM fares WHERE price IS NOT NULL AND price > 0 AND distance_km IS NOT NULL),
hq AS (
  SELECT request_id AS qid, {t("coalesce(class, 'Economy')")} AS q_class, {t("coalesce(source_city, '')")} AS q_src,
    {t("coalesce(destination_city, '')")} AS q_dst, lower(trim(coalesce(airline, ''))) AS q_airline,
    lower(trim(coalesce(stops, 'zero'))) AS q_stops, coalesce(distance_km, 1000.0) AS q_km,
    coalesce(duration, 2.0) AS q_h, coalesce(days_left, 15.0) AS q_days
  FROM cq),
scored AS (
  SELECT q.qid, q.q_src, q.q_dst, h.*, round(
      ((h.h_km - q.q_km) / {CMP.SCALE_KM}) * ((h.h_km - q.q_km) / {CMP.SCALE_KM})
    + ((h.duration - q.q_h) / {CMP.SCALE_H}) * ((h.duration - q.q_h) / {CMP.SCALE_H})
    + ((h.h_days - q.q_days) / {CMP.SCALE_DAYS}) * ((h.h_days - q.q_days) / {CMP.SCALE_DAYS})
    - CASE WHEN q.q_src <> '' AND q.q_dst <> '' AND h.h_src = q.q_src AND h.h_dst = q.q_dst THEN {CMP.BONUS_EXACT} ELSE 0.0 END
    - CASE WHEN q.q_src <> '' AND q.q_dst <> '' AND h.h_src = q.q_dst AND h.h_dst = q.q_src THEN {CMP.BONUS_REVERSE} ELSE 0.0 END
    - CASE WHEN h.h_airline = q.q_airline THEN {CMP.BONUS_AIRLINE} ELSE 0.0 END
    - CASE WHEN h.h_stops = q.q_stops THEN {CMP.BONUS_STOPS} ELSE 0.0 END, 6) AS score
  FROM (SELECT hq.*, unnest(CASE WHEN q_class IN (SELECT h_class FROM hist) THEN [q_class]
                                 ELSE (SELECT list(DISTINCT h_class) FROM hist) END) AS pool_class FROM hq) q
  JOIN hist h ON h.h_class = q.pool_class),
topk AS (
  SELECT * , row_number() OVER (PARTITION BY qid ORDER BY score, {tie.replace('h.', '')}) AS rank FROM scored
  QUALIFY rank <= {k}),
comps AS (
  SELECT qid, CAST(rank AS BIGINT) AS rank, score, h_src AS source_city, h_dst AS destination_city, airline, stops,
    round(duration, 2) AS duration, CAST(days_left AS BIGINT) AS days_left, round(h_km, 1) AS distance_km, price,
    CASE WHEN q_src <> '' AND q_dst <> '' AND h_src = q_src AND h_dst = q_dst THEN 'exact_route'
         WHEN q_src <> '' AND q_dst <> '' AND h_src = q_dst AND h_dst = q_src THEN 'reverse_route'
         ELSE 'similar_corridor' END AS match_type
  FROM topk),
comp_summary AS (
  SELECT c.qid, coalesce(s.cnt, 0) AS count, s.median, s.mean, s.min, s.max,
    CASE WHEN coalesce(s.all_exact, false) THEN 'exact_directional' ELSE 'corridor_fallback' END AS route_match
  FROM (SELECT request_id AS qid FROM cq) c LEFT JOIN (
    SELECT qid, count(*) AS cnt, round(median(price), 2) AS median, round(avg(price), 2) AS mean, round(min(price), 2) AS min,
      round(max(price), 2) AS max, bool_and(match_type = 'exact_route') AS all_exact FROM comps GROUP BY qid) s ON s.qid = c.qid)"""


def observations_sql() -> str:
    return ROUTER_SQL + """,
obs AS (
  SELECT source_city || ' -> ' || destination_city AS route,
    array_to_string(list_sort([source_city, destination_city]), '_') AS corridor,
    airline, class AS cabin, CAST(days_left AS INTEGER) AS days_left, pred * 1.01388 AS hist_pred, distance_km,
    """ + rnd("price * (1.3 + 0.2 * days_left / 49.0)", 2) + """ AS market_fare
  FROM routed WHERE class IN ('Economy', 'Business') AND days_left IS NOT NULL),
obs_f AS (SELECT *, ln(greatest(500.0, hist_pred)) AS x, ln(market_fare) AS y FROM obs)"""


def loro_1d_sql(group: str, name: str) -> str:
    """Leave-one-group-out ridge (alpha 0.5) on one feature, closed form from group sums."""
    return f"""{name}_g AS (SELECT {group} AS grp, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM obs_f GROUP BY {group}),
{name}_t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM {name}_g),
{name}_f AS (
  SELECT g.grp, t.n - g.n AS nt, (t.sx - g.sx) / (t.n - g.n) AS xb, (t.sy - g.sy) / (t.n - g.n) AS yb,
    (t.sxx - g.sxx) - (t.n - g.n) * ((t.sx - g.sx) / (t.n - g.n)) * ((t.sx - g.sx) / (t.n - g.n)) AS cxx,
    (t.sxy - g.sxy) - (t.n - g.n) * ((t.sx - g.sx) / (t.n - g.n)) * ((t.sy - g.sy) / (t.n - g.n)) AS cxy
  FROM {name}_g g, {name}_t t WHERE t.n - g.n >= 3),
{name}_oof AS (
  SELECT o.*, exp((f.yb - f.xb * (f.cxy / (f.cxx + 0.5))) + (f.cxy / (f.cxx + 0.5)) * o.x) AS oof_pred
  FROM obs_f o JOIN {name}_f f ON o.{group} = f.grp)"""


def metrics_sql(y: str, p: str) -> str:
    return (
        f"round(avg(abs({y} - {p})), 4) AS mae, round(avg(({y} - {p}) * ({y} - {p})), 4) AS mse, "
        f"round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 4) AS rmse, "
        f"round(1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y})), 6) AS r2"
    )
