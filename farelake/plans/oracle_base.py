"""SQL twins of the derived datasets, for the DuckDB oracles.

Written independently of the Spark code path (plain SQL over the driver's views) so
the oracle checks the Spark operators rather than re-running them. Shared inputs are
only the fixed vocabularies.
"""

from __future__ import annotations

from farelake.functions import features as FE
from farelake.functions import geo as G
from farelake.functions import labels as L
from farelake.sources.adapter import AIRPORTS_SQL, RAW_TICKETS_SQL, REQUESTS_SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(x: str, n: int) -> str:
    """Spark ``round`` semantics (HALF_UP on the decimal rendering) in DuckDB."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def cents(x: str) -> str:
    return f"CAST(round(({x}) * 100) AS BIGINT)"


def money_avg(x: str) -> str:
    return f"(avg({cents(x)}) / 100.0)"


def money_sum(x: str) -> str:
    return f"(CAST(sum({cents(x)}) AS BIGINT) / 100.0)"


def money_median(x: str) -> str:
    return f"(quantile_cont({cents(x)}, 0.5) / 100.0)"


def money_pct(x: str, p: float) -> str:
    return f"(quantile_cont({cents(x)}, {p}) / 100.0)"


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"


def case_map(mapping: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + " END"


def airline_sql(c: str) -> str:
    return f"coalesce({case_map(L.AIRLINE_MAP, f'lower({strip(c)})')}, replace({c}, '_', ' '))"


def stops_sql(c: str) -> str:
    return f"coalesce({case_map(L.STOPS_MAP, f'lower({strip(c)})')}, {c})"


def class_sql(c: str) -> str:
    t = initcap(strip(c))
    return f"CASE WHEN {c} IS NULL OR {t} IN ('Nan', 'None', '') THEN 'Unknown' ELSE {t} END"


def city_sql(c: str) -> str:
    return f"coalesce({case_map(L.CITY_SYNONYMS, strip(c))}, {strip(c)})"


def time_sql(c: str) -> str:
    text = strip(c)
    norm = f"translate(lower({text}), '-_', '  ')"
    canon = case_map({v.lower(): v for v in L.TIME_MAP.values()}, norm)
    parts = f"string_split_regex({text}, '\\s+')"
    p0, p1 = f"({parts})[1]", f"({parts})[2]"
    clock = f"CASE WHEN contains({p0}, ':') THEN {p0} WHEN contains({p1}, ':') THEN {p1} END"
    ht = f"split_part({clock}, ':', 1)"
    hour = f"CASE WHEN regexp_full_match({ht}, '[+-]?[0-9]+') THEN TRY_CAST({ht} AS INTEGER) END"
    bins = "CASE " + " ".join(f"WHEN {hour} >= {lo} AND {hour} < {hi} THEN {q(lab)}" for lo, hi, lab in L.HOUR_BINS) + " ELSE 'Night' END"
    fallback = initcap(f"replace({text}, '_', ' ')")
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce({canon}, CASE WHEN {hour} IS NOT NULL THEN {bins} END, {fallback}) END"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    s1 = f"sin(radians({lat2} - {lat1}) / 2)"
    s2 = f"sin(radians({lon2} - {lon1}) / 2)"
    a = f"({s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * {s2} * {s2})"
    return f"(atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))) * 2 * {G.EARTH_RADIUS_KM})"


def num_sql(c: str) -> str:
    return f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)"


TICKETS_SQL = f"""tickets_dedup AS (
  SELECT DISTINCT airline, flight, source_city, departure_time, stops, arrival_time, destination_city,
         class, duration, days_left, price FROM raw_tickets_final),
tickets_norm AS (
  SELECT {airline_sql('airline')} AS airline, flight,
         {city_sql('source_city')} AS source_city,
         {time_sql('departure_time')} AS departure_time,
         {stops_sql('stops')} AS stops,
         {time_sql('arrival_time')} AS arrival_time,
         {city_sql('destination_city')} AS destination_city,
         {class_sql('class')} AS class,
         {num_sql('duration')} AS duration, {num_sql('days_left')} AS days_left, {num_sql('price')} AS price
  FROM tickets_dedup),
tickets AS (
  SELECT *, source_city || '_' || destination_city AS route FROM tickets_norm
  WHERE duration IS NOT NULL AND duration > 0 AND price IS NOT NULL AND price > 0
    AND NOT coalesce(source_city = destination_city, false))"""

DIM_SQL = f"""airport_dim AS (
  SELECT * FROM (
    SELECT upper({strip('iata')}) AS iata, {strip('city')} AS city, airport, state, country,
           TRY_CAST(CAST(latitude AS VARCHAR) AS DOUBLE) AS latitude,
           TRY_CAST(CAST(longitude AS VARCHAR) AS DOUBLE) AS longitude, coalesce(aliases, '') AS aliases, seq
    FROM airports) t
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND iata IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY iata ORDER BY seq) = 1),
name_keys AS (
  SELECT lower(iata) AS key, iata, 0 AS prio, seq FROM airport_dim WHERE length(iata) = 3
  UNION ALL
  SELECT lower({strip('name')}) AS key, r.iata, 1 AS prio, r.seq
  FROM (SELECT upper({strip('iata')}) AS iata, {strip('city')} AS city, coalesce(aliases, '') AS aliases, seq FROM airports) r
  JOIN (SELECT iata FROM airport_dim) k ON r.iata = k.iata,
  unnest(list_concat([r.city], string_split(r.aliases, '|'))) AS u(name)),
name_index AS (
  SELECT key, iata FROM name_keys WHERE key <> ''
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio, seq DESC) = 1)"""


def search_scored_sql(queries_cte: str, qcol: str = "q") -> str:
    """Scored (query, airport) pairs for the oracle of D6 (DuckDB, small inputs)."""
    qk = f"lower({strip(qcol)})"
    tok = "list_concat([a.city, a.airport, a.iata, a.state], string_split(a.aliases, '|'))"
    score = (
        f"CASE WHEN qk = lower(a.iata) THEN 0 "
        f"WHEN starts_with(lower(a.city), qk) OR starts_with(lower(a.iata), qk) THEN 1 "
        f"WHEN contains(lower(a.city), qk) OR contains(lower(a.iata), qk) THEN 2 "
        f"WHEN contains(lower(a.airport), qk) OR len(list_filter({tok}, lambda t: contains(lower({strip('t')}), qk))) > 0 THEN 3 END"
    )
    return f"""SELECT * FROM (
      SELECT n.{qcol} AS q, n.qk, a.*, {score} AS score
      FROM (SELECT DISTINCT {qcol}, {qk} AS qk FROM {queries_cte}) n CROSS JOIN airport_dim a
      WHERE length(n.qk) >= 1) s WHERE score IS NOT NULL"""


GEO_SQL = f"""place_names AS (
  SELECT DISTINCT q FROM (SELECT source_city AS q FROM tickets UNION ALL SELECT destination_city AS q FROM tickets)
  WHERE q IS NOT NULL),
place_hits AS (
  SELECT q, iata FROM ({search_scored_sql('place_names')})
  QUALIFY row_number() OVER (PARTITION BY q ORDER BY score, city, seq) = 1),
place_resolved AS (
  SELECT p.q, d.iata, d.latitude, d.longitude
  FROM place_names p
  LEFT JOIN name_index ni ON lower({strip('p.q')}) = ni.key
  LEFT JOIN place_hits h ON p.q = h.q
  LEFT JOIN airport_dim d ON d.iata = coalesce(ni.iata, h.iata)),
fares_geo AS (
  SELECT t.*, s.latitude AS source_lat, s.longitude AS source_lon,
         d.latitude AS destination_lat, d.longitude AS destination_lon,
         {rnd(haversine_sql('s.latitude', 's.longitude', 'd.latitude', 'd.longitude'), 6)} AS distance_km
  FROM tickets t LEFT JOIN place_resolved s ON t.source_city = s.q LEFT JOIN place_resolved d ON t.destination_city = d.q),
fares AS (
  SELECT *,
    ln(1 + greatest(coalesce(days_left, {FE.DAYS_FILL_FEATURES}), 0.0)) AS log_days_left,
    greatest(coalesce(duration, {FE.DURATION_FILL_H}), {FE.DURATION_FLOOR_H})
      / greatest(coalesce(distance_km, {FE.DISTANCE_FILL_KM}), {FE.DISTANCE_FLOOR_KM}) AS duration_distance_ratio,
    greatest(coalesce(distance_km, {FE.DISTANCE_FILL_KM}), {FE.DISTANCE_FLOOR_KM})
      / greatest(coalesce(duration, {FE.DURATION_FILL_H}), {FE.DURATION_FLOOR_H}) AS speed_kmh,
    source_city || '_' || destination_city AS route_id,
    airline || '_' || source_city || '_' || destination_city AS airline_route_id
  FROM fares_geo)"""

BASE_CTES = ",\n".join([AIRPORTS_SQL, RAW_TICKETS_SQL, TICKETS_SQL, DIM_SQL, GEO_SQL, REQUESTS_SQL])


def with_base(final_sql: str, extra_ctes: str = "") -> str:
    """Full oracle statement: all base CTEs (DuckDB drops unused ones) + extras + final query."""
    extra = (",\n" + extra_ctes) if extra_ctes else ""
    return f"WITH {BASE_CTES}{extra}\n{final_sql}"
