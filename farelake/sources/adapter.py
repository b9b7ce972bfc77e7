"""Fare-shaped inputs derived from the driver's TPC-H-like tables.

The driver ships only star-schema tables, so the ticket fact table, the airport
dimension, market observations and estimate requests are *derived* from them with
deterministic expressions. Each derivation exists twice: as a Spark DataFrame here
and as a SQL CTE (``*_SQL``) that the DuckDB oracles repeat verbatim.

Dirty-label variants (case, padding, synonyms, IATA codes, prefixes, junk numbers,
duplicate rows) are chosen by ``pmod`` of the line keys so every cleaning rule runs
on real volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelake.sources.tables import table

# --- Test-data design constants (this repository's own choices) ---
# City name per nation key (0..24); the first seven are the model's training cities.
CITIES = [
    "Delhi", "Mumbai", "Bangalore", "Kolkata", "Hyderabad", "Chennai", "Kochi", "Pune", "Ahmedabad",
    "Goa", "Jaipur", "Lucknow", "Patna", "Guwahati", "Srinagar", "Leh", "Amritsar", "Varanasi",
    "Bhubaneswar", "Nagpur", "Indore", "Coimbatore", "Thiruvananthapuram", "Ranchi", "Dehradun",
]
# Raw airline spelling per brand number (mod 25).
RAW_AIRLINES = [
    "Indigo", "indigo", " IndiGo ", "Air India", "air_india", "AIR INDIA EXPRESS", "air_india_express",
    "Vistara", "vistara ", "SpiceJet", "spicejet", "akasa air", "Akasa", "GO_FIRST", "go first", "GoAir",
    "AirAsia", "air asia", "Jet Airways", "jet_airways", "Multiple_Carriers", "multiple carriers",
    "Trujet", "Star_Air", "Alliance Air",
]
TIME_VARIANTS = ["early_morning", "Late-Night", "MORNING", "afternoon ", "Evening", "night", "tbd"]
STOPS_ZERO = ["non-stop", "zero", "0", "Nonstop"]
STOPS_ONE = ["1 stop", "one", "1-stop", "ONE"]
STOPS_TWO = ["2 stops", "two_or_more", "2+", "3 stops", "4"]
CLASS_ECONOMY = ["Economy", "economy", " ECONOMY "]
CLASS_BUSINESS = ["Business", "business ", "BUSINESS"]
CLASS_UNKNOWN = [None, "", "none", "nan"]
ECONOMY_TYPES = ["ECONOMY", "SMALL", "STANDARD"]
BUSINESS_TYPES = ["PROMO", "LARGE"]
CITY_MISSPELL = {"Bangalore": "Banglore", "Delhi": "New Delhi", "Kochi": "Cochin"}
RAW_TICKET_COLUMNS = [
    "Unnamed: 0", "airline", "flight", "source_city", "departure_time", "stops", "arrival_time",
    "destination_city", "class", "duration", "days_left", "price",
]
# --- end ---


def _pick(values: list, idx: Column) -> Column:
    """values[idx] for a 0-based index column (literal array; codegen, no join)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def _sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list, idx: str) -> str:
    return f"({_sql_list(values)})[({idx}) + 1]"


def airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport dimension (A3 shape) from nation ⋈ region: 25 rows at every scale."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    city = _pick(CITIES, k)
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        city.alias("city"),
        F.concat(city, F.lit(" Airport")).alias("airport"),
        F.concat(F.lit("N"), F.lpad(k.cast("string"), 2, "0")).alias("iata"),
        F.col("r_name").alias("state"),
        F.lit("India").alias("country"),
        (F.lit(8.0) + F.pmod(k, F.lit(5)) * 6.5).cast("double").alias("latitude"),
        (F.lit(68.0) + F.floor(k / 5) * 7.0).cast("double").alias("longitude"),
        F.concat_ws("|", F.col("n_name"), F.col("r_name")).alias("aliases"),
        k.cast("long").alias("seq"),
    )


AIRPORTS_SQL = f"""airports AS (
  SELECT {_sql_pick(CITIES, 'n_nationkey')} AS city,
         {_sql_pick(CITIES, 'n_nationkey')} || ' Airport' AS airport,
         'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iata,
         r_name AS state, 'India' AS country,
         CAST(8.0 + (n_nationkey % 5) * 6.5 AS DOUBLE) AS latitude,
         CAST(68.0 + floor(n_nationkey / 5) * 7.0 AS DOUBLE) AS longitude,
         n_name || '|' || r_name AS aliases,
         CAST(n_nationkey AS BIGINT) AS seq
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _city_variant(nationkey: Column, selector: Column) -> Column:
    city = _pick(CITIES, nationkey)
    misspelt = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in CITY_MISSPELL.items() for x in kv]), city), city
    )
    v = F.pmod(selector, F.lit(40))
    return (
        F.when(v == 0, misspelt)
        .when(v == 1, F.concat(F.lit(" "), city, F.lit(" ")))
        .when(v == 2, F.concat(F.lit("N"), F.lpad(nationkey.cast("string"), 2, "0")))
        .when(v == 3, F.lower(city))
        .when(v == 4, F.substring(city, 1, 5))
        .otherwise(city)
    )


def _sql_city_variant(nk: str, sel: str) -> str:
    city = _sql_pick(CITIES, nk)
    mis = "CASE " + " ".join(f"WHEN {city} = '{a}' THEN '{b}'" for a, b in CITY_MISSPELL.items()) + f" ELSE {city} END"
    return f"""CASE ({sel}) % 40 WHEN 0 THEN {mis}
        WHEN 1 THEN ' ' || {city} || ' '
        WHEN 2 THEN 'N' || lpad(CAST({nk} AS VARCHAR), 2, '0')
        WHEN 3 THEN lower({city})
        WHEN 4 THEN substr({city}, 1, 5)
        ELSE {city} END"""


def _clock(hour: Column, minute: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"))


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-shaped raw ticket table (dirty) from lineitem ⋈ orders ⋈ part ⋈ supplier ⋈ customer.

    Only the needed columns are read (pruned at the scan); the joins are plain equi-joins
    so the planner picks broadcast for small dimensions by measured size and
    sort-merge for lineitem ⋈ orders. Customers meet the orders first, so lines do not move for them.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    placed = o.join(c, o.o_custkey == c.c_custkey)
    j = li.join(placed, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    k, lk, pk, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    brand_no = F.substring(F.col("p_brand"), 7, 10).try_cast("int")
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    clock_dep = _clock(F.pmod(k, F.lit(24)), F.pmod(pk, F.lit(60)))
    clock_arr = _clock(F.pmod(k + F.col("l_quantity").cast("int"), F.lit(24)), F.pmod(sk, F.lit(60)))
    ptype = F.col("p_type")
    days = F.abs(F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")))
    cols = {
        "Unnamed: 0": lk,
        "airline": _pick(RAW_AIRLINES, F.pmod(brand_no, F.lit(25))),
        "flight": F.concat(F.lit("FL"), sk.cast("string")),
        "source_city": _city_variant(F.col("s_nationkey"), k + lk),
        "departure_time": F.when(F.pmod(k, F.lit(7)) == 0, _pick(TIME_VARIANTS, F.pmod(pk, F.lit(7)))).otherwise(clock_dep),
        "stops": F.when(F.pmod(k, F.lit(101)) == 0, F.lit(None).cast("string"))
        .when(prio == "1", _pick(STOPS_ZERO, F.pmod(lk, F.lit(4))))
        .when(prio.isin("2", "3"), _pick(STOPS_ONE, F.pmod(lk, F.lit(4))))
        .otherwise(_pick(STOPS_TWO, F.pmod(lk, F.lit(5)))),
        "arrival_time": F.when(F.pmod(pk, F.lit(3)) == 0, F.concat(clock_arr, F.lit(" 22 Mar")))
        .when(F.pmod(sk, F.lit(13)) == 0, F.concat(F.lit("dep "), clock_arr))
        .otherwise(clock_arr),
        "destination_city": _city_variant(F.col("c_nationkey"), pk + lk),
        "class": F.when(ptype.isin(*ECONOMY_TYPES), _pick(CLASS_ECONOMY, F.pmod(lk, F.lit(3))))
        .when(ptype.isin(*BUSINESS_TYPES), _pick(CLASS_BUSINESS, F.pmod(lk, F.lit(3))))
        .otherwise(_pick(CLASS_UNKNOWN, F.pmod(lk, F.lit(4)))),
        "duration": F.when(F.pmod(k, F.lit(53)) == 0, F.lit("n/a"))
        .when(F.pmod(k, F.lit(59)) == 0, F.lit("0"))
        .otherwise(F.col("l_quantity").cast("string")),
        "days_left": F.when(lk == 7, F.lit(None).cast("double")).otherwise(F.pmod(days, F.lit(50)).cast("double")),
        "price": F.when(F.pmod(k, F.lit(61)) == 0, F.lit(-1.0)).otherwise(F.col("l_extendedprice")),
    }
    dup = F.when((F.pmod(k, F.lit(31)) == 0) & (lk == 1), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return j.select(*[v.alias(n) for n, v in cols.items()], F.explode(dup).alias("_copy")).drop("_copy")


RAW_TICKETS_SQL = f"""raw_tickets AS (
  SELECT l_linenumber AS "Unnamed: 0",
    {_sql_pick(RAW_AIRLINES, "TRY_CAST(substr(p_brand, 7) AS INTEGER) % 25")} AS airline,
    'FL' || CAST(l_suppkey AS VARCHAR) AS flight,
    {_sql_city_variant('s_nationkey', 'l_orderkey + l_linenumber')} AS source_city,
    CASE WHEN l_orderkey % 7 = 0 THEN {_sql_pick(TIME_VARIANTS, 'l_partkey % 7')}
         ELSE lpad(CAST(l_orderkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') END
      AS departure_time,
    CASE WHEN l_orderkey % 101 = 0 THEN NULL
         WHEN substr(o_orderpriority, 1, 1) = '1' THEN {_sql_pick(STOPS_ZERO, 'l_linenumber % 4')}
         WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN {_sql_pick(STOPS_ONE, 'l_linenumber % 4')}
         ELSE {_sql_pick(STOPS_TWO, 'l_linenumber % 5')} END AS stops,
    lpad(CAST((l_orderkey + CAST(l_quantity AS INTEGER)) % 24 AS VARCHAR), 2, '0') || ':' ||
      lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') AS _clock_arr,
    {_sql_city_variant('c_nationkey', 'l_partkey + l_linenumber')} AS destination_city,
    CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN {_sql_pick(CLASS_ECONOMY, 'l_linenumber % 3')}
         WHEN p_type IN ('PROMO', 'LARGE') THEN {_sql_pick(CLASS_BUSINESS, 'l_linenumber % 3')}
         ELSE {_sql_pick(CLASS_UNKNOWN, 'l_linenumber % 4')} END AS class,
    CASE WHEN l_orderkey % 53 = 0 THEN 'n/a' WHEN l_orderkey % 59 = 0 THEN '0'
         ELSE CAST(l_quantity AS VARCHAR) END AS duration,
    CASE WHEN l_linenumber = 7 THEN NULL
         ELSE CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 50 AS DOUBLE) END
      AS days_left,
    CASE WHEN l_orderkey % 61 = 0 THEN -1.0 ELSE l_extendedprice END AS price,
    l_partkey, l_suppkey,
    unnest(CASE WHEN l_orderkey % 31 = 0 AND l_linenumber = 1 THEN [1, 2] ELSE [1] END) AS _copy
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
raw_tickets_final AS (
  SELECT "Unnamed: 0", airline, flight, source_city, departure_time, stops,
    CASE WHEN l_partkey % 3 = 0 THEN _clock_arr || ' 22 Mar'
         WHEN l_suppkey % 13 = 0 THEN 'dep ' || _clock_arr ELSE _clock_arr END AS arrival_time,
    destination_city, class, duration, days_left, CAST(price AS DOUBLE) AS price
  FROM raw_tickets)"""


# --- Estimate requests (A5 shape) from events ---
REQUEST_AIRLINES = RAW_AIRLINES + ["Zoom Air", "Sky_Express"]
REQUEST_TIMES = ["Morning", "early_morning", "Evening", "night", "Afternoon", "Late_Night", "dawn"]
REQUEST_STOPS = {"view": "zero", "click": "one", "signup": "two_or_more", "purchase": "1 stop", "error": "several"}
REQUEST_CLASSES = ["Business", "Economy", "First"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fare-estimate requests: one per event; IATA or city per endpoint, some invalid on purpose."""
    return requests_from_events(table(spark, sf_dir, "events"))


def requests_from_events(ev: DataFrame) -> DataFrame:
    """Row-wise derivation (no aggregation), so it also runs on a stream micro-batch."""
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object(F.col("props"), "$.k").try_cast("int")
    src_city = _pick(CITIES, F.pmod(e, F.lit(25)))
    stops = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in REQUEST_STOPS.items() for x in kv]), F.col("event_type")),
        F.col("event_type"),
    )
    return ev.select(
        e.alias("request_id"),
        u.alias("session_id"),
        F.col("ts"),
        _pick(REQUEST_AIRLINES, F.pmod(e, F.lit(27))).alias("airline"),
        F.when((F.pmod(e, F.lit(5)) == 0) | (F.pmod(e, F.lit(97)) == 0), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("N"), F.lpad(F.pmod(e, F.lit(25)).cast("string"), 2, "0")))
        .alias("source_iata"),
        F.when(F.pmod(e, F.lit(97)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(e, F.lit(10)) == 0, F.lower(src_city))
        .when(F.pmod(e, F.lit(5)) == 0, src_city)
        .alias("source_city"),
        F.when(F.pmod(u, F.lit(7)) == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("N"), F.lpad(F.pmod(u, F.lit(25)).cast("string"), 2, "0")))
        .alias("destination_iata"),
        F.when(F.pmod(u, F.lit(7)) == 0, _pick(CITIES, F.pmod(u, F.lit(25)))).alias("destination_city"),
        _pick(REQUEST_TIMES, F.pmod(e, F.lit(7))).alias("departure_time"),
        _pick(REQUEST_TIMES, F.pmod(e + u, F.lit(7))).alias("arrival_time"),
        stops.alias("stops"),
        _pick(REQUEST_CLASSES, F.pmod(k, F.lit(3))).alias("class"),
        (F.col("value") / 8.0).alias("duration"),
        (k * 4 - 10).alias("days_left"),
    )


def _sql_case(mapping: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in mapping.items()) + f" ELSE {key} END"


REQUESTS_SQL = f"""requests AS (
  SELECT event_id AS request_id, user_id AS session_id, ts,
    {_sql_pick(REQUEST_AIRLINES, 'event_id % 27')} AS airline,
    CASE WHEN event_id % 5 = 0 OR event_id % 97 = 0 THEN NULL ELSE 'N' || lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') END AS source_iata,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 10 = 0 THEN lower({_sql_pick(CITIES, 'event_id % 25')})
         WHEN event_id % 5 = 0 THEN {_sql_pick(CITIES, 'event_id % 25')} END AS source_city,
    CASE WHEN user_id % 7 = 0 THEN NULL ELSE 'N' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') END AS destination_iata,
    CASE WHEN user_id % 7 = 0 THEN {_sql_pick(CITIES, 'user_id % 25')} END AS destination_city,
    {_sql_pick(REQUEST_TIMES, 'event_id % 7')} AS departure_time,
    {_sql_pick(REQUEST_TIMES, '(event_id + user_id) % 7')} AS arrival_time,
    {_sql_case(REQUEST_STOPS, 'event_type')} AS stops,
    {_sql_pick(REQUEST_CLASSES, "CAST(json_extract_string(props, '$.k') AS INTEGER) % 3")} AS class,
    value / 8.0 AS duration,
    CAST(json_extract_string(props, '$.k') AS INTEGER) * 4 - 10 AS days_left
  FROM events)"""
