"""Fare-estimate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.operators import calibrate as CAL
from farelake.operators import comparables as CMP
from farelake.operators import estimate as EST
from farelake.operators import models as M
from farelake.operators import profile as P
from farelake.plans import datasets as D
from farelake.plans.oracle_base import money_pct, rnd, with_base
from farelake.plans.oracle_requests import REQUESTS_VALID_SQL, comparables_sql, loro_1d_sql, observations_sql
from farelake.plans.q_comparables import comparables, valid_requests
from farelake.sources.tables import table
from farelake.plans.registry import register
from farelake.session import written_table
from farelake.sources import adapter


@register(
    "j1_request_validation",
    sql=with_base("SELECT request_id, len(reasons) = 0 AS valid, array_to_string(reasons, '|') AS reasons FROM req_valid", REQUESTS_VALID_SQL),
)
def j1_request_validation(spark, sf):
    """Field, location and domain validation of every request; reasons kept (quarantine, not dropped)."""
    v = valid_requests(spark, sf)
    return v.select("request_id", "valid", F.array_join("reasons", "|").alias("reasons"))


@register(
    "j2_normalised_requests",
    sql=with_base(
        """SELECT request_id, airline_n, class_n, departure_time_n, arrival_time_n, stops_n, src_iata, dst_iata, distance_km,
  ood AS out_of_training_distribution,
  CASE WHEN distance_km < 80.0 OR distance_km > 3600.0 THEN 'Out-of-distribution estimate'
       WHEN ood THEN 'Limited historical coverage' ELSE 'Good historical coverage' END AS reliability_tier
FROM req_valid WHERE len(reasons) = 0""",
        REQUESTS_VALID_SQL,
    ),
)
def j2_normalised_requests(spark, sf):
    """Canonical airline/class/time/stops, IATA endpoints, distance, OOD flag and reliability tier of valid requests."""
    v = valid_requests(spark, sf).filter("valid")
    return v.select(
        "request_id", "airline_n", "class_n", "departure_time_n", "arrival_time_n", "stops_n", "src_iata", "dst_iata",
        "distance_km", "out_of_training_distribution", "reliability_tier",
    )


def fitted_chain(spark, sf, feats=CAL.LOG_HIST_FEATURES, robust=False):
    """What the chain needs of the history, each written once: class coefficients, the calibrator, terciles."""
    f = D.fares(spark, sf)
    coefs = written_table(M.fit_class_loglinear(f), "coefficients")
    cal = CAL.calibrator(CAL.observation_records(f, coefs), feats, robust=robust)
    return coefs, cal, written_table(P.price_terciles(f), "terciles")


def priced(valid, fitted):
    coefs, cal, terciles = fitted
    return EST.bands(EST.price_chain(valid, coefs, cal), terciles)


def _estimates(spark, sf, feats=CAL.LOG_HIST_FEATURES, robust=False):
    return priced(valid_requests(spark, sf).filter("valid"), fitted_chain(spark, sf, feats, robust))


def _responses(valid, fitted, fares):
    """The whole chain for some validated requests: prices, bands, comparables, the nested response."""
    valid = written_table(valid.filter("valid"), "valid")
    queries = EST.comparable_queries(valid)
    found = CMP.nearest_comparables(queries, fares, k=CMP.PREDICTION_K)
    return EST.response_rows(priced(valid, fitted), CMP.summarize(found, queries))


CALIBRATOR_SQL = observations_sql() + ",\n" + loro_1d_sql("route", "lr") + """,
none_m AS (SELECT avg(abs(market_fare - hist_pred)) AS mae_none FROM obs),
fac AS (SELECT median(market_fare / hist_pred) AS factor FROM obs),
infl_m AS (SELECT avg(abs(market_fare - hist_pred * factor)) AS mae_inflation FROM obs, fac),
ridge_m AS (SELECT avg(abs(market_fare - oof_pred)) AS mae_ridge FROM lr_oof),
sel AS (
  SELECT mae_none, mae_inflation, mae_ridge, factor,
    CASE WHEN mae_ridge < mae_none THEN 'ridge' WHEN mae_inflation < mae_none THEN 'global_inflation' ELSE 'none' END AS best_model
  FROM none_m, infl_m, ridge_m, fac),
calib AS (
  SELECT sel.*, CASE best_model WHEN 'ridge' THEN mae_ridge WHEN 'global_inflation' THEN mae_inflation ELSE mae_none END AS mae,
    CASE WHEN best_model = 'ridge' AND mae_ridge < 0.85 * mae_none THEN 'validated_loro' ELSE 'experimental' END AS status,
    (t.sy / t.n) - (t.sx / t.n) * ((t.sxy - t.n * (t.sx / t.n) * (t.sy / t.n)) / ((t.sxx - t.n * (t.sx / t.n) * (t.sx / t.n)) + 0.5)) AS b0,
    (t.sxy - t.n * (t.sx / t.n) * (t.sy / t.n)) / ((t.sxx - t.n * (t.sx / t.n) * (t.sx / t.n)) + 0.5) AS b1
  FROM sel, lr_t t)"""

_EST_SQL = REQUESTS_VALID_SQL + ",\n" + CALIBRATOR_SQL + f""",
priced AS (
  SELECT v.request_id, v.class_n, v.distance_km, v.days_left,
    greatest(exp(c.intercept + c.slope * v.distance_km) - 1, 500.0) AS raw_model_price
  FROM req_valid v JOIN coefs c ON c.model_class = v.class_n WHERE len(v.reasons) = 0),
priced2 AS (SELECT *, greatest(500.0, {rnd('raw_model_price * 1.01388', 2)}) AS hist_baseline FROM priced),
priced3 AS (
  SELECT p.*, k.mae, k.status, CASE WHEN k.best_model = 'ridge'
      THEN greatest(500.0, {rnd('exp(k.b0 + k.b1 * ln(greatest(500.0, p.hist_baseline)))', 2)})
      ELSE greatest(500.0, {rnd('p.hist_baseline * k.factor', 2)}) END AS cal
  FROM priced2 p, calib k),
priced4 AS (SELECT *, greatest(500.0, {rnd('cal', 2)}) AS predicted_price FROM priced3),
terc AS (SELECT {rnd(money_pct('price', 0.33), 4)} AS budget_max, {rnd(money_pct('price', 0.66), 4)} AS high_min FROM fares),
banded AS (
  SELECT p.*, {rnd('p.mae', 2)} AS error_band,
    {rnd(f"greatest(500.0, p.predicted_price - {rnd('p.mae', 2)})", 2)} AS low,
    {rnd(f"p.predicted_price + {rnd('p.mae', 2)}", 2)} AS high,
    CASE WHEN p.predicted_price <= t.budget_max THEN 'Budget' WHEN p.predicted_price >= t.high_min THEN 'High' ELSE 'Average' END AS fare_band,
    {rnd('p.predicted_price - p.hist_baseline', 2)} AS macro_adjustment_inr,
    {rnd('p.predicted_price / greatest(1.0, p.hist_baseline)', 3)} AS inflation_multiplier
  FROM priced4 p, terc t)"""


@register(
    "j3_price_chain",
    sql=with_base("SELECT request_id, round(raw_model_price, 2) AS raw_model_price, hist_baseline, predicted_price FROM priced4", _EST_SQL),
)
def j3_price_chain(spark, sf):
    """Router -> smearing -> floor -> market calibration (LORO-selected, one-feature ridge) -> floor."""
    e = _estimates(spark, sf)
    return e.select("request_id", F.round("raw_model_price", 2).alias("raw_model_price"), "hist_baseline", "predicted_price")


@register(
    "j4_j6_bands",
    sql=with_base("SELECT request_id, error_band, low, high, fare_band, macro_adjustment_inr, inflation_multiplier FROM banded", _EST_SQL),
)
def j4_j6_bands(spark, sf):
    """Error band (± LORO MAE, low >= 500), fare band from terciles, adjustment amount and multiplier."""
    e = _estimates(spark, sf)
    return e.select("request_id", "error_band", "low", "high", "fare_band", "macro_adjustment_inr", "inflation_multiplier")


@register("j7_difference_from_comparables", sql=None)
def j7_difference_from_comparables(spark, sf):
    """Estimate minus the median of its 6 nearest comparables (calibrated and historical)."""
    e = _estimates(spark, sf)
    q, c = comparables(spark, sf)
    s = CMP.summarize(c, q).withColumnRenamed("qid", "request_id")
    j = e.join(s, "request_id")
    return j.select(
        "request_id", "median",
        F.round(F.col("predicted_price") - F.col("median"), 2).alias("difference_from_median"),
        F.round(F.col("hist_baseline") - F.col("median"), 2).alias("difference_from_historical_median"),
        "route_match",
    )


@register("j8_estimate_table", sql=None)
def j8_estimate_table(spark, sf):
    """Batch estimate table: nested response row per valid request (J3-J9); same transform runs per stream micro-batch."""
    return _responses(valid_requests(spark, sf), fitted_chain(spark, sf), D.fares(spark, sf))


@register("j3_price_chain_full_calibrator", sql=None)
def j3_price_chain_full_calibrator(spark, sf):
    """Price chain with the five-feature calibrator (ridge solved per fold from sufficient statistics)."""
    e = _estimates(spark, sf, CAL.FULL_FEATURES)
    return e.select("request_id", "hist_baseline", "predicted_price", "low", "high", "fare_band")


@register(
    "j10_latest_per_session",
    sql=with_base(
        """SELECT session_id, request_id, CAST(position AS INTEGER) AS position FROM (
  SELECT session_id, request_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS position FROM requests)
WHERE position <= 20"""
    ),
)
def j10_latest_per_session(spark, sf):
    """Newest 20 requests per session (row_number over ts desc; partial WindowGroupLimit before the shuffle)."""
    r = EST.latest_per_session(D.requests(spark, sf), 20)
    return r.select("session_id", "request_id", "position")


OFFERS_SQL = """offers AS (
  SELECT l_orderkey AS query_id,
    CASE WHEN l_linenumber = 5 THEN 'n/a' WHEN l_partkey % 17 = 3 THEN '0' WHEN l_partkey % 17 = 4 THEN '-5' ELSE CAST(l_extendedprice AS VARCHAR) END AS amount,
    CASE WHEN l_linenumber = 3 THEN '' ELSE 'C' || CAST(l_suppkey % 30 AS VARCHAR) END AS carrier FROM lineitem)"""


def _offer_stats_sql(keep: str) -> str:
    return f"""SELECT o.o_orderkey AS query_id, CASE WHEN g.query_id IS NULL THEN 'no_offers_found' ELSE 'live_offers_retrieved' END AS status,
  CAST(coalesce(n, 0) AS INTEGER) AS live_offers_count, lowest_fare, p[CAST(floor(n / 2) AS BIGINT) + 1] AS median_fare, highest_fare,
  coalesce(carriers, '') AS carriers
FROM (SELECT DISTINCT o_orderkey FROM orders) o LEFT JOIN (
  SELECT query_id, count(a) AS n, min(a) AS lowest_fare, max(a) AS highest_fare, list_sort(list(a) FILTER (WHERE a IS NOT NULL)) AS p,
    array_to_string(list_sort(list(DISTINCT carrier) FILTER (WHERE a IS NOT NULL AND carrier <> '')), '|') AS carriers
  FROM (SELECT query_id, carrier, CASE WHEN {keep} THEN TRY_CAST(amount AS DOUBLE) END AS a FROM offers) GROUP BY query_id) g
ON g.query_id = o.o_orderkey"""


def _offers(spark, sf):
    """Offers as texts, some of them unparsable, zero or negative; queries are the orders."""
    li = table(spark, sf, "lineitem")
    amount = F.when(F.col("l_linenumber") == 5, "n/a").when(F.pmod("l_partkey", F.lit(17)) == 3, "0").when(F.pmod("l_partkey", F.lit(17)) == 4, "-5")
    offers = li.select(
        F.col("l_orderkey").alias("query_id"),
        amount.otherwise(F.col("l_extendedprice").cast("string")).alias("amount"),
        F.when(F.col("l_linenumber") == 3, F.lit("")).otherwise(F.concat(F.lit("C"), F.pmod("l_suppkey", F.lit(30)).cast("string"))).alias("carrier"),
    )
    return offers, table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"))


@register("j12_offer_statistics", sql=with_base(_offer_stats_sql("true"), OFFERS_SQL))
def j12_offer_statistics(spark, sf):
    """Offer statistics of every query: status, count, lowest, upper median, highest, carriers (unparsable skipped)."""
    return EST.offer_stats(*_offers(spark, sf))


@register("j12_offer_statistics_positive", sql=with_base(_offer_stats_sql("TRY_CAST(amount AS DOUBLE) > 0"), OFFERS_SQL))
def j12_offer_statistics_positive(spark, sf):
    """The same by the second provider's rule: only amounts above zero count."""
    return EST.offer_stats(*_offers(spark, sf), positive_only=True)


def _grouped_sql(v: str) -> str:
    """Digits ``v`` grouped 12,34,567."""
    return (
        f"CASE WHEN length({v}) > 3 THEN regexp_replace(reverse(regexp_replace(reverse(substr({v}, 1, length({v}) - 3)), '(\\d\\d)', '\\1,', 'g')), '^,', '')"
        f" || ',' || substr({v}, length({v}) - 2, 3) ELSE {v} END"
    )


def _inr_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE (CASE WHEN round({x}, 0) < 0 THEN '-' ELSE '' END) || '₹' || {_grouped_sql(f'CAST(abs(CAST(round({x}, 0) AS BIGINT)) AS VARCHAR)')} END"


def _km_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' ELSE '~' || {_grouped_sql(f'CAST(CAST(floor({x} + 0.5) AS BIGINT) AS VARCHAR)')} || ' km' END"


def _hours_sql(x: str) -> str:
    m = f"CAST(CAST(floor(({x} - floor({x})) * 60 + 0.5) AS BIGINT) AS VARCHAR)"
    h = f"CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR)"
    return f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '—' WHEN floor({x}) = 0 THEN {m} || 'm' WHEN {m} = '0' THEN {h} || 'h' ELSE {h} || 'h ' || {m} || 'm' END"


# Every 13th row has no distance and every 11th no hours, so that the dashes are reached.
_SHOWN_SQL = "(SELECT *, CASE WHEN CAST(round(price) AS BIGINT) % 13 = 0 THEN NULL ELSE distance_km END AS km, CASE WHEN CAST(round(price) AS BIGINT) % 11 = 0 THEN 0.0 ELSE duration END AS hours FROM fares)"


@register(
    "j13_presentation",
    sql=with_base(
        f"""SELECT airline, flight, price, {_inr_sql('price')} AS price_inr, {_inr_sql('price * 137.5')} AS total_inr, {_km_sql('km')} AS distance_text,
  {_hours_sql('hours')} AS duration_text, CASE stops WHEN 'zero' THEN 'Non-stop' WHEN 'one' THEN '1 Stop' WHEN 'two_or_more' THEN '2+ Stops' ELSE stops END AS stops_text
FROM {_SHOWN_SQL}"""
    ),
)
def j13_presentation(spark, sf):
    """Presentation columns: INR and km with Indian digit grouping, '2h 5m' / '2h' / '45m', stops label; nothing to show is a dash."""
    f = D.fares(spark, sf).select("airline", "flight", "price", "distance_km", "duration", "stops")
    whole = F.round("price").cast("long")
    km, hours = F.when(whole % 13 != 0, F.col("distance_km")), F.when(whole % 11 == 0, 0.0).otherwise(F.col("duration"))
    return f.select(
        "airline", "flight", "price",
        EST.format_inr(F.col("price")).alias("price_inr"),
        EST.format_inr(F.col("price") * 137.5).alias("total_inr"),
        EST.format_km(km).alias("distance_text"),
        EST.format_duration(hours).alias("duration_text"),
        EST.format_stops(F.col("stops")).alias("stops_text"),
    )


@register(
    "j8_stream_request_validation",
    sql=with_base("SELECT request_id, len(reasons) = 0 AS valid, array_to_string(reasons, '|') AS reasons FROM req_valid", REQUESTS_VALID_SQL),
)
def j8_stream_request_validation(spark, sf):
    """Streaming mode: events as a file stream (availableNow), validated per micro-batch; equals the batch result."""
    from farelake.streaming.estimates import run_file_stream

    f = D.fares(spark, sf)
    cat = EST.catalogue(f)
    dim, idx = D.airports(spark, sf), D.name_index(spark, sf)
    schema = table(spark, sf, "events").schema

    def transform(batch):
        v = EST.validate_requests(adapter.requests_from_events(batch), cat, dim, idx)
        return v.select("request_id", "valid", F.array_join("reasons", "|").alias("reasons"))

    out = run_file_stream(spark, sf, "events.parquet", schema, transform, "request-validation")
    return spark.read.parquet(out).select("request_id", "valid", "reasons")


@register("j3_price_chain_robust", sql=None)
def j3_price_chain_robust(spark, sf):
    """Price chain with the five-feature calibrator chosen among ridge and huber."""
    e = _estimates(spark, sf, CAL.FULL_FEATURES, robust=True)
    return e.select("request_id", "hist_baseline", "predicted_price", "low", "high", "fare_band")


def stream_estimates(spark, sf, source_dir, glob, base=None):
    """J8 as a stream: files of events become requests, validated, priced and compared a micro-batch at a time; the output path."""
    from farelake.streaming.estimates import run_file_stream

    f = D.fares(spark, sf)
    fitted, cat = fitted_chain(spark, sf), written_table(EST.catalogue(f), "catalogue")
    dim, idx = written_table(D.airports(spark, sf), "airports"), written_table(D.name_index(spark, sf), "names")
    transform = lambda batch: _responses(EST.validate_requests(adapter.requests_from_events(batch), cat, dim, idx), fitted, f)
    return run_file_stream(spark, source_dir, glob, table(spark, sf, "events").schema, transform, "estimates", base=base)


@register("j8_stream_estimate_table", sql=None)
def j8_stream_estimate_table(spark, sf):
    """The whole estimate chain as a stream over the events files (availableNow); equals the batch estimate table."""
    return spark.read.parquet(stream_estimates(spark, sf, sf, "events.parquet")).drop("epoch")


def stream_sessions(spark, sf, source_dir, glob, base=None):
    """J10 as a stream with keyed state; the output path."""
    from farelake.streaming.estimates import newest_of_stream, run_file_stream

    prepare = lambda events: newest_of_stream(adapter.requests_from_events(events))
    return run_file_stream(spark, source_dir, glob, table(spark, sf, "events").schema, lambda batch: batch, "sessions", base=base, prepare=prepare)


@register(
    "j10_stream_latest_per_session",
    sql=with_base(
        """SELECT session_id, request_id, CAST(position AS INTEGER) AS position FROM (
  SELECT session_id, request_id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) AS position FROM requests)
WHERE position <= 20"""
    ),
)
def j10_stream_latest_per_session(spark, sf):
    """Newest 20 requests per session kept in keyed state of a stream over the events files."""
    from farelake.streaming.estimates import last_lists

    return last_lists(spark, stream_sessions(spark, sf, sf, "events.parquet")).select("session_id", "request_id", "position")
