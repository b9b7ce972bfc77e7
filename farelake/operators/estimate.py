"""Fare-estimate tables (J1-J13): validated requests -> price chain -> bands -> nested rows.

The reference answers one HTTP request at a time; here the same logic is a DataFrame
transform over any number of requests (batch or a stream micro-batch). Invalid requests are
never dropped silently: they keep their reason codes (quarantine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelake.operators import ranks as R
from farelake.functions import geo as G
from farelake.functions import labels as L
from farelake.functions.features import PRICE_FLOOR, SMEARING_FACTOR
from farelake.operators import locations as LO
from farelake.operators.models import ROUTED_CLASSES

# --- Fixed values (request validation) ---
MAX_DURATION_H = 48.0
MAX_DAYS_LEFT = 365
# --- end ---


def catalogue(fares: DataFrame) -> DataFrame:
    """C9 as one row of sorted arrays (domains are low-cardinality; bounded by the vocabulary)."""
    return fares.agg(
        F.sort_array(F.collect_set("airline")).alias("cat_airlines"),
        F.sort_array(F.collect_set("departure_time")).alias("cat_departure_times"),
        F.sort_array(F.collect_set("arrival_time")).alias("cat_arrival_times"),
        F.sort_array(F.collect_set("stops")).alias("cat_stops"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("source_city", "destination_city"))))).alias("cat_cities"),
    )


def _blank(c: Column) -> Column:
    return c.isNull() | (L.strip_ws(c) == "")


def _endpoint(req: DataFrame, iata_col: str, city_col: str, prefix: str, dim: DataFrame, index: DataFrame) -> DataFrame:
    """IATA preferred (exact), else resolve the city (cascade); NULL iata when not found."""
    geo = dim.select("iata", "city", "latitude", "longitude")
    by_code = req.join(
        geo.select(F.col("iata").alias("_ci"), F.col("city").alias("_cc"), F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon")),
        F.upper(L.strip_ws(F.col(iata_col))) == F.col("_ci"),
        "left",
    )
    names = req.filter(_blank(F.col(iata_col)) & ~_blank(F.col(city_col))).select(F.col(city_col).alias("q"))
    res = LO.resolve(names, dim, index).select(
        F.col("q").alias("_rq"), F.col("iata").alias("_ri"), F.col("resolved_city").alias("_rc"),
        F.col("latitude").alias("_rlat"), F.col("longitude").alias("_rlon"),
    )
    j = by_code.join(res, (F.col(city_col) == F.col("_rq")) & _blank(F.col(iata_col)), "left")
    use_code = ~_blank(F.col(iata_col))
    return j.withColumns(
        {
            f"{prefix}_given": use_code | ~_blank(F.col(city_col)),
            f"{prefix}_iata": F.when(use_code, F.col("_ci")).otherwise(F.col("_ri")),
            f"{prefix}_resolved_city": F.when(use_code, F.col("_cc")).otherwise(F.col("_rc")),
            f"{prefix}_lat": F.when(use_code, F.col("_clat")).otherwise(F.col("_rlat")),
            f"{prefix}_lon": F.when(use_code, F.col("_clon")).otherwise(F.col("_rlon")),
        }
    ).drop("_ci", "_cc", "_clat", "_clon", "_rq", "_ri", "_rc", "_rlat", "_rlon")


def validate_requests(req: DataFrame, cat: DataFrame, dim: DataFrame, index: DataFrame) -> DataFrame:
    """J1 + J2: normalised request columns, resolved endpoints, distance, reasons, ``valid``.

    Reason order follows the reference's checks: field validation, locations, same airport,
    airline, departure/arrival time, stops. Unknown classes fall back to Economy.
    """
    r = _endpoint(req, "source_iata", "source_city", "src", dim, index)
    r = _endpoint(r, "destination_iata", "destination_city", "dst", dim, index)
    r = r.crossJoin(F.broadcast(cat))  # one row of small arrays
    airline_n = L.request_airline(F.col("airline"))
    canon_airline = F.try_element_at(F.filter("cat_airlines", lambda a: F.lower(a) == F.lower(airline_n)), F.lit(1))
    dep_n, arr_n, stops_n = L.request_time(F.col("departure_time")), L.request_time(F.col("arrival_time")), L.request_stops(F.col("stops"))
    cls = F.initcap(L.strip_ws(F.col("class")))
    dur, days = F.col("duration").cast("double"), F.col("days_left")
    reasons = F.array_compact(
        F.array(
            F.when(_blank(F.col("airline")), F.lit("blank_airline")),
            F.when(_blank(F.col("departure_time")), F.lit("blank_departure_time")),
            F.when(_blank(F.col("arrival_time")), F.lit("blank_arrival_time")),
            F.when(_blank(F.col("stops")), F.lit("blank_stops")),
            F.when(_blank(F.col("class")), F.lit("blank_class")),
            F.when(~F.coalesce((dur > 0) & (dur <= MAX_DURATION_H), F.lit(False)), F.lit("duration_out_of_range")),
            F.when(~F.coalesce((days >= 0) & (days <= MAX_DAYS_LEFT), F.lit(False)), F.lit("days_left_out_of_range")),
            F.when(~F.col("src_given") | ~F.col("dst_given"), F.lit("location_missing")),
            F.when(F.col("src_given") & F.col("src_iata").isNull(), F.lit("source_not_found")),
            F.when(F.col("dst_given") & F.col("dst_iata").isNull(), F.lit("destination_not_found")),
            F.when(F.coalesce(F.col("src_iata") == F.col("dst_iata"), F.lit(False)), F.lit("same_airport")),
            F.when(canon_airline.isNull(), F.lit("unknown_airline")),
            F.when(~F.coalesce(F.array_contains("cat_departure_times", dep_n), F.lit(False)), F.lit("unknown_departure_time")),
            F.when(~F.coalesce(F.array_contains("cat_arrival_times", arr_n), F.lit(False)), F.lit("unknown_arrival_time")),
            F.when(~F.coalesce(F.array_contains("cat_stops", stops_n), F.lit(False)), F.lit("unknown_stops")),
        )
    )
    dist = F.round(G.haversine_km(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")), 2)
    known = [c.lower() for c in L.KNOWN_TRAINING_CITIES]
    ood = ~(F.lower(F.col("src_resolved_city")).isin(*known) & F.lower(F.col("dst_resolved_city")).isin(*known))
    out = r.withColumns(
        {
            "airline_n": canon_airline,
            "departure_time_n": dep_n,
            "arrival_time_n": arr_n,
            "stops_n": stops_n,
            "class_n": F.when(cls.isin(*ROUTED_CLASSES), cls).otherwise(F.lit("Economy")),
            "distance_km": dist,
            "out_of_training_distribution": ood,
            "reasons": reasons,
        }
    )
    out = out.withColumns({"valid": F.size("reasons") == 0, "reliability_tier": G.reliability_tier(F.col("distance_km"), F.col("out_of_training_distribution"))})
    return out.drop("cat_airlines", "cat_departure_times", "cat_arrival_times", "cat_stops", "cat_cities")


def comparable_queries(valid: DataFrame) -> DataFrame:
    """Valid requests in the comparables query shape."""
    return valid.filter("valid").select(
        "request_id",
        F.col("class_n").alias("class"),
        F.col("airline_n").alias("airline"),
        F.col("stops_n").alias("stops"),
        F.col("duration").cast("double").alias("duration"),
        F.col("days_left").cast("double").alias("days_left"),
        "distance_km",
        F.col("src_resolved_city").alias("source_city"),
        F.col("dst_resolved_city").alias("destination_city"),
    )


def price_chain(valid: DataFrame, coefs: DataFrame, calib: DataFrame) -> DataFrame:
    """Router -> x smearing -> round 2, floor 500 -> calibrate -> round 2, floor 500.

    ``coefs``: per-class (model_class, slope, intercept) of the closed-form router;
    ``calib``: 1-row calibrator (``fitted``, coefficient columns b0..b5, ``factor``, ``mae``).
    """
    c = coefs
    v = valid.withColumn("model_class", F.col("class_n")).join(c, "model_class", "left")
    raw = F.greatest(F.expm1(F.col("intercept") + F.col("slope") * F.col("distance_km")), F.lit(PRICE_FLOOR))
    v = v.withColumn("raw_model_price", raw)
    v = v.withColumn("hist_baseline", F.greatest(F.lit(PRICE_FLOOR), F.round(F.col("raw_model_price") * SMEARING_FACTOR, 2)))
    v = v.crossJoin(F.broadcast(calib))  # 1 row
    from farelake.operators.calibrate import apply_calibration

    cal = apply_calibration(F.col("hist_baseline"), F.col("distance_km"), F.col("days_left").cast("double"), F.col("class_n"))
    v = v.withColumn("predicted_price", F.greatest(F.lit(PRICE_FLOOR), F.round(cal, 2)))
    return v.drop("slope", "intercept", "model_class")


def bands(priced: DataFrame, terciles: DataFrame) -> DataFrame:
    """Error band (± calibration MAE, low floored at 500), fare band, adjustment."""
    p = priced.crossJoin(F.broadcast(terciles))  # 1 row
    pred, err = F.col("predicted_price"), F.round(F.col("mae"), 2)
    return p.withColumns(
        {
            "error_band": err,
            "low": F.round(F.greatest(F.lit(PRICE_FLOOR), pred - err), 2),
            "high": F.round(pred + err, 2),
            "fare_band": F.when(pred <= F.col("budget_max"), "Budget").when(pred >= F.col("high_min"), "High").otherwise("Average"),
            "macro_adjustment_inr": F.round(pred - F.col("hist_baseline"), 2),
            "inflation_multiplier": F.round(pred / F.greatest(F.lit(1.0), F.col("hist_baseline")), 3),
        }
    ).drop("budget_max", "high_min")


# Labels and notes of the response.
CALIB_LABELS = {
    "validated_loro": ("2026 Market Calibrated (LORO-validated)", "Calibrated against market evidence with leave-one-route-out cross-validation."),
    "experimental": ("Experimental market calibration", "Experimental calibration — leave-one-route-out validation did not significantly beat uncalibrated baseline."),
}


def response_rows(est: DataFrame, summary: DataFrame) -> DataFrame:
    """J7 + J9: comparable differences and the nested response struct per request."""
    j = est.join(summary.withColumnRenamed("qid", "request_id"), "request_id", "left")
    med = F.col("median")
    label, note = (F.when(F.col("status") == "validated_loro", CALIB_LABELS["validated_loro"][i]).otherwise(CALIB_LABELS["experimental"][i]) for i in (0, 1))
    echo = {"airline": "airline_n", "source_iata": "src_iata", "destination_iata": "dst_iata", "source_city": "src_resolved_city", "destination_city": "dst_resolved_city", "departure_time": "departure_time_n", "arrival_time": "arrival_time_n", "stops": "stops_n", "class": "class_n", "duration": "duration", "days_left": "days_left"}
    return j.select(
        "request_id",
        "session_id",
        F.struct(
            "predicted_price",
            F.lit("INR").alias("currency"),
            F.struct("error_band", "low", "high").alias("expected_price_range"),
            F.struct("raw_model_price", F.col("hist_baseline").alias("smearing_corrected_price")).alias("historical_baseline"),
            F.struct("macro_adjustment_inr", "inflation_multiplier", F.col("status").alias("validation_status"), label.alias("calibration_label"), note.alias("note")).alias(
                "market_calibration"
            ),
            F.struct(*(F.col(c).alias(name) for name, c in echo.items())).alias("request"),
            "distance_km",
            "fare_band",
            "out_of_training_distribution",
            "reliability_tier",
            F.struct(
                F.coalesce("count", F.lit(0)).alias("count"),
                "median", "mean", "min", "max",
                F.round(F.col("predicted_price") - med, 2).alias("difference_from_median"),
                F.round(F.col("hist_baseline") - med, 2).alias("difference_from_historical_median"),
                "route_match",
            ).alias("historical_comparables"),
        ).alias("estimate"),
    )


#: Days before departure that the diagnostic grid asks for.
SCENARIO_DAYS = (2, 7, 15, 30)


def scenario_grid(fares: DataFrame, days: tuple[int, ...] = SCENARIO_DAYS) -> DataFrame:
    """One request per route, routed class and number of days: the route's commonest airline and stops (ties: the first by
    name), its suggested duration, a morning departure and an evening arrival. Rows without airline or stops do not count."""
    public = fares.filter(F.col("class").isin(*ROUTED_CLASSES)).dropna(subset=["source_city", "destination_city", "airline", "stops"])
    flown = public.groupBy("source_city", "destination_city", "class", "airline", "stops").agg(F.count(F.lit(1)).alias("n"), F.max("distance_km").alias("km"))
    commonest = F.min(F.struct((-F.col("n")).alias("n"), "airline", "stops", "km")).alias("_most")
    routes = flown.groupBy("source_city", "destination_city", "class").agg(commonest)
    none = F.lit(None).cast("string")
    asked = routes.select(
        "source_city", "destination_city", "class", F.col("_most.airline").alias("airline"), F.col("_most.stops").alias("stops"),
        none.alias("source_iata"), none.alias("destination_iata"),
        F.lit("Morning").alias("departure_time"), F.lit("Evening").alias("arrival_time"),
        G.suggested_duration(F.col("_most.km"), F.col("_most.stops")).alias("duration"),
        F.explode(F.array(*(F.lit(d) for d in days))).alias("days_left"),
    )
    name = F.concat_ws("|", "source_city", "destination_city", "class", F.col("days_left").cast("string"))
    return asked.withColumns({"request_id": name, "session_id": F.lit(0).cast("long")})


def diagnostics(est: DataFrame, summary: DataFrame) -> DataFrame:
    """Each scenario's estimate beside its comparables, their absolute difference and the reliability tier."""
    j = est.join(summary.withColumnRenamed("qid", "request_id"), "request_id", "left")
    return j.select(
        F.col("src_resolved_city").alias("source_city"), F.col("dst_resolved_city").alias("destination_city"), "distance_km",
        F.col("airline_n").alias("airline"), F.col("class_n").alias("class"), F.col("stops_n").alias("stops"), "duration", "days_left",
        "predicted_price", "median", "mean", "min", "max",
        F.abs(F.round(F.col("predicted_price") - F.col("median"), 2)).alias("difference"), "reliability_tier",
    )


def latest_per_session(events: DataFrame, n: int = 20, session: str = "session_id", ts: str = "ts", tie: str = "request_id") -> DataFrame:
    """Newest n rows per session (row_number over ts desc; planned as WindowGroupLimit)."""
    from pyspark.sql import Window

    w = Window.partitionBy(session).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return events.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def offer_stats(offers: DataFrame, queries: DataFrame, qid: str = "query_id", positive_only: bool = False) -> DataFrame:
    """One row per query: status, offers with a parsable amount, lowest, upper median sorted[n // 2], highest, carriers.

    A query without offers has ``no_offers_found``; one whose offers all fail to parse has a count of 0 and no fares.
    ``positive_only`` also drops amounts of zero and less (the second provider's rule). The median is an
    order statistic, so a query's offers are never gathered in a row.
    """
    amount = F.col("amount").try_cast("double")
    o = offers.withColumn("_amt", F.when(amount > 0, amount) if positive_only else amount)
    g = o.groupBy(qid).agg(
        F.count("_amt").alias("live_offers_count"),
        F.min("_amt").alias("lowest_fare"),
        F.max("_amt").alias("highest_fare"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_amt").isNotNull() & (F.col("carrier") != ""), F.col("carrier")))), "|").alias("carriers"),
    )
    g = R.joined(g, R.upper_medians(o, [qid], "_amt", "median_fare"), [qid])
    out = R.joined(queries.select(qid).distinct(), g, [qid])
    return out.select(
        qid,
        F.when(F.col("live_offers_count").isNull(), "no_offers_found").otherwise("live_offers_retrieved").alias("status"),
        F.coalesce("live_offers_count", F.lit(0)).cast("int").alias("live_offers_count"),
        "lowest_fare", "median_fare", "highest_fare",
        F.coalesce("carriers", F.lit("")).alias("carriers"),
    )


DASH = "—"


def indian_grouping(digits: Column) -> Column:
    """Digits of a whole number with commas after the last three and then every two: 12,34,567."""
    n = F.length(digits)
    head = F.when(n > 3, F.substring(digits, F.lit(1), n - 3)).otherwise(F.lit(""))
    pairs = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(head), r"(\d\d)", "$1,")), r"^,", "")
    return F.when(n > 3, F.concat(pairs, F.lit(","), F.substring(digits, -3, 3))).otherwise(digits)


def _sign(c: Column) -> Column:
    return F.when(c < 0, F.lit("-")).otherwise(F.lit(""))


def _or_dash(c: Column, shown: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c.cast("double")), DASH).otherwise(shown)


def format_inr(c: Column) -> Column:
    """Rupees without decimals."""
    v = F.round(c, 0).cast("long")
    return _or_dash(c, F.concat(_sign(v), F.lit("₹"), indian_grouping(F.abs(v).cast("string"))))


def format_number(c: Column, digits: int = 2) -> Column:
    """A number with a fixed number of decimals."""
    v = F.abs(F.round(c * 10**digits, 0).cast("long"))
    whole = F.floor(v / 10**digits).cast("long")
    part = F.lpad((v % 10**digits).cast("string"), digits, "0")
    return _or_dash(c, F.concat(_sign(F.round(c * 10**digits, 0)), indian_grouping(whole.cast("string")), F.lit("."), part))


def format_km(c: Column) -> Column:
    v = F.floor(c + 0.5).cast("long")
    return _or_dash(c, F.concat(F.lit("~"), _sign(v), indian_grouping(F.abs(v).cast("string")), F.lit(" km")))


def format_duration(c: Column) -> Column:
    """``2h 5m``, ``2h``, ``45m``; no or zero hours are a dash."""
    h = F.floor(c).cast("long")
    m = F.floor((c - h) * 60 + 0.5).cast("long").cast("string")
    text = F.when(h == 0, F.concat(m, F.lit("m"))).when(m == "0", F.concat(h.cast("string"), F.lit("h"))).otherwise(F.concat(h.cast("string"), F.lit("h "), m, F.lit("m")))
    return F.when(c == 0, DASH).otherwise(_or_dash(c, text))


def format_stops(c: Column) -> Column:
    return F.when(c == "zero", "Non-stop").when(c == "one", "1 Stop").when(c == "two_or_more", "2+ Stops").otherwise(c)
