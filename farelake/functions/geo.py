"""Geographic column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---
EARTH_RADIUS_KM = 6371.0088
# Reliability tier bounds (km) and labels.
TIER_MIN_KM = 80.0
TIER_MAX_KM = 3600.0
TIER_OOD = "Out-of-distribution estimate"
TIER_LIMITED = "Limited historical coverage"
TIER_GOOD = "Good historical coverage"
# Suggested-duration rule: cruise km/h, fixed overhead h, layover h per stops, floor, default.
CRUISE_KMH = 600.0
OVERHEAD_H = 0.35
LAYOVER_H = {"one": 2.5, "two_or_more": 5.0}
MIN_SUGGESTED_H = 0.75
DEFAULT_SUGGESTED_H = 2.25
# --- end of fixed values ---


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle km; NULL when any coordinate is NULL/NaN/inf (reference raises)."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    hd_phi = F.radians(lat2 - lat1) / 2
    hd_lam = F.radians(lon2 - lon1) / 2
    s1, s2 = F.sin(hd_phi), F.sin(hd_lam)
    a = s1 * s1 + F.cos(phi1) * F.cos(phi2) * s2 * s2
    c = F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a))) * 2
    ok = _finite(lat1) & _finite(lon1) & _finite(lat2) & _finite(lon2)
    return F.when(ok, c * EARTH_RADIUS_KM)


def corridor_key(route: Column) -> Column:
    """D14: 'DEL -> BLR' and 'BLR -> DEL' both give 'BLR_DEL'."""
    parts = F.split(F.replace(route, F.lit(" "), F.lit("")), "->")
    return F.array_join(F.array_sort(F.transform(parts, lambda p: F.trim(p))), "_")


def reliability_tier(distance_km: Column, ood: Column) -> Column:
    """D11."""
    return (
        F.when((distance_km < TIER_MIN_KM) | (distance_km > TIER_MAX_KM), TIER_OOD)
        .when(ood, TIER_LIMITED)
        .otherwise(TIER_GOOD)
    )


def suggested_duration(distance_km: Column, stops: Column) -> Column:
    """Quarter-hour rounded block time; 2.25 h when distance missing/non-positive.

    JS Math.round rounds half up, i.e. floor(x + 0.5) for the positive values here.
    """
    layover = F.coalesce(
        F.when(stops == "one", LAYOVER_H["one"]).when(stops == "two_or_more", LAYOVER_H["two_or_more"]),
        F.lit(0.0),
    )
    hours = distance_km / CRUISE_KMH + OVERHEAD_H + layover
    rounded = F.floor(hours * 4 + 0.5) / 4
    return F.when(distance_km.isNull() | (distance_km <= 0), DEFAULT_SUGGESTED_H).otherwise(
        F.greatest(F.lit(MIN_SUGGESTED_H), rounded)
    )
