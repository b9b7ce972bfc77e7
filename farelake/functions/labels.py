"""Label normalisers as built-in column expressions (no UDFs).

Every normaliser is a literal map lookup or a ``when`` chain, so it stays inside
whole-stage codegen. The dictionaries below are the only data they carry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: must equal the reference's vocabularies for identical results. ---
# Airline spellings (trimmed, case-folded key) -> canonical airline.
AIRLINE_MAP = {
    "air_india": "Air India",
    "air india": "Air India",
    "air india express": "Air India",
    "air_india_express": "Air India",
    "akasa air": "SpiceJet",
    "akasa": "SpiceJet",
    "go_first": "GO FIRST",
    "go first": "GO FIRST",
    "goair": "GO FIRST",
    "indigo": "Indigo",
    "airasia": "AirAsia",
    "air asia": "AirAsia",
    "spicejet": "SpiceJet",
    "vistara": "Vistara",
    "jet_airways": "Jet Airways",
    "jet airways": "Jet Airways",
    "multiple_carriers": "Multiple carriers",
    "multiple carriers": "Multiple carriers",
    "trujet": "Trujet",
}
# Time-of-day labels: key -> canonical label.
TIME_MAP = {
    "early_morning": "Early Morning",
    "late_night": "Late Night",
    "morning": "Morning",
    "afternoon": "Afternoon",
    "evening": "Evening",
    "night": "Night",
}
# Clock hour bins: [start hour, end hour) -> label; every other hour is Night.
HOUR_BINS = [(0, 4, "Late Night"), (4, 8, "Early Morning"), (8, 12, "Morning"), (12, 16, "Afternoon"), (16, 20, "Evening")]
# Stops spellings (trimmed, case-folded key) -> canonical stops.
STOPS_MAP = {
    "zero": "zero",
    "0": "zero",
    "non-stop": "zero",
    "nonstop": "zero",
    "non stop": "zero",
    "one": "one",
    "1": "one",
    "1-stop": "one",
    "1 stop": "one",
    "two_or_more": "two_or_more",
    "two or more": "two_or_more",
    "2+-stop": "two_or_more",
    "2+": "two_or_more",
    "2": "two_or_more",
    "2 stops": "two_or_more",
    "3": "two_or_more",
    "3 stops": "two_or_more",
    "4": "two_or_more",
    "4 stops": "two_or_more",
}
# Extra stops labels accepted on the request path (after '_' -> ' ').
REQUEST_STOPS_EXTRA = {
    "non-stop": "zero",
    "nonstop": "zero",
    "0": "zero",
    "1 stop": "one",
    "2+ stops": "two_or_more",
    "2 stops": "two_or_more",
}
# City synonym repair applied after trimming (exact match).
CITY_SYNONYMS = {"Banglore": "Bangalore", "New Delhi": "Delhi", "Cochin": "Kochi"}
# Class values meaning "no class" after trim + title case.
UNKNOWN_CLASS_TOKENS = ["Nan", "None", ""]
# Cities the historical model was trained on.
KNOWN_TRAINING_CITIES = ["Delhi", "Mumbai", "Bangalore", "Kolkata", "Hyderabad", "Chennai", "Kochi"]
# --- end of fixed values ---


def map_lookup(mapping: dict[str, str], key: Column) -> Column:
    """NULL when the key is absent (``try_element_at`` never raises under ANSI)."""
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(lit_map, key)


WHITESPACE = " \t\n\r\x0b\x0c"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: trim ASCII whitespace at both ends (``btrim``, no regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalize_airline(c: Column) -> Column:
    """Map on trimmed case-folded text, else original with '_' -> ' ' (not trimmed)."""
    return F.coalesce(map_lookup(AIRLINE_MAP, F.lower(strip_ws(c))), F.replace(c, F.lit("_"), F.lit(" ")))


def normalize_stops(c: Column) -> Column:
    """Map on trimmed case-folded text, else the original text; NULL stays NULL."""
    return F.coalesce(map_lookup(STOPS_MAP, F.lower(strip_ws(c))), c)


def normalize_label(c: Column, mapping: dict[str, str]) -> Column:
    """Key with '-' -> ' ' and '__' -> '_', then plain case-fold, else trimmed text."""
    text = strip_ws(c)
    folded = F.lower(text)
    k1 = F.replace(F.replace(folded, F.lit("-"), F.lit(" ")), F.lit("__"), F.lit("_"))
    return F.coalesce(map_lookup(mapping, k1), map_lookup(mapping, folded), text)


def _hour_labels() -> list[str]:
    labels = ["Night"] * 24
    for lo, hi, label in HOUR_BINS:
        for h in range(lo, hi):
            labels[h] = label
    return labels


#: The hour of a clock text in the first whitespace token, or in the second when the first has no ':'.
HOUR = r"^(?:[^\s:]+\s+)?([+-]?[0-9]+):"


def normalize_time_bin(c: Column) -> Column:
    """Label variants, else clock 'HH:MM' in token 0 or 1 (hours outside 0..23 are Night), else title case with '_' -> ' '."""
    text = strip_ws(c)
    norm = F.translate(F.lower(text), "-_", "  ")
    canon = map_lookup({v.lower(): v for v in TIME_MAP.values()}, norm)
    hour = F.regexp_extract(text, HOUR, 1).try_cast("int")
    labels = F.array(*[F.lit(x) for x in _hour_labels()])
    fallback = F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
    return F.coalesce(canon, F.get(labels, hour), F.when(hour.isNotNull(), "Night"), fallback)


def normalize_class(c: Column) -> Column:
    """NULL/blank/'nan'/'none' -> Unknown; else trimmed title case."""
    titled = F.initcap(strip_ws(c))
    return F.when(c.isNull() | titled.isin(*UNKNOWN_CLASS_TOKENS), "Unknown").otherwise(titled)


def repair_city(c: Column) -> Column:
    """Trim, then exact synonym replacement."""
    t = strip_ws(c)
    return F.coalesce(map_lookup(CITY_SYNONYMS, t), t)


# --- request-side flavours (B13) ---
def request_airline(c: Column) -> Column:
    t = strip_ws(c)
    return F.coalesce(map_lookup(AIRLINE_MAP, F.lower(t)), t)


def request_time(c: Column) -> Column:
    t = strip_ws(c)
    return F.coalesce(map_lookup(TIME_MAP, F.replace(F.lower(t), F.lit("-"), F.lit(" "))), t)


def request_stops(c: Column) -> Column:
    t = strip_ws(c)
    key = F.replace(F.lower(t), F.lit("_"), F.lit(" "))
    merged = {**STOPS_MAP, **REQUEST_STOPS_EXTRA}
    return F.coalesce(map_lookup(merged, key), map_lookup(STOPS_MAP, F.lower(t)), t)
