"""Location dimension, name resolution, search and geographic columns.

Joins with the airport dimension carry no hint: Spark sees the size of each side and broadcasts a small one.
Fact tables never resolve names row by row: only the *distinct* place strings are resolved, then joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelake.functions import geo as G
from farelake.functions.labels import KNOWN_TRAINING_CITIES, strip_ws
from farelake.session import written_table

DEFAULT_SEARCH_LIMIT = 8
#: Longest character run that the search index lists.
GRAM = 3


def airport_dimension(raw: DataFrame) -> DataFrame:
    """Normalise IATA/city, coerce coordinates, drop rows without them, first row per IATA.

    "First" is by the explicit ``seq`` column (file order), not an arbitrary ``dropDuplicates``.
    """
    df = raw.select(
        F.upper(strip_ws(F.col("iata"))).alias("iata"),
        strip_ws(F.col("city")).alias("city"),
        F.col("airport").cast("string").alias("airport"),
        F.col("state").cast("string").alias("state"),
        F.col("country").cast("string").alias("country"),
        F.col("latitude").cast("string").try_cast("double").alias("latitude"),
        F.col("longitude").cast("string").try_cast("double").alias("longitude"),
        F.coalesce(F.col("aliases"), F.lit("")).alias("aliases"),
        F.col("seq"),
    ).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("iata").isNotNull())
    w = Window.partitionBy("iata").orderBy("seq")
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def name_index(raw: DataFrame, dim: DataFrame) -> DataFrame:
    """D2 (+ D3 keys): lookup key -> IATA.

    Keys: lower-cased IATA (priority 0, only 3-letter codes are reachable), then city and
    every alias of every raw row whose IATA survived D1 (priority 1, *last* row wins).
    """
    kept = dim.select("iata")
    rows = raw.select(
        F.upper(strip_ws(F.col("iata"))).alias("iata"),
        strip_ws(F.col("city")).alias("city"),
        F.coalesce(F.col("aliases"), F.lit("")).alias("aliases"),
        "seq",
    ).join(kept, "iata", "left_semi")
    names = rows.select(
        "iata", "seq", F.explode(F.array_union(F.array("city"), F.split("aliases", r"\|"))).alias("name")
    ).select("iata", "seq", F.lower(strip_ws(F.col("name"))).alias("key"), F.lit(1).alias("prio"))
    names = names.filter(F.col("key") != "")
    codes = dim.filter(F.length("iata") == 3).select(
        "iata", "seq", F.lower("iata").alias("key"), F.lit(0).alias("prio")
    )
    allk = codes.unionByName(names)
    return allk.groupBy("key").agg(F.min_by("iata", F.struct("prio", (-F.col("seq")).alias("nseq"))).alias("iata"))


def _search_score(q: Column) -> Column:
    city, iata, airport = F.lower("city"), F.lower("iata"), F.lower("airport")
    tokens = F.array_union(
        F.array(F.col("city"), F.col("airport"), F.col("iata"), F.col("state")), F.split(F.col("aliases"), r"\|")
    )
    any_token = F.exists(tokens, lambda t: F.lower(strip_ws(t)).contains(q))
    return (
        F.when(q == iata, 0)
        .when(city.startswith(q) | iata.startswith(q), 1)
        .when(city.contains(q) | iata.contains(q), 2)
        .when(airport.contains(q) | any_token, 3)
    )


def _grams(text: Column, width: Column | int) -> Column:
    """All runs of ``width`` characters of a text, in order."""
    width = F.lit(width) if isinstance(width, int) else width
    places = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, width))


def gram_index(dim: DataFrame) -> DataFrame:
    """D6 index: iata, gram for every run of 1 to ``GRAM`` characters of the texts that a search looks into (each once)."""
    texts = F.array_compact(
        F.concat(F.array("city", "airport", "iata", "state"), F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")))
    )
    grams = F.flatten(F.transform(texts, lambda t: F.concat(*(_grams(F.lower(t), n) for n in range(1, GRAM + 1)))))
    return dim.select("iata", F.explode(F.array_distinct(grams)).alias("gram"))


def search(queries: DataFrame, dim: DataFrame, limit: int = DEFAULT_SEARCH_LIMIT, query_col: str = "q") -> DataFrame:
    """Ranked search for many queries at once; top ``limit`` per query. ``dim`` has one row per ``iata``.

    A text that contains a query contains every gram of it, so each query meets, by an equality join, only the airports
    listed under its rarest gram; a query with a gram that no airport has meets none. The score then decides, and a
    per-query ``row_number`` (planned as a partial + final WindowGroupLimit) ranks.
    Order: score, city, file order. Blank queries return nothing.
    """
    qs = queries.select(F.col(query_col).alias("_query")).distinct()
    qs = qs.withColumn("_qk", F.lower(strip_ws(F.col("_query")))).filter(F.length("_qk") >= 1)
    index = gram_index(dim)
    sizes = index.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    each = qs.withColumn("gram", F.explode(F.array_distinct(_grams(F.col("_qk"), F.least(F.lit(GRAM), F.length("_qk"))))))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_rarest")
    rare = each.join(sizes, "gram", "left").groupBy("_query", "_qk").agg(rarest).filter("_rarest.n > 0")
    met = rare.select("_query", "_qk", F.col("_rarest.gram").alias("gram")).join(index, "gram").drop("gram")
    scored = met.join(dim, "iata").withColumn("score", _search_score(F.col("_qk"))).filter(F.col("score").isNotNull())
    w = Window.partitionBy("_query").orderBy("score", "city", "seq")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return ranked.select(
        F.col("_query").alias(query_col), "rank", "score", "iata", "city", "airport", "state", "country", "latitude", "longitude"
    )


def resolve(queries: DataFrame, dim: DataFrame, index: DataFrame, query_col: str = "q") -> DataFrame:
    """D5 cascade for the distinct query strings: IATA -> city/alias -> best search hit.

    Unresolved strings come back with NULL ``iata`` (callers anti-join or assert on them).
    """
    qs = queries.select(F.col(query_col).alias("q")).distinct()
    keyed = qs.withColumn("_key", F.lower(strip_ws(F.col("q"))))
    exact = keyed.join(index, keyed["_key"] == index["key"], "left").select(
        "q", F.col("iata").alias("_exact")
    )
    hits = search(exact.filter("_exact IS NULL").select("q"), dim, limit=1).select("q", F.col("iata").alias("_hit"))
    picked = exact.join(hits, "q", "left").select("q", F.coalesce("_exact", "_hit").alias("iata"))
    geo = dim.select("iata", "city", "latitude", "longitude")
    return picked.join(geo, "iata", "left").select(
        F.col("q").alias(query_col), "iata", F.col("city").alias("resolved_city"), "latitude", "longitude"
    )


def add_geographic_features(
    df: DataFrame,
    dim: DataFrame,
    index: DataFrame,
    source_col: str = "source_city",
    dest_col: str = "destination_city",
    strict: bool = False,
    materialize: bool = True,
) -> DataFrame:
    """source/destination coordinates and ``distance_km``.

    Distinct place strings are resolved once (a partial-aggregated pass over the facts) and written as a
    table to the shared folder. Spark knows that table's size, so it joins it back by broadcast while it is
    small, without moving the facts.
    ``strict=True`` mirrors the reference's failure on unresolved places.
    """
    names = df.select(F.explode(F.array(F.col(source_col), F.col(dest_col))).alias("q")).filter(
        F.col("q").isNotNull()
    )
    res = resolve(names, dim, index)
    if materialize:
        res = written_table(res, "places")
    if strict:
        bad = res.filter(F.col("iata").isNull()).limit(1).collect()
        if bad:
            raise LookupError(f"One or more places could not be geocoded, e.g. {bad[0]['q']!r}")
    s = res.select(
        F.col("q").alias("_sq"), F.col("latitude").alias("source_lat"), F.col("longitude").alias("source_lon")
    )
    t = res.select(
        F.col("q").alias("_dq"),
        F.col("latitude").alias("destination_lat"),
        F.col("longitude").alias("destination_lon"),
    )
    out = df.join(s, df[source_col] == s["_sq"], "left").drop("_sq")
    out = out.join(t, out[dest_col] == t["_dq"], "left").drop("_dq")
    # Rounded to micrometres so A->B and B->A are bit-identical (libm noise differs by engine).
    return out.withColumn(
        "distance_km",
        F.round(G.haversine_km(F.col("source_lat"), F.col("source_lon"), F.col("destination_lat"), F.col("destination_lon")), 6),
    )


def unresolved_places(df: DataFrame, dim: DataFrame, index: DataFrame, cols=("source_city", "destination_city")) -> DataFrame:
    """Strings D5 cannot resolve, with their row counts (the anti-join behind strict mode)."""
    names = df.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("q"))
    counts = names.groupBy("q").agg(F.count("*").alias("rows"))
    res = resolve(counts.select("q"), dim, index)
    return counts.join(res.filter(F.col("iata").isNotNull()), "q", "left_anti")


def route_distances(pairs: DataFrame, dim: DataFrame, src: str = "source_iata", dst: str = "destination_iata") -> DataFrame:
    """Distance for IATA pairs (rounded 2) with a reason when rejected."""
    d = dim.select("iata", "latitude", "longitude")
    a = d.select(F.col("iata").alias("_a"), F.col("latitude").alias("_alat"), F.col("longitude").alias("_alon"))
    b = d.select(F.col("iata").alias("_b"), F.col("latitude").alias("_blat"), F.col("longitude").alias("_blon"))
    p = pairs.withColumns({"_ks": F.upper(strip_ws(F.col(src))), "_kd": F.upper(strip_ws(F.col(dst)))})
    j = p.join(a, p["_ks"] == a["_a"], "left").join(b, F.col("_kd") == b["_b"], "left")
    reason = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "location_not_found")
        .when(F.col("_a") == F.col("_b"), "same_airport")
    )
    dist = F.round(G.haversine_km(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon")), 2)
    return j.withColumns({"distance_km": F.when(reason.isNull(), dist), "reason": reason}).drop(
        "_ks", "_kd", "_a", "_alat", "_alon", "_b", "_blat", "_blon"
    )


def distance_matrix(dim: DataFrame) -> DataFrame:
    """D9 full matrix over the (bounded) dimension: ordered pairs of distinct airports."""
    a = dim.select(F.col("iata").alias("source_iata"), F.col("latitude").alias("_alat"), F.col("longitude").alias("_alon"))
    b = dim.select(F.col("iata").alias("destination_iata"), F.col("latitude").alias("_blat"), F.col("longitude").alias("_blon"))
    j = a.join(b, F.col("source_iata") != F.col("destination_iata"))
    return j.select(
        "source_iata",
        "destination_iata",
        F.round(G.haversine_km(F.col("_alat"), F.col("_alon"), F.col("_blat"), F.col("_blon")), 2).alias("distance_km"),
    )


def known_city_flags(df: DataFrame, city_cols=("source_city", "destination_city"), known: list[str] | None = None) -> DataFrame:
    """Per-endpoint known-city flags and the out-of-distribution flag."""
    known_l = [c.lower() for c in (known or KNOWN_TRAINING_CITIES)]
    flags = {f"{c}_known": F.lower(strip_ws(F.col(c))).isin(*known_l) for c in city_cols}
    out = df.withColumns(flags)
    return out.withColumn("out_of_training_distribution", ~(F.col(f"{city_cols[0]}_known") & F.col(f"{city_cols[1]}_known")))
