"""Cleaning, normalisation and harmonisation (B1-B17) as DataFrame transforms.

``clean_tickets`` is one lazily composed chain with a single shuffle (the exact
duplicate removal); every normaliser is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelake.functions import labels as L

NUMERIC_COLUMNS = ["duration", "days_left", "price"]


def drop_unnamed(df: DataFrame) -> DataFrame:
    """B1: drop index columns written by spreadsheet exports (metadata only)."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """B2: exact duplicates over all columns (NULLs compare equal, as pandas).

    Rows are dealt by their values first: a task then holds the rows of its part alone, where an aggregate before the
    shuffle would hold (and spill) whole input splits to find next to nothing twice. Texts and whole numbers deal them, as
    equal floating-point numbers (0.0 and -0.0) may hash differently."""
    dealt = [f"`{name}`" for name, kind in df.dtypes if kind in ("string", "boolean", "date", "timestamp", "int", "bigint")]
    return (df.repartition(*dealt) if dealt else df).dropDuplicates()


def normalize_labels(df: DataFrame) -> DataFrame:
    """B3-B7 in one projection."""
    return df.withColumns(
        {
            "airline": L.normalize_airline(F.col("airline")),
            "departure_time": L.normalize_time_bin(F.col("departure_time")),
            "arrival_time": L.normalize_time_bin(F.col("arrival_time")),
            "stops": L.normalize_stops(F.col("stops")),
            "class": L.normalize_class(F.col("class")),
            "source_city": L.repair_city(F.col("source_city")),
            "destination_city": L.repair_city(F.col("destination_city")),
        }
    )


def coerce_numeric(df: DataFrame, cols: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    """Bad text -> NULL (``try_cast`` is ANSI-safe); NaN -> NULL so SQL aggregates agree. Doubles are read as they are."""
    out, kinds = {}, dict(df.dtypes)
    for c in cols:
        v = F.col(c) if kinds.get(c) == "double" else F.col(c).cast("string").try_cast("double")
        out[c] = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    return df.withColumns(out)


def _same_city() -> Column:
    return F.coalesce(F.col("source_city") == F.col("destination_city"), F.lit(False))


def is_valid() -> Column:
    """No reason against a row. Numbers are compared plainly, as Spark moves these checks down to the scans, where it would
    interpret the array of reasons for every row. Cities that differ are settled by a plain comparison too; only rows whose cities
    look equal are checked as that array does it (a null place in a list is null there, but the list's last value in compiled code)."""
    dur, price = F.col("duration"), F.col("price")
    numbers = dur.isNotNull() & (dur > 0) & price.isNotNull() & (price > 0)
    return numbers & (~_same_city() | (F.size(F.array_compact(F.array(F.when(_same_city(), F.lit("same_city"))))) == 0))


def rejection_reasons(df: DataFrame) -> Column:
    """B9 reasons as an array; every predicate is explicitly null-safe."""
    dur, price = F.col("duration"), F.col("price")
    same_city = _same_city()
    return F.array_compact(
        F.array(
            F.when(dur.isNull(), F.lit("duration_missing")),
            F.when(dur <= 0, F.lit("duration_not_positive")),
            F.when(price.isNull(), F.lit("price_missing")),
            F.when(price <= 0, F.lit("price_not_positive")),
            F.when(same_city, F.lit("same_city")),
        )
    )


def add_route(df: DataFrame) -> DataFrame:
    """Route key (overwrites an input ``route``)."""
    return df.withColumn("route", F.concat(F.col("source_city"), F.lit("_"), F.col("destination_city")))


def _normalized(df: DataFrame) -> DataFrame:
    return coerce_numeric(normalize_labels(drop_exact_duplicates(drop_unnamed(df))))


def clean_tickets(df: DataFrame) -> DataFrame:
    """B1 -> B2 -> B3..B8 -> B9 filter -> B10."""
    return add_route(_normalized(df).filter(is_valid()))


def quarantine(df: DataFrame) -> DataFrame:
    """Rows B9 would drop, with their reason codes (null-safe, nothing silently lost)."""
    base = _normalized(df)
    return base.withColumn("reasons", rejection_reasons(base)).filter(F.size("reasons") > 0)


def row_accounting(raw: DataFrame) -> DataFrame:
    """Rows in, duplicates, invalid, rows out per class, in one aggregate pass per stage."""
    deduped = _normalized(raw)
    staged = deduped.withColumn("_bad", F.size(rejection_reasons(deduped)) > 0)
    per_class = staged.groupBy("class").agg(
        F.count("*").alias("rows_after_dedupe"),
        F.count_if("_bad").alias("rows_invalid"),
        F.count_if(~F.col("_bad")).alias("rows_out"),
    )
    total_in = drop_unnamed(raw).groupBy().agg(F.count("*").alias("rows_in"))
    return per_class.crossJoin(total_in)  # 1-row side: a scalar broadcast, not a pair expansion


# --- B14/B15 second source harmonisation ---------------------------------------
SECOND_SOURCE_RENAMES = {
    "Airline": "airline",
    "Date_of_Journey": "date_of_journey",
    "Source": "source_city",
    "Destination": "destination_city",
    "Route": "route",
    "Dep_Time": "departure_time",
    "Arrival_Time": "arrival_time",
    "Duration": "duration",
    "Total_Stops": "stops",
    "Additional_Info": "additional_info",
    "Price": "price",
}


def duration_text_to_hours(c: Column) -> Column:
    """B15: '2h 50m' -> 2.8333, '19h' -> 19.0, '5m' -> 0.0833; no match -> NULL."""
    h = F.regexp_extract(c, r"(\d+)\s*h", 1)
    m = F.regexp_extract(c, r"(\d+)\s*m", 1)
    hours = F.coalesce(F.nullif(h, F.lit("")).cast("double"), F.lit(0.0))
    mins = F.coalesce(F.nullif(m, F.lit("")).cast("double"), F.lit(0.0))
    return F.when((h != "") | (m != ""), hours + mins / 60.0)


def harmonise_second_source(second: DataFrame) -> DataFrame:
    """Rename, class Unknown, days_left NULL, duration text -> hours; dedupe the source first."""
    renamed = second.dropDuplicates().select(
        *[F.col(f"`{src}`").alias(dst) for src, dst in SECOND_SOURCE_RENAMES.items() if src in second.columns]
    )
    return renamed.withColumns(
        {
            "class": F.lit("Unknown"),
            "days_left": F.lit(None).cast("double"),
            "duration": duration_text_to_hours(F.col("duration")).cast("string"),
            "price": F.col("price").cast("double"),
        }
    )


def same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two tables hold the same rows (with multiplicity)? One row of counts + verdict.

    Each side is reduced to (row, copies) by a partial-aggregated groupBy, then full-outer
    joined on the row; no per-row pairs are formed.
    """
    cols = a.columns
    ca = a.groupBy(*cols).agg(F.count("*").alias("_na"))
    cb = b.select(*cols).groupBy(*cols).agg(F.count("*").alias("_nb"))
    j = ca.join(cb, [ca[c].eqNullSafe(cb[c]) for c in cols], "full_outer")
    na, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))
    return j.agg(
        F.sum(na).alias("rows_a"),
        F.sum(nb).alias("rows_b"),
        F.sum(F.greatest(na - nb, F.lit(0))).alias("only_in_a"),
        F.sum(F.greatest(nb - na, F.lit(0))).alias("only_in_b"),
    ).withColumn("identical", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))
