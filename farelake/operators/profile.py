"""Data-quality profile (C1-C10) as long-form tables.

Each report is one aggregate pass (all columns in a single ``agg``) followed by a
``stack`` to (column, metric, value) rows — never one job per column. Quantiles are exact
and distributed (``ranks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelake.functions.stats import cents
from farelake.operators import ranks as R

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _stack(df: DataFrame, pairs: list[tuple[str, str, str]], value_type: str) -> DataFrame:
    """pairs: (column, metric, agg_alias) -> long rows."""
    args = ", ".join(f"'{c}', '{m}', CAST(`{a}` AS {value_type})" for c, m, a in pairs)
    return df.selectExpr(f"stack({len(pairs)}, {args}) AS (column, metric, value)")


def shape(df: DataFrame) -> DataFrame:
    """One row per column with position and Spark type, plus the table's row count."""
    n = df.agg(F.count("*").alias("rows"))
    meta = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string",
    )
    return meta.crossJoin(n)


def missing_counts(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count per column."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cond = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()
        aggs.append(F.count_if(cond).alias(f"m_{f.name}"))
    wide = df.agg(*aggs)
    return _stack(wide, [(f.name, "missing", f"m_{f.name}") for f in df.schema.fields], "BIGINT")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy (NULLs equal, like pandas ``duplicated``)."""
    n = df.agg(F.count("*").alias("rows"))
    d = df.distinct().agg(F.count("*").alias("distinct_rows"))
    return n.crossJoin(d).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """C4: distinct non-NULL values per column. Values are made distinct in (column, value) form first, so
    rows are reduced before they move and no row is expanded once per column inside one aggregate."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    values = df.select(F.explode(cells).alias("_c")).select("_c.column", "_c.value").distinct()
    found = values.groupBy("column").agg(F.count("value").alias("value"))
    return found.select("column", F.lit("unique").alias("metric"), "value")


#: Sketches of 2**14 cells: a relative standard error of 0.81 %.
SKETCH_LG = 14


def sketch_bound(lg: int = SKETCH_LG) -> float:
    """Relative error that an estimate keeps within, at three standard errors."""
    return 3 * 1.04 / 2 ** (lg / 2)


def distinct_sketches(df: DataFrame, part: list[str], columns: list[str] | None = None, lg: int = SKETCH_LG) -> DataFrame:
    """C4, approximate: part columns, column, sketch of the column's non-NULL values, one row per part and column.

    A part is what arrives together (a file, a day, a class): its rows are read once, its sketches are kept, and any
    choice of parts is merged later without its rows. Aggregated map-side, so a hot part moves as one sketch a task.
    """
    columns = columns or [c for c in df.columns if c not in part]
    found = df.groupBy(*part).agg(*(F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg).alias(f"_s{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(columns)))
    return found.select(*part, F.explode(cells).alias("_c")).select(*part, "_c.column", "_c.sketch")


def merged_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Estimated distinct values per column (and ``by``) over all parts given; a column without values counts 0."""
    found = sketches.groupBy(*(by or []), "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value"))
    return found.select(*(by or []), "column", F.lit("approx_unique").alias("metric"), "value")


def numeric_stats(df: DataFrame, cols: list[str] | None = None, digits: int = 6) -> DataFrame:
    """min/max/mean/median/std (sample) per numeric column; all-NULL columns are skipped."""
    cols = cols or numeric_columns(df)
    plain = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    wide = df.agg(*(fn(F.col(c).cast("double")).alias(f"{m}_{c}") for c in cols for m, fn in plain.items()), *(F.count(c).alias(f"n_{c}") for c in cols))
    wide = wide.crossJoin(F.broadcast(R.column_quantiles(df, cols, {"median": 0.5})))  # one row each
    rounded = wide.select(
        *[F.col(f"n_{c}") for c in cols],
        *[F.round(F.col(f"{m}_{c}"), digits).alias(f"{m}_{c}") for c in cols for m in plain],
        *[F.round(F.col(f"`{c}`.median"), digits).alias(f"median_{c}") for c in cols],
    )
    pairs = [(c, m, f"{m}_{c}") for c in cols for m in ("min", "max", "mean", "median", "std")]
    long = _stack(rounded, pairs + [(c, "count", f"n_{c}") for c in cols], "DOUBLE")
    nonempty = long.filter("metric = 'count' AND value > 0").select("column")
    return long.filter("metric <> 'count'").join(nonempty, "column", "left_semi")


def iqr_outliers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count outside [Q1 - 1.5 IQR, Q3 + 1.5 IQR] per numeric column (two passes).

    Pass 1 computes the 1-row quartile table; pass 2 joins it as a broadcast scalar row.
    """
    cols = cols or numeric_columns(df)
    bounds = R.column_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).select(*(F.col(c).alias(f"q_{c}") for c in cols))
    j = df.select(*cols).crossJoin(F.broadcast(bounds))
    aggs = []
    for c in cols:
        q1, q3 = F.col(f"q_{c}")["q1"], F.col(f"q_{c}")["q3"]
        iqr = q3 - q1
        x = F.col(c).cast("double")
        aggs.append(F.count_if((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)).alias(f"o_{c}"))
        aggs.append(F.count(x).alias(f"n_{c}"))
    wide = j.agg(*aggs)
    long = _stack(wide, [(c, "outliers", f"o_{c}") for c in cols] + [(c, "count", f"n_{c}") for c in cols], "BIGINT")
    nonempty = long.filter("metric = 'count' AND value > 0").select("column")
    return long.filter("metric = 'outliers'").join(nonempty, "column", "left_semi")


def target_stats(df: DataFrame, target: str = "price") -> DataFrame:
    """Statistics of the coerced target."""
    t = df.select(F.col(target).cast("string").try_cast("double").alias(target))
    return numeric_stats(t, [target])


def price_terciles(df: DataFrame, col: str = "price") -> DataFrame:
    """budget/high cut points at the 0.33 and 0.66 quantiles (money computed on cents)."""
    found = R.quantiles(df.select(cents(col).alias("_cents")), [], "_cents", {"low": 0.33, "high": 0.66})
    return found.select(F.round(F.col("low") / 100, 4).alias("budget_max"), F.round(F.col("high") / 100, 4).alias("high_min"))


def domain_catalogue(df: DataFrame) -> DataFrame:
    """Sorted domains (low-cardinality columns), cities, route count and class rows, long form."""
    lists = df.agg(
        F.array_join(F.sort_array(F.collect_set("airline")), "|").alias("airlines"),
        F.array_join(F.sort_array(F.collect_set("stops")), "|").alias("stops"),
        F.array_join(F.sort_array(F.collect_set("departure_time")), "|").alias("departure_times"),
        F.array_join(F.sort_array(F.collect_set("arrival_time")), "|").alias("arrival_times"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.array("source_city", "destination_city"))))), "|").alias(
            "cities"
        ),
        F.array_join(F.sort_array(F.collect_set("class")), "|").alias("classes"),
        F.count_distinct("source_city", "destination_city").cast("string").alias("route_count"),
    )
    items = ["airlines", "stops", "departure_times", "arrival_times", "cities", "classes", "route_count"]
    stacked = lists.selectExpr(f"stack({len(items)}, " + ", ".join(f"'{i}', `{i}`" for i in items) + ") AS (item, value)")
    per_class = df.groupBy("class").agg(F.count("*").cast("string").alias("value")).select(
        F.concat(F.lit("rows_"), F.col("class")).alias("item"), "value"
    )
    return stacked.unionByName(per_class)
