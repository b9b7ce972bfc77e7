"""Exact order statistics that scale: quantiles, grouped or not, without a value map in one task.

Equal values are counted first (partial aggregation), so only distinct values move. They fall into ranges of about
equal numbers of distinct values; range totals give each range its offset, and running sums inside ranges
give each value the number of rows before it. A rank is then a filter, and a quantile interpolates two ranks.
Edges of the ranges only balance the work, so an approximate sketch is good enough for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def cumulative(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n, before (rows of the group with a smaller value) and total; NULL values are left out."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    edges = counts.agg(F.percentile_approx(value, F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 1000).alias("_edges"))
    dealt = counts.crossJoin(F.broadcast(edges))  # one row
    dealt = dealt.withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    of_group, before = Window.partitionBy(*group), (Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*group, "_range").agg(F.sum("n").alias("_rows"))
    ranges = ranges.withColumns({
        "_offset": F.coalesce(F.sum("_rows").over(of_group.orderBy("_range").rowsBetween(*before)), F.lit(0)),
        "total": F.sum("_rows").over(of_group),
    }).drop("_rows")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy(*group, "_range").orderBy(value).rowsBetween(*before)), F.lit(0))
    dealt = dealt.withColumn("_inside", inside)
    names = {g: f"_of_{g}" for g in group} | {"_range": "_of_range"}
    ranges = ranges.withColumnsRenamed(names)
    same = reduce(Column.__and__, (dealt[a].eqNullSafe(ranges[b]) for a, b in names.items()))
    return dealt.join(ranges, same).select(*group, value, "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total")


def _at(value: str, rank: Column) -> Column:
    """The value with the given rank, from 0."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value).cast("double")))


def quantiles(values: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """One row per group (of those with a value): exact interpolated quantiles by name."""
    ranked = cumulative(values, group, value)
    aggs = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        aggs += [_at(value, F.floor(place)).alias(f"_lo_{name}"), _at(value, F.ceil(place)).alias(f"_hi_{name}")]
    found = ranked.groupBy(*group).agg(F.max("total").alias("total"), *aggs)
    out = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    return found.select(*group, *out)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the numeric columns, as doubles."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("_c")).select("_c.column", "_c.value")


def column_quantiles(df: DataFrame, columns: list[str], wanted: dict[str, float]) -> DataFrame:
    """One row: for each column a struct ``column`` with the wanted quantiles (NULL for a column without values)."""
    found = quantiles(long_form(df, columns), ["column"], "value", wanted)
    packed = F.struct(*wanted)
    return found.agg(*(F.max(F.when(F.col("column") == c, packed)).alias(c) for c in columns))


def upper_medians(values: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """sorted(values)[n // 2] per group."""
    return cumulative(values, group, value).groupBy(*group).agg(_at(value, F.floor(F.col("total") / 2)).alias(name))


def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be NULL; the keys come once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(Column.__and__, (left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys))
    return left.join(other, same, "left").drop(*(f"_r_{k}" for k in keys))
