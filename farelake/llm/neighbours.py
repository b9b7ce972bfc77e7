"""Each row's next row in descending key order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Key ranges: a few for each shuffle partition, and a bound on what their edges take on the driver.
RANGES_PER_PARTITION, MOST_RANGES = 4, 16384
_STEP = 64


def _range_of(key: Column, edges: list[int]) -> Column:
    """How many edges are at or below the key: a coarse look, then a fine one."""
    fine = F.array(*(F.lit(e).cast("long") for e in edges))
    coarse = F.array(*(F.lit(e).cast("long") for e in edges[::_STEP]))
    whole = F.size(F.filter(coarse, lambda e: e <= key))
    block = F.slice(fine, F.greatest(whole - 1, F.lit(0)) * _STEP + 1, _STEP)
    return F.greatest(whole - 1, F.lit(0)) * _STEP + F.size(F.filter(block, lambda e: e <= key))


def ranged(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with range and ghost: key ranges of about equal rows, in each of which the row after its last one is
    there as a ghost (after the very last row comes the first). Null keys come after all others.

    Edges are quantiles of the key. Only edges, and each range's largest key, come to the driver.
    """
    n = min(MOST_RANGES, RANGES_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))
    keys = rows.select(order.alias("k"))
    at = F.array(*(F.lit(i / n) for i in range(1, n)))
    edges = sorted(set(keys.agg(F.percentile_approx("k", at, 100 * n).alias("e")).first()["e"] or [0]))
    tops = {r["r"]: r["top"] for r in keys.groupBy(_range_of(F.col("k"), edges).alias("r")).agg(F.max("k").alias("top")).collect()}
    filled = sorted(tops)
    above = dict(zip(filled, filled[1:] + filled[:1]))  # the largest row of a range follows the range above it
    slots = range(len(edges) + 1)
    top = F.array(*(F.lit(tops.get(r)).cast("long") for r in slots))
    target = F.array(*(F.lit(above.get(r)).cast("int") for r in slots))
    placed = rows.withColumns({"_order": order, "_own": _range_of(order, edges)})
    own = F.struct(F.col("_own").cast("int").alias("range"), F.lit(False).alias("ghost"))
    again = F.struct(F.get(target, F.col("_own")).cast("int").alias("range"), F.lit(True).alias("ghost"))
    both = F.when(F.col("_order") == F.get(top, F.col("_own")), F.array(own, again)).otherwise(F.array(own))
    return placed.withColumn("_at", F.explode(both)).select(*rows.columns, "_order", F.col("_at.range").alias("_range"), F.col("_at.ghost").alias("_ghost"))


def following(text: str) -> Window:
    """Descending keys, equal keys by text, in a range; its ghosts last."""
    return Window.partitionBy("_range").orderBy("_ghost", F.col("_order").desc(), F.col(text).asc_nulls_first())
