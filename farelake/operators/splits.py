"""Leakage-safe train/test partitioning (F1-F6) without global sorts, row joins or full-table shuffles.

Every split is deterministic: rows are ordered by an md5 key of their content plus a seed
(reproducible across cluster layouts, unlike ``randomSplit``). "The first n rows" is exact: a histogram
over the first three hex digits of the key finds the bucket in which the n-th row lies, a second one inside it
the next three digits, and counts of the keys with those six digits find the boundary key. All other rows are labelled by
comparing their key with it, so no row is joined and none can be duplicated; copies of the boundary key (a row may be
repeated in a third of the table) are numbered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelake.operators import ranks as R
from farelake.session import written_table

SEED = 42
TEST_SIZE = 0.2
ROW_KEY_COLUMNS = [
    "airline", "flight", "source_city", "departure_time", "stops", "arrival_time", "destination_city", "class",
]
ROW_KEY_NUMBERS = ["price", "duration", "days_left"]
_DIGITS = 3


def row_key(seed: int = SEED) -> Column:
    """md5 over a row's values: texts with their length before them, numbers in millionths, NULL as ``N``."""
    texts = [F.coalesce(F.concat(F.length(c), F.lit(":"), F.col(c)), F.lit("N")) for c in ROW_KEY_COLUMNS]
    numbers = [F.coalesce(F.round(F.col(c) * 1000000).cast("long").cast("string"), F.lit("N")) for c in ROW_KEY_NUMBERS]
    return F.md5(F.concat_ws("|", *texts, *numbers, F.lit(str(seed))))


def _boundary(counts: DataFrame, before: Column | None = None) -> DataFrame:
    """One row: the prefix in which row ``_take`` lies and the rows before it (NULL if there is no such row).
    ``counts`` has _prefix, _n and _take, and 16^3 rows at most."""
    upto = F.sum("_n").over(Window.orderBy("_prefix")) + (before if before is not None else F.lit(0))
    hit = counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take")))
    return hit.agg(F.max("_prefix").alias("_prefix"), F.max(F.col("_upto") - F.col("_n")).alias("_before"), F.max("_take").alias("_take"))


def first_n(df: DataFrame, key: str, take: DataFrame, first: str, rest: str) -> DataFrame:
    """Add ``split``: ``first`` for the first ``_take`` rows by ``key`` (32 hex digits), else ``rest``. ``take`` is a
    one-row DataFrame with ``_take``."""
    prefix = lambda n: F.substring(key, 1, n * _DIGITS)
    coarse = df.groupBy(prefix(1).alias("_prefix")).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(take))
    one = _boundary(coarse).select(F.col("_prefix").alias("_one"), F.col("_before").alias("_skip"), "_take")
    inside = df.select(prefix(1).alias("_p"), prefix(2).alias("_prefix")).crossJoin(F.broadcast(one)).filter("_p = _one")
    fine = inside.groupBy("_prefix", "_skip", "_take").agg(F.count(F.lit(1)).alias("_n"))
    edge = _boundary(fine, F.col("_skip")).withColumnsRenamed({"_prefix": "_edge", "_before": "_done"})
    j = df.crossJoin(F.broadcast(edge))  # one row
    sides = j.filter(F.col("_edge").isNull() | (prefix(2) != F.col("_edge"))).withColumn("split", F.when(prefix(2) < F.col("_edge"), first).otherwise(rest))
    at = j.filter(prefix(2) == F.col("_edge"))
    keys = at.groupBy(F.substring(key, 1, 32).alias("_prefix"), F.col("_done").alias("_skip"), "_take").agg(F.count(F.lit(1)).alias("_n"))
    last = _boundary(keys, F.col("_skip")).select(F.col("_prefix").alias("_last"), F.col("_before").alias("_gone"))
    at = at.crossJoin(F.broadcast(last))  # one row
    near = at.filter(F.col(key) != F.col("_last")).withColumn("split", F.when(F.col(key) < F.col("_last"), first).otherwise(rest))
    # copies of the boundary key, however many, are numbered where they lie: counts of tasks come before them
    copies = at.filter(F.col(key) == F.col("_last")).withColumn("_at", F.monotonically_increasing_id())
    task = F.shiftright("_at", 33)
    tasks = copies.groupBy(task.alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))  # a row a task
    tasks = tasks.select("_prefix", (F.sum("_rows").over(Window.orderBy("_prefix")) - F.col("_rows")).alias("_ahead"))
    rank = F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    copies = copies.join(F.broadcast(tasks), task == F.col("_prefix")).withColumn("split", F.when(F.col("_gone") + rank <= F.col("_take"), first).otherwise(rest))
    out = sides.unionByName(near.drop("_last", "_gone")).unionByName(copies.drop("_last", "_gone", "_at", "_prefix", "_ahead"))
    return out.drop("_edge", "_done", "_take")


def random_holdout(df: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """``split`` = test for ceil(test_size * n) rows in md5 order, else train."""
    take = df.agg(F.ceil(F.count(F.lit(1)) * test_size).cast("long").alias("_take"))
    return first_n(df.withColumn("_key", row_key(seed)), "_key", take, "test", "train").drop("_key")


def temporal_holdout(df: DataFrame, train_ratio: float = 0.8, seed: int = SEED, order: Column | None = None) -> DataFrame:
    """the first int(train_ratio * n) rows in time are train.

    Time is ``flight_date`` if the table has one with a value, else ``days_left`` from high to low; rows without a time
    come last, ties go by row key. A table with neither goes by row key alone unless ``order`` (a number) says
    how its rows stand. The boundary value comes from distributed counts of the values; only rows with that very
    value are split among themselves.
    """
    if order is None:
        if "flight_date" in df.columns and df.filter("flight_date IS NOT NULL").limit(1).count():
            order = F.unix_micros(F.col("flight_date").cast("timestamp")).cast("double")
        elif "days_left" in df.columns:
            order = -F.col("days_left").cast("double")
        else:
            order = F.lit(0.0)
    late = F.lit(float("inf"))  # after every time
    rows = df.withColumns({"_time": F.coalesce(order, late) + F.lit(0.0), "_key": row_key(seed)})
    counts = R.cumulative(rows, [], "_time")
    wanted = F.floor(F.col("total") * train_ratio).cast("long")
    hit = counts.filter((F.col("before") < wanted) & (F.col("before") + F.col("n") >= wanted))
    edge = hit.agg(F.max("_time").alias("_time_edge"), F.max(wanted - F.col("before")).alias("_time_left"))
    j = rows.crossJoin(F.broadcast(edge))  # one row
    sides = j.filter(F.col("_time_edge").isNull() | (F.col("_time") != F.col("_time_edge"))).withColumn("split", F.when(F.col("_time") < F.col("_time_edge"), "train").otherwise("test"))
    at = first_n(j.filter(F.col("_time") == F.col("_time_edge")), "_key", edge.select(F.col("_time_left").alias("_take")), "train", "test")
    return sides.unionByName(at).drop("_time", "_key", "_time_edge", "_time_left")


def group_col_route() -> Column:
    return F.concat_ws(" → ", F.col("source_city"), F.col("destination_city"))


def held_out_groups(df: DataFrame, group: Column, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """ceil(test_size * G) whole groups, chosen by md5(group || seed) order."""
    groups = df.select(group.alias("grp")).distinct().filter(F.col("grp").isNotNull())
    g = groups.withColumn("_key", F.md5(F.concat(F.col("grp"), F.lit(f"|{seed}"))))
    take = g.agg(F.ceil(F.count(F.lit(1)) * test_size).cast("long").alias("_take"))
    return first_n(g, "_key", take, "test", "train").filter("split = 'test'").select("grp")


def group_holdout(df: DataFrame, group: Column, test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """label every row train/test by membership of its group in the held-out set. The held-out groups are written, so that
    Spark knows their size and does not shuffle the rows to join them."""
    held = written_table(held_out_groups(df, group, test_size, seed), "held-out").withColumn("_held", F.lit(True))
    out = df.withColumn("grp", group).join(held, "grp", "left")
    return out.withColumn("split", F.when(F.col("_held"), "test").otherwise("train")).drop("_held")


def split_audit(split_df: DataFrame) -> DataFrame:
    """a row per split (no ``grp``) with rows, groups and ``overlap``, the groups present in both; and a row
    per held-out group."""
    per = split_df.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_distinct("grp").alias("groups"),
    )
    tr = split_df.filter("split = 'train'").select("grp").distinct()
    te = split_df.filter("split = 'test'").select("grp").distinct()
    overlap = te.join(tr, "grp", "left_semi").agg(F.count("*").alias("overlap"))
    totals = per.crossJoin(overlap).select("split", F.lit(None).cast("string").alias("grp"), "rows", "groups", "overlap")
    held = split_df.filter("split = 'test'").groupBy("split", "grp").agg(F.count("*").alias("rows"))
    return totals.unionByName(held.select("split", "grp", "rows", F.lit(1).cast("long").alias("groups"), F.lit(0).cast("long").alias("overlap")))


def logo_folds(df: DataFrame, group_col: str, min_train: int = 3) -> DataFrame:
    """leave-one-group-out fold sizes from per-group counts (fold train = total - group)."""
    per = df.groupBy(group_col).agg(F.count("*").alias("test_rows"))
    tot = df.agg(F.count("*").alias("_total"))
    out = per.crossJoin(tot).withColumn("train_rows", F.col("_total") - F.col("test_rows")).drop("_total")
    return out.withColumn("skipped", F.col("train_rows") < min_train)

