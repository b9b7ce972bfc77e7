"""Nearest historical comparables for many queries at once: an exact top-k similarity join.

score(q, h) = (Δkm/300)² + (Δh/2)² + (Δdays/8)² − 10·exact − 2·reverse − 0.8·airline − 0.5·stops,
history days NULL -> 26; candidates = same (title-cased) class, or the whole history when the
class is absent from it. The k lowest scores per query are returned with a total tie-break.

Exact and scale-safe without comparing every query with every row:

1. *Skew reduction.* Rows with the same scoring tuple (class, route, airline, stops, km, h,
   days) score identically for every query, so only the first k of each tuple (by the
   tie-break) can ever be chosen: a per-tuple ``row_number() <= k`` (partial WindowGroupLimit
   before the shuffle) bounds the history by its *domain*, not its volume. Equal queries are
   asked once and their answer joined back. Both tables are written once.
2. *Corridors.* Queries meet the rows of their own and of the reverse route in one task a corridor (``corridors.py``),
   pruned by cells, and leave with their k best: neither pairs nor (query, cell) rows are written. A corridor with very many rows or
   queries is dealt to several tasks; the answers are joined by their scores.
3. *Other routes.* The k-th best score so far, τ, is an upper bound on the final one. The bonus of a row of any other route is at most
   1.3, so it can only reach τ inside the ball of squared radius τ + 1.3. Scaled coordinates (km/300, h/2, days/8) are
   bucketed into unit cells; the query is exploded over the cells that the ball touches, one dimension after the other, each with
   what the dimensions before leave of the radius, and joined by cell. Where its own route is dense no cell is left, and if no
   query has one, history is not read again. Queries with fewer than k rows so far first get a bound from cells around their
   place (moved to the edge of the occupied grid if it is outside), in widening rings, up to the whole grid.
4. Candidates with a score above τ go at once; ``row_number() <= k`` per query picks the answer.

The exploded (query, cell) rows are dealt by cell, and by salt where they are more than the history, to a fixed number of partitions
before the join, so that neither a small table nor a busy cell decides how many tasks work. Joins of queries with
history and with each other are merge joins: tables that are small as files (10 MB of Parquet) may be
hundreds of MB as a broadcast in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelake.operators import corridors as CO
from farelake.session import written_table

# --- Fixed values (scoring and defaults) ---
SCALE_KM, SCALE_H, SCALE_DAYS = 300.0, 2.0, 8.0
BONUS_EXACT, BONUS_REVERSE, BONUS_AIRLINE, BONUS_STOPS = 10.0, 2.0, 0.8, 0.5
HIST_DAYS_FILL = 26.0
DEFAULT_K = 8
PREDICTION_K = 6
# --- end ---
MAX_BONUS_OTHER = BONUS_AIRLINE + BONUS_STOPS

TIE_BREAK = ["price", "source_city", "destination_city", "airline", "stops", "duration", "days_left", "flight", "departure_time", "arrival_time"]


def _title(c: Column) -> Column:
    return F.initcap(F.trim(c))


def prepare_history(history: DataFrame, k: int) -> DataFrame:
    """History with scoring keys and cells, reduced to k rows per scoring tuple as spelt (skew-proof)."""
    h = history.filter(F.col("price").isNotNull() & (F.col("price") > 0) & F.col("distance_km").isNotNull())
    # the keys are made after the shuffle: only what they are made of moves
    h = h.select(*TIE_BREAK, "class", "distance_km")
    w = Window.partitionBy("class", "source_city", "destination_city", "airline", "stops", "distance_km", "duration", "days_left")
    h = h.withColumn("_t", F.row_number().over(w.orderBy(*[F.col(c).asc_nulls_first() for c in TIE_BREAK]))).filter(F.col("_t") <= k)
    h = h.select(
        *TIE_BREAK,
        _title(F.col("class")).alias("h_class"),
        _title(F.col("source_city")).alias("h_src"),
        _title(F.col("destination_city")).alias("h_dst"),
        F.lower(F.col("airline")).alias("h_airline"),
        F.lower(F.col("stops")).alias("h_stops"),
        F.col("distance_km").alias("h_km"),
        F.coalesce(F.col("days_left"), F.lit(HIST_DAYS_FILL)).alias("h_days"),
    )
    return h.withColumns(
        {
            "cu": F.floor(F.col("h_km") / SCALE_KM),
            "cv": F.floor(F.col("duration") / SCALE_H),
            "cw": F.floor(F.col("h_days") / SCALE_DAYS),
        }
    )


def prepare_queries(queries: DataFrame, hist_classes: list[str], qid: str) -> DataFrame:
    """Title-cased query keys and scaled places; ``pool_class`` is the class, or each history class when absent."""
    q = queries.select(
        F.col(qid).alias("qid"),
        _title(F.coalesce(F.col("class"), F.lit("Economy"))).alias("q_class"),
        _title(F.coalesce(F.col("source_city"), F.lit(""))).alias("q_src"),
        _title(F.coalesce(F.col("destination_city"), F.lit(""))).alias("q_dst"),
        F.lower(F.trim(F.coalesce(F.col("airline"), F.lit("")))).alias("q_airline"),
        F.lower(F.trim(F.coalesce(F.col("stops"), F.lit("zero")))).alias("q_stops"),
        F.coalesce(F.col("distance_km"), F.lit(1000.0)).cast("double").alias("q_km"),
        F.coalesce(F.col("duration"), F.lit(2.0)).cast("double").alias("q_h"),
        F.coalesce(F.col("days_left"), F.lit(15.0)).cast("double").alias("q_days"),
    )
    classes = F.array(*map(F.lit, hist_classes)).cast("array<string>")
    return q.withColumn("pool_class", F.explode(F.when(F.array_contains(classes, F.col("q_class")), F.array("q_class")).otherwise(classes)))


def _placed(q: DataFrame) -> DataFrame:
    return q.withColumns(
        {
            "qu": F.col("q_km") / SCALE_KM,
            "qv": F.col("q_h") / SCALE_H,
            "qw": F.col("q_days") / SCALE_DAYS,
            "q_both": (F.col("q_src") != "") & (F.col("q_dst") != ""),
        }
    )


def _score() -> Column:
    du = (F.col("h_km") - F.col("q_km")) / SCALE_KM
    dv = (F.col("duration") - F.col("q_h")) / SCALE_H
    dw = (F.col("h_days") - F.col("q_days")) / SCALE_DAYS
    exact = F.col("q_both") & (F.col("h_src") == F.col("q_src")) & (F.col("h_dst") == F.col("q_dst"))
    rev = F.col("q_both") & (F.col("h_src") == F.col("q_dst")) & (F.col("h_dst") == F.col("q_src"))
    same_air = F.coalesce(F.col("h_airline") == F.col("q_airline"), F.lit(False))
    same_stops = F.coalesce(F.col("h_stops") == F.col("q_stops"), F.lit(False))
    s = (
        du * du + dv * dv + dw * dw
        - exact.cast("double") * BONUS_EXACT
        - rev.cast("double") * BONUS_REVERSE
        - same_air.cast("double") * BONUS_AIRLINE
        - same_stops.cast("double") * BONUS_STOPS
    )
    return F.round(s, 6)


def _topk(c: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    w = Window.partitionBy(qid).orderBy("score", *[F.col(x).asc_nulls_first() for x in TIE_BREAK])
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Grid:
    """The prepared history by cells, and how (query, cell) rows meet it."""

    def __init__(self, h: DataFrame):
        places = {"u": F.col("h_km") / SCALE_KM, "v": F.col("duration") / SCALE_H, "w": F.col("h_days") / SCALE_DAYS}
        cells = [x for d in "uvw" for x in (F.min(f"c{d}").alias(f"lo_{d}"), F.max(f"c{d}").alias(f"hi_{d}"))]
        ends = h.agg(*cells, *[x for d, at in places.items() for x in (F.min(at).alias(f"min_{d}"), F.max(at).alias(f"max_{d}"))]).first()
        self.ends = {d: (ends[f"lo_{d}"], ends[f"hi_{d}"]) for d in "uvw"}  # of the occupied cells
        self.edges = {d: (ends[f"min_{d}"], ends[f"max_{d}"]) for d in "uvw"}  # of the rows' places
        self.rows = h
        self.partitions = partitions(h)

    def _range(self, d: str, first: Column, last: Column) -> Column:
        """Occupied cells of a dimension from ``first`` to ``last`` (empty if there are none)."""
        lo, hi = self.ends[d]
        a, b = F.greatest(first, F.lit(lo)), F.least(last, F.lit(hi))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    def box(self, q: DataFrame, radius: int) -> DataFrame:
        """Query rows, one for each cell up to ``radius`` cells from their place moved into the grid."""
        for d in "uvw":
            lo, hi = self.ends[d]
            own = F.greatest(F.least(F.floor(f"q{d}"), F.lit(hi)), F.lit(lo))
            q = q.withColumn(f"k_{d}", F.explode(self._range(d, own - radius, own + radius)))
        return q

    def ball(self, q: DataFrame, squared: Column) -> DataFrame:
        """Query rows, one for each cell that may have a row within the squared radius.

        A cell at the edge counts only up to the last row's place: a query far outside (days before departure beyond all of
        history) would else see it as much nearer than any row. Days go first, as most far queries are far there."""
        q = q.withColumn("_left", squared).filter("_left >= 0")
        for d in "wvu":
            low, high = self.edges[d]
            at, reach = F.col(f"q{d}"), F.least(F.sqrt("_left"), F.lit(1e9))
            q = q.withColumn(f"k_{d}", F.explode(self._range(d, F.floor(at - reach), F.floor(at + reach))))
            short = F.greatest(F.greatest(F.col(f"k_{d}"), F.lit(low)) - at, at - F.least(F.col(f"k_{d}") + 1, F.lit(high)), F.lit(0.0))
            q = q.withColumn("_left", F.col("_left") - short * short).filter("_left >= 0")
        return q.drop("_left")

    def meet(self, cells: DataFrame, other: Column | None = None) -> DataFrame:
        """Scored rows of the cells of a written table of queries, those that ``other`` allows."""
        keys = {"pool_class": "h_class", "k_u": "cu", "k_v": "cv", "k_w": "cw"}
        rows = self.rows
        if cells.count() > rows.count():  # counts of files: a cell's queries are dealt to several tasks if there are many
            cells = cells.withColumn("k_salt", F.pmod(F.xxhash64("qkey"), F.lit(SALTS)).cast("int"))
            rows = rows.withColumn("c_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keys |= {"k_salt": "c_salt"}
        dealt = cells.repartition(self.partitions, *keys)
        met = dealt.join(rows.hint("merge"), [F.col(a) == F.col(b) for a, b in keys.items()])
        return (met if other is None else met.filter(other)).withColumn("score", _score())


#: Parts that the queries of a cell are dealt to.
SALTS = 4
#: Rows, and queries, of a corridor beyond which it is dealt to several tasks.
ROWS_A_TASK, QUERIES_A_TASK = 250_000, 100_000


def partitions(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _not_route(src: str, dst: str) -> Column:
    return ~F.coalesce((F.col("h_src") == F.col(src)) & (F.col("h_dst") == F.col(dst)), F.lit(False))


def _ends(of_class: str, src: str, dst: str) -> tuple[Column, Column, Column]:
    """A corridor: the class and the two cities in order."""
    return F.col(of_class).alias("of_class"), F.least(src, dst).alias("end_1"), F.greatest(src, dst).alias("end_2")


def _parts(ends: list[str], busy: dict[int, int]) -> Column:
    """The number of parts of a row's corridor: those of the few busy ones, else 1."""
    at = F.xxhash64(*ends)
    if not busy:
        return F.lit(1)
    table = F.create_map(*(F.lit(x) for item in busy.items() for x in item))
    return F.when(at.isin(*busy), F.try_element_at(table, at)).otherwise(F.lit(1))


def along_corridors(q: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """Scored rows of queries' own and reverse routes, a query's k best among them: (qkey, score, exact, reverse, ..)."""
    ends = ["of_class", "end_1", "end_2"]
    rows = h.filter(F.col("h_src").isNotNull() & F.col("h_dst").isNotNull()).select("*", *_ends("h_class", "h_src", "h_dst"))
    rows = rows.select(*ends, *TIE_BREAK, "h_airline", "h_stops", "h_km", "h_days", (F.col("h_src") == F.col("end_1")).alias("h_forward"))
    asked = q.select("*", *_ends("pool_class", "q_src", "q_dst"))
    asked = asked.withColumns({"q_forward": F.col("q_src") == F.col("end_1"), "q_round": F.col("q_src") == F.col("q_dst")})
    asked = asked.select(*ends, "qkey", "q_airline", "q_stops", "q_km", "q_h", "q_days", "q_both", "q_forward", "q_round")

    def busy(df: DataFrame, most: int) -> dict[int, int]:
        """Corridors beyond ``most`` rows: at most one in ``most`` rows of the table."""
        sizes = df.groupBy(F.xxhash64(*ends).alias("at")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
        return {r["at"]: -(-r["n"] // most) for r in sizes.collect()}

    row_parts, query_parts = _parts(ends, busy(rows, ROWS_A_TASK)), _parts(ends, busy(asked, QUERIES_A_TASK))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda n, key: F.pmod(F.xxhash64(*key), n).cast("int")
    rows = rows.withColumn("row_part", mine(row_parts, TIE_BREAK)).withColumn("query_part", every(query_parts))
    asked = asked.withColumn("query_part", mine(query_parts, ["qkey"])).withColumn("row_part", every(row_parts))
    keys = [*ends, "row_part", "query_part"]
    n = partitions(h)
    kept = [*TIE_BREAK, "h_km"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = "qkey long, raw double, exact boolean, reverse boolean, " + ", ".join(f"{c} {types[c]}" for c in kept)
    nearest = CO.nearest_of(k, (SCALE_KM, SCALE_H, SCALE_DAYS), (BONUS_EXACT, BONUS_REVERSE, BONUS_AIRLINE, BONUS_STOPS), kept)
    found = asked.repartition(n, *keys).groupBy(*keys).cogroup(rows.repartition(n, *keys).groupBy(*keys)).applyInArrow(nearest, schema)
    return found.withColumn("score", F.round("raw", 6)).drop("raw")


def _bounds(q: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(qkey, tau): an upper bound on each query's k-th score (none where the pool has fewer than k rows)."""
    widest = max(hi - lo for lo, hi in grid.ends.values()) + 1
    radius, rest, found = 1, q, None
    while True:
        seeds = grid.meet(written_table(grid.box(rest, radius), "box")).select("qkey", "score")
        nth = F.row_number().over(Window.partitionBy("qkey").orderBy("score"))
        tau = written_table(seeds.withColumn("_n", nth).filter(F.col("_n") == k).select("qkey", F.col("score").alias("tau")), "bounds")
        found = tau if found is None else found.unionByName(tau)
        rest = written_table(rest.join(tau.hint("merge"), "qkey", "left_anti"), "unbounded")
        if radius > widest or not rest.limit(1).count():
            return found
        radius = 4 * radius


def nearest_comparables(queries: DataFrame, history: DataFrame, k: int = DEFAULT_K, qid: str = "request_id") -> DataFrame:
    """The k nearest historical tickets per query (long form, one row per comparable)."""
    h = written_table(prepare_history(history, k), "history")
    classes = [r[0] for r in h.select("h_class").distinct().orderBy("h_class").collect() if r[0] is not None]  # cabin classes
    asked = prepare_queries(queries, classes, qid)
    terms = [c for c in asked.columns if c not in ("qid", "pool_class")]
    same = asked.select(*terms).distinct().withColumn("qkey", F.monotonically_increasing_id())
    same = written_table(same, "queries")
    if not classes:
        return _finish(_topk(_flagged(_placed(asked.withColumn("qkey", F.lit(0))).join(h, F.lit(False)).withColumn("score", _score())), k))
    q = _placed(same.join(asked.select(*terms, "pool_class").distinct().hint("merge"), terms))
    q = written_table(q, "placed")
    top = written_table(_topk(along_corridors(q, h, k), k, "qkey"), "nearest")
    grid = Grid(h)
    tau = top.filter(F.col("rank") == k).select("qkey", F.col("score").alias("tau"))
    few = written_table(q.join(tau.hint("merge"), "qkey", "left_anti"), "few")
    if few.limit(1).count():
        tau = tau.unionByName(_bounds(few, grid, k))
    q = q.join(tau.hint("merge"), "qkey", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
    # squared distance up to tau + bonus (+1e-6 for scores of six decimals): rows outside can neither beat nor tie
    cells = written_table(grid.ball(q, F.col("tau") + MAX_BONUS_OTHER + 1e-6), "cells")
    if cells.limit(1).count():
        others = grid.meet(cells, _not_route("q_src", "q_dst") & _not_route("q_dst", "q_src")).filter("score <= tau")
        top = _topk(top.drop("rank").unionByName(_flagged(others).select(*(c for c in top.columns if c != "rank"))), k, "qkey")
    names = asked.select("qid", *terms).distinct().join(same.hint("merge"), terms).select("qid", "qkey")
    return _finish(top.join(names.hint("merge"), "qkey"))


def _flagged(scored: DataFrame) -> DataFrame:
    """Scored rows with what a row is to its query: on its route, on the reverse one."""
    return scored.withColumns(
        {
            "exact": F.col("q_both") & (F.col("h_src") == F.col("q_src")) & (F.col("h_dst") == F.col("q_dst")),
            "reverse": F.col("q_both") & (F.col("h_src") == F.col("q_dst")) & (F.col("h_dst") == F.col("q_src")),
        }
    )


def _finish(top: DataFrame) -> DataFrame:
    return top.select(
        "qid",
        F.col("rank").cast("long").alias("rank"),
        "score",
        _title(F.col("source_city")).alias("source_city"),
        _title(F.col("destination_city")).alias("destination_city"),
        "airline",
        "stops",
        F.round("duration", 2).alias("duration"),
        F.col("days_left").cast("long").alias("days_left"),
        F.round("h_km", 1).alias("distance_km"),
        "price",
        F.when(F.col("exact"), "exact_route").when(F.col("reverse"), "reverse_route").otherwise("similar_corridor").alias("match_type"),
    )


def brute_force_comparables(queries: DataFrame, history: DataFrame, k: int = DEFAULT_K, qid: str = "request_id") -> DataFrame:
    """Reference implementation for tests: every query against its whole class pool."""
    h = prepare_history(history, k)
    q = _placed(prepare_queries(queries, [r[0] for r in h.select("h_class").distinct().collect()], qid))
    c = q.join(h, q["pool_class"] == h["h_class"]).withColumn("score", _score())
    return _finish(_topk(_flagged(c), k))


def summarize(comps: DataFrame, queries: DataFrame, qid: str = "request_id") -> DataFrame:
    """Count, median, mean, min, max (rounded 2) and the route-match verdict per query.

    Left join from the queries so a query without any comparable still yields a row (count 0).
    """
    s = comps.groupBy("qid").agg(
        F.count("*").alias("count"),
        F.round(F.median("price"), 2).alias("median"),
        F.round(F.avg(F.col("price").cast("decimal(24,6)")), 2).cast("double").alias("mean"),  # exact, so no order of rows shows
        F.round(F.min("price"), 2).alias("min"),
        F.round(F.max("price"), 2).alias("max"),
        F.bool_and(F.col("match_type") == "exact_route").alias("_all_exact"),
    )
    out = queries.select(F.col(qid).alias("qid")).join(s, "qid", "left")
    return out.select(
        "qid",
        F.coalesce("count", F.lit(0)).alias("count"),
        "median", "mean", "min", "max",
        F.when(F.coalesce("_all_exact", F.lit(False)), "exact_directional").otherwise("corridor_fallback").alias("route_match"),
    )


def rule_based(history: DataFrame, airline: str = "Indigo", cls: str = "Economy", stops: str = "zero", max_km: float = 550.0) -> DataFrame:
    """I8: rule filter (distance, airline, class, stops), then the 12..18-day window, per route."""
    base = history.filter(
        (F.col("distance_km") <= max_km) & (F.col("airline") == airline) & (F.col("class") == cls) & (F.col("stops") == stops)
    )
    win = base.filter((F.col("days_left") >= 12) & (F.col("days_left") <= 18))
    per = base.groupBy("source_city", "destination_city").agg(
        F.count("*").alias("rows"),
        F.round(F.avg("distance_km"), 2).alias("mean_km"),
        F.round(F.avg("duration"), 4).alias("mean_duration"),
        F.round(F.avg("price"), 2).alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )
    w = win.groupBy("source_city", "destination_city").agg(F.count("*").alias("rows_12_18"))
    return per.join(w, ["source_city", "destination_city"], "left").fillna(0, ["rows_12_18"])
