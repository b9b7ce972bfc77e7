"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Size is a document's words. Each source's target is its share of all words by weight, never above
``REPEATS`` times its own size; what is cut off is shared again by weight. A source's documents are dealt
to shards of about ``SHARD_ROWS`` rows and put in a seeded order; a shard's word stream is cut into blocks of equal
length (the last may be shorter). Blocks go to sources by highest quotients, votes / (2 seats + 1), then a source's
blocks go to its shards the same way: an integer quota per shard. A quota of q blocks out of n is q div n whole
passes and q mod n blocks at evenly spaced places from a seeded start in the seeded order. Everything
from there on is arithmetic on a document's offset, so no block is ever a row.

Apportionment works on one row per source and one per shard, both kept in tables that Spark broadcasts only if
they are small. Documents move once, by (source, shard); a source with a third of all rows is many shards.

Defined results: null and empty texts have size 0 and nothing is taken of them; the null source is a source of its
own, last in order; equal rows are documents of their own; an empty table gives an empty result; extra columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.llm.tables import stored

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK_WORDS = 1024
MIN_BLOCKS = 256
SHARD_ROWS = 4096
SEED = 20240229
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` (source, source_size, rows) with place (by code point, null last, from 0), weight and target.

    The water level is the largest of the levels that hold if the sources with the lowest caps per weight, one
    more each time, stand at their caps. One row a source, so its windows stay small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("place", F.lit(len(WEIGHTS))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest, everything = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = F.max("level").over(everything)
    leveled = ranked.withColumn("level", left / F.sum("weight").over(rest))
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("level", "cap")


def highest_averages(claims: DataFrame, group: list[str], key: str, votes: str, seats: str, most: str) -> DataFrame:
    """Sainte-Laguë: ``claims`` with ``quota``, the seats that each ``key`` gets of its group's ``seats`` (``most`` at most).

    Quotas rounded at a divisor that cannot give too many seats are a state that highest averages passes
    through; from there the remaining seats, no more than the group has rows, go to the highest quotients.
    """
    of_group = Window.partitionBy(*group)
    total, rows = F.sum(votes).over(of_group), F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(of_group)
    share = F.col(votes) / F.col("_total")
    state = claims.withColumns({"_total": total, "_rows": rows}).withColumns({
        "_low": F.least(most, F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_rows") / 2) + 0.5))).otherwise(0)),
        "_high": F.least(F.col(most) - 1, F.when(F.col(votes) > 0, F.floor(share * (F.col(seats) + F.col("_rows") / 2) + 0.5)).otherwise(-1)),
    })
    state = state.withColumn("_free", F.col(seats) - F.sum("_low").over(of_group))
    offers = state.where("_high >= _low").select(*group, key, "_free", F.col(votes).alias("_votes"), F.explode(F.sequence("_low", "_high")).alias("_seat"))
    best = Window.partitionBy(*group).orderBy((F.col("_votes") / (2 * F.col("_seat") + 1)).desc(), key, "_seat")
    won = offers.withColumn("_rank", F.row_number().over(best)).where("_rank <= _free").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_won"))
    out = state.join(won, [*group, key], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_total", "_rows", "_low", "_high", "_free", "_won")


def plan(sized: DataFrame, shard_rows: int = SHARD_ROWS, block: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From (key, source, size) rows: a row per source, and a row per (place, shard) with words, length (of a
    block), blocks, quota and start."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = stored(targets(sizes).withColumn("shards", F.ceil(F.col("rows") / shard_rows)), "sources")
    dealt = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("place", _shard(seed).alias("shard"), "size")
    shards = dealt.groupBy("place", "shard").agg(F.sum("size").alias("words"))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"words div {MIN_BLOCKS}")))
    shards = shards.withColumn("length", length).withColumn("blocks", F.ceil(F.col("words") / F.col("length")))
    shards = stored(shards, "shards")
    of_source = shards.groupBy("place").agg(F.sum("blocks").alias("all_blocks")).join(sources.select("place", "source_size", "target"), "place")
    claim = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("all_blocks")).otherwise(0.0)
    of_source = of_source.select("place", claim.alias("claim"), (F.col("all_blocks") * REPEATS).alias("most"), F.lit(0).alias("everyone"))
    of_source = of_source.withColumn("seats", F.round(F.sum("claim").over(Window.partitionBy("everyone"))).cast("long"))
    quotas = highest_averages(of_source, ["everyone"], "place", "claim", "seats", "most").select("place", F.col("quota").alias("seats"))
    claims = shards.join(stored(quotas, "quotas"), "place").withColumn("most", F.col("blocks") * REPEATS)
    given = highest_averages(claims, ["place"], "shard", "blocks", "seats", "most")
    start = F.pmod(F.xxhash64("place", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1)))
    return sources, stored(given.select("place", "shard", "words", "length", "blocks", "quota", start.alias("start")), "shard_quotas")


def _shard(seed: int) -> Column:
    """By key and text: an id that many rows have, or rows without one, fall into many shards."""
    return F.pmod(F.xxhash64("key", "stamp", F.lit(seed)), F.col("shards"))


def _before(at: str) -> Column:
    """Words of the chosen blocks of a pass before the offset ``at`` of the shard."""
    extra = "(quota - quota div greatest(blocks, 1) * blocks)"
    chosen = f"((({at}) div length * {extra} + start) div greatest(blocks, 1))"
    here = f"((({at}) div length * {extra} + {extra} + start) div greatest(blocks, 1) - {chosen})"
    return F.expr(f"{chosen} * length + CASE WHEN ({at}) div length < blocks THEN {here} * (({at}) - ({at}) div length * length) ELSE 0 END")


def mixed(rows: DataFrame, sources: DataFrame, quotas: DataFrame, key: str, source: str, size: str, stamp: str, prefix: str = "", seed: int = SEED) -> DataFrame:
    """``rows`` (``stamp``: a hash of their texts, as in the plan) with source_size, target, taken (words the mix takes of the row, repeats counted) and
    copies (times that the row's first word is taken), each named with ``prefix``."""
    names = rows.columns
    p = lambda name: F.col(f"_row.{name}")
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    packed = packed.select("_row", F.col(f"_row.`{key}`").alias("key"), F.col(f"_row.`{source}`").alias("of"), F.col(f"_row.`{size}`").alias("size"), F.col(f"_row.`{stamp}`").alias("stamp"))
    dealt = packed.join(sources, packed["of"].eqNullSafe(sources["source"])).select("_row", "key", "size", "stamp", "place", "source_size", "target", _shard(seed).alias("shard"))
    order = Window.partitionBy("place", "shard").orderBy(F.xxhash64("key", "stamp", F.lit(seed + 1)), "key", "size", "stamp")
    at = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("at", at).join(quotas, ["place", "shard"])
    passes = F.expr("quota div greatest(blocks, 1)")
    taken = passes * F.col("size") + _before("at + size") - _before("at")
    # the block of the first word: its share of the pass is 0 or 1
    copies = passes + F.when(F.col("size") > 0, _before("at + 1") - _before("at")).otherwise(0)
    made = {"source_size": F.col("source_size"), "target": F.col("target"), "taken": taken, "copies": copies}
    return placed.select(*(p(f"`{c}`").alias(c) for c in names), *(v.cast("double" if k == "target" else "long").alias(prefix + k) for k, v in made.items()))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: key, size, source_size, target, taken, copies."""
    sized = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("stamp")), "sized")
    sources, quotas = plan(sized)
    out = mixed(sized, sources, quotas, "key", "source", "size", "stamp")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "copies")


def resampled(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents themselves, each row as often as its first word is taken: whole texts, all columns as they
    are. A source's words then are its target give or take the documents that lie over block edges."""
    sized = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("stamp")), "sized")
    sources, quotas = plan(sized)
    prefix = "_mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    sized_docs = docs.withColumns({f"{prefix}size": word_count(text), f"{prefix}stamp": F.xxhash64(text)})
    rows = mixed(sized_docs, sources, quotas, key, source, f"{prefix}size", f"{prefix}stamp", prefix)
    repeated = rows.where(F.col(f"{prefix}copies") > 0).withColumn(f"{prefix}n", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies"))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
