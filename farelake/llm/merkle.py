"""Merkle manifest of a dataset, and proofs by Octopus multiproofs.

Every row is a leaf: a hash of its fields. The leaves of a part (a value of one column) ascend by key; every two
consecutive nodes of a level become their hash (a lone last node becomes the hash of itself) until one is left, the
part's root. The part roots, ordered by part, make the top tree in the same way.

Positions come from ranges: rows are sorted into ranges by part and key, a range's counts give its first
positions. Trees are built in layers of ``LAYER`` levels: a group of 2 ** LAYER consecutive nodes makes all
nodes above it up to the next layer, so no task holds more, whatever the size of a part.

Proofs of any rows are made a leaf partition at a time (the rows of one group of leaves). It works out which nodes its
rows cannot derive from each other: level by level, the siblings that are not among its own nodes, each once (the
minimal union of all its rows' paths). Those are fetched in one join. Then it derives the interiors that its rows share,
each once, and reads every row's own proof off them.

Defined results: a null field counts as ``-``, anything else as its UTF-8 length, a colon and itself; a null part is a
part of its own, before all others; null keys come first; rows with equal keys are ordered by their leaf (equal rows are
leaves of their own); an empty table has no nodes. Extra columns are ignored unless named as fields.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.llm.tables import stored

#: Levels that one task builds: it holds 2 ** LAYER nodes and those above them.
LAYER = 12
TOP = "top"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The hash of fields (strings or whole numbers) that tells null, empty and joined values apart."""
    written = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*written), 256)


def depth_of(n: int) -> int:
    """Levels above ``n`` nodes."""
    return max(0, n - 1).bit_length()


def size_at(n: int, level: int) -> int:
    """Nodes at a level above ``n`` leaves."""
    return -(-n >> level)


def _tree_of(part: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), part.cast("string")), F.lit("-"))


def positions(rows: DataFrame, part: str, order: list[str], what: str) -> DataFrame:
    """The rows, written once, with pos (from 0, within the part, by ``order``) and n (rows of the part)."""
    kept = rows.columns
    # the row's own number splits even a run of equal rows into ranges
    ranges = rows.repartitionByRange(part, *order, "row").sortWithinPartitions(part, *order, "row")
    ranges = stored(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), what)
    runs = ranges.groupBy(F.col(part).alias("_p"), F.col("_range").alias("_r")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    in_part = Window.partitionBy("_p")
    before = F.coalesce(F.sum("_rows").over(in_part.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_p", "_r", "_first", before.alias("_before"), F.sum("_rows").over(in_part).alias("n"))
    placed = ranges.join(runs, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")))
    return placed.select(*kept, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n")


def _layer(nodes: DataFrame, levels: int) -> DataFrame:
    """All nodes above ``nodes`` (tree, n leaves, level, pos, hash: whole levels of their trees), so many levels up."""

    def build(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("pos").to_pylist(), group.column("hash").to_pylist()))
        tree, n, level = (group.column(c)[0].as_py() for c in ("tree", "n", "level"))
        first, hashes = rows[0][0], [h for _, h in rows]
        out = {"level": [], "pos": [], "hash": []}
        for up in range(level + 1, min(level + levels, depth_of(n)) + 1):
            hashes, first = [digest(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)], first >> 1
            out["level"] += [up] * len(hashes)
            out["pos"] += range(first, first + len(hashes))
            out["hash"] += hashes
        k = len(out["pos"])
        return pa.table({"tree": pa.array([tree] * k, pa.string()), "n": pa.array([n] * k, pa.int64()), "level": pa.array(out["level"], pa.int32()), "pos": pa.array(out["pos"], pa.int64()), "hash": pa.array(out["hash"], pa.string())})

    groups = nodes.withColumn("_group", F.shiftright("pos", levels)).groupBy("tree", "_group")
    return groups.applyInArrow(build, "tree string, n long, level int, pos long, hash string")


def trees(leaves: DataFrame, what: str, levels: int = LAYER) -> DataFrame:
    """All nodes of all trees: (tree, n, level, pos, hash), from leaves (tree, n, pos, hash)."""
    done = layer = leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "hash")
    level, most = 0, leaves.agg(F.max("n")).first()[0] or 0
    while level < depth_of(most):
        layer = stored(_layer(layer, levels), f"{what}_{level}")
        done = done.unionByName(layer)
        level += levels
        layer = layer.where((F.col("level") == level) & (F.col("n") > (1 << level)))
    return done


class Manifest:
    """The leaves (the given columns, leaf, tree, pos, n, top_pos, n_top, subroot) and nodes of a dataset."""

    def __init__(self, leaves: DataFrame, nodes: DataFrame, levels: int):
        self.leaves, self.nodes, self.levels = leaves, nodes, levels


def manifest(rows: DataFrame, key: str, part: str, leaf: Column, levels: int = LAYER, **kept: Column) -> Manifest:
    """Trees over ``rows``. ``leaf`` is an expression over their columns; so are the further columns ``kept`` with
    the leaves. A task builds so many ``levels`` at a time."""
    chosen = rows.select(F.col(key).alias("key"), F.col(part).alias("part"), leaf.alias("leaf"), *(c.alias(n) for n, c in kept.items()))
    chosen = stored(chosen.withColumn("row", F.monotonically_increasing_id()), "leaf_rows")
    leaves = positions(chosen, "part", ["key", "leaf"], "leaf_ranges").withColumn("tree", _tree_of(F.col("part"))).drop("row")
    leaves = stored(leaves, "leaves")
    nodes = trees(leaves.withColumnRenamed("leaf", "hash"), "nodes", levels)
    subroots = nodes.where((F.col("pos") == 0) & (_depth("n") == F.col("level")))
    subroots = subroots.select("tree", F.col("hash").alias("subroot")).join(leaves.where("pos = 0").select("tree", "part"), "tree")
    tops = positions(stored(subroots.withColumn("row", F.monotonically_increasing_id()).withColumn("all", F.lit(TOP)), "subroots"), "all", ["part"], "subroot_ranges")
    tops = stored(tops.select("tree", "subroot", F.col("pos").alias("top_pos"), F.col("n").alias("n_top")), "tops")
    top = trees(tops.select(F.lit(TOP).alias("tree"), F.col("n_top").alias("n"), F.col("top_pos").alias("pos"), F.col("subroot").alias("hash")), "top", levels)
    return Manifest(leaves.join(tops, "tree"), nodes.unionByName(top), levels)


def _depth(n: str) -> Column:
    """depth_of as a column: digits of n - 1 in binary."""
    return F.when(F.col(n) <= 1, 0).otherwise(F.length(F.bin(F.col(n) - 1)))


def missing(targets: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The minimal set of (level, pos) that, with the leaves at ``targets``, gives all their paths in a tree of ``n`` leaves."""
    now, out = sorted(set(targets)), []
    for level in range(depth_of(n)):
        own, size = set(now), size_at(n, level)
        out += [(level, s) for s in dict.fromkeys(p ^ 1 for p in now) if s < size and s not in own]
        now = list(dict.fromkeys(p >> 1 for p in now))
    return out


def derived(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> dict[tuple[int, int], str]:
    """All nodes on the paths of ``leaves`` and beside them, each hashed once."""
    known = dict(fetched) | {(0, p): h for p, h in leaves.items()}
    now = sorted(leaves)
    for level in range(depth_of(n)):
        size = size_at(n, level)
        now = list(dict.fromkeys(p >> 1 for p in now))
        for p in now:
            known[level + 1, p] = digest(*(known[level, c] for c in (2 * p, 2 * p + 1) if c < size))
    return known


def path(pos: int, n: int) -> Iterator[tuple[int, int, bool]]:
    """(level, sibling's position, whether there is one) from a leaf to the root."""
    for level in range(depth_of(n)):
        yield level, pos ^ 1, (pos ^ 1) < size_at(n, level)
        pos >>= 1


def fold(leaf: str, proof: list[str], pos: int, n: int, top_pos: int, n_top: int) -> str:
    """The root that a leaf and its siblings give."""
    siblings, node = iter(proof), leaf
    for at, size in ((pos, n), (top_pos, n_top)):
        for _, sibling, there in path(at, size):
            node = digest(node) if not there else digest(node, next(siblings)) if at % 2 == 0 else digest(next(siblings), node)
            at >>= 1
    return node


def proofs(of: Manifest, targets: DataFrame) -> DataFrame:
    """``targets`` (rows of ``of.leaves``) with proof: an array of siblings, from the leaf up to the root, and root."""
    names, column_types = targets.columns, {f.name: f.dataType.simpleString() for f in targets.schema}
    grouped = targets.withColumn("_group", F.shiftright("pos", of.levels))

    def wanted(group: pa.Table) -> pa.Table:
        n, top_pos, n_top = (group.column(c)[0].as_py() for c in ("n", "top_pos", "n_top"))
        tree, number = (group.column(c)[0].as_py() for c in ("tree", "_group"))
        own = missing(group.column("pos").to_pylist(), n)
        top = [*missing([top_pos], n_top), (depth_of(n_top), 0)]  # the root, to hold the derived one against
        out = [(tree, number, tree, *c) for c in own] + [(tree, number, TOP, *c) for c in top]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], ["leaf_tree", "leaf_group", "tree", "level", "pos"])

    asked = stored(grouped.select("tree", "_group", "pos", "n", "top_pos", "n_top").groupBy("tree", "_group").applyInArrow(wanted, "leaf_tree string, leaf_group long, tree string, level int, pos long"), "coordinates")
    # only the layers that somebody asks for are read; if all rows of a group are asked for, its own layer is not
    layers = [r[0] for r in asked.groupBy(F.floor(F.col("level") / of.levels).alias("layer")).count().collect()]  # one row a layer
    here = F.floor(F.col("level") / of.levels).isin(layers or [0])
    fetched = asked.where(here).join(of.nodes.where(here).select("tree", "level", "pos", "hash"), ["tree", "level", "pos"])
    fetched = fetched.select(F.col("leaf_tree").alias("tree"), F.col("leaf_group").alias("_group"), (F.col("tree") == TOP).alias("top"), "level", "pos", "hash")

    def expand(own: pa.Table, got: pa.Table) -> pa.Table:
        n, top_pos, n_top = (own.column(c)[0].as_py() for c in ("n", "top_pos", "n_top"))
        pos = own.column("pos").to_pylist()
        have = {True: {}, False: {}}
        for top, level, at, h in zip(*(got.column(c).to_pylist() for c in ("top", "level", "pos", "hash"))):
            have[top][level, at] = h
        root = have[True][depth_of(n_top), 0]
        low = derived(dict(zip(pos, own.column("leaf").to_pylist())), have[False], n)
        high = derived({top_pos: low[depth_of(n), 0]}, have[True], n_top)
        if high[depth_of(n_top), 0] != root:
            raise ValueError(f"leaves of {own.column('tree')[0]} do not give the manifest's root")
        above = [high[level, s] for level, s, there in path(top_pos, n_top) if there]
        each = [[low[level, s] for level, s, there in path(p, n) if there] + above for p in pos]
        return own.select(names).append_column("proof", pa.array(each, pa.list_(pa.string()))).append_column("root", pa.array([root] * len(pos), pa.string()))

    schema = ", ".join(f"`{c}` {column_types[c]}" for c in names)
    return grouped.groupBy("tree", "_group").cogroup(fetched.groupBy("tree", "_group")).applyInArrow(expand, f"{schema}, proof array<string>, root string")


def checked(proven: DataFrame, shown: str = "leaf") -> DataFrame:
    """Proven rows with folded_root, which the leaf in column ``shown`` and the row's proof give, and the proof's hash in
    place of the proof."""
    names = [c for c in proven.columns if c != "proof"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof = batch.column("proof").to_pylist()
            where = zip(*(batch.column(c).to_pylist() for c in (shown, "pos", "n", "top_pos", "n_top")))
            folded = [fold(leaf, p, *at) for p, (leaf, *at) in zip(proof, where)]
            columns = [batch.column(c) for c in names] + [pa.array(folded, pa.string()), pa.array([digest(*p) for p in proof], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "folded_root", "proof_sha256"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proven.schema if f.name in names)
    return proven.mapInArrow(work, f"{schema}, folded_root string, proof_sha256 string")
