"""Near-duplicates: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidate edges.

A text's set is its distinct k-word shingles (A-Z folded; a shorter text is one shingle of all its words; a
text without words has an empty set and is linked with nothing). Steps:

1. One pass over the texts gives each set two 64-bit keys, its size and its band hashes. One permutation serves all
   bins: the top bits of a shingle's hash choose the bin, the least hash in the bin is its value. An empty bin
   copies the bin that its own fixed probing sequence meets first (optimal densification).
2. Equal sets collapse to one *node*, named by the first key (or, where the second tells sets with one first key apart,
   by a hash of both), before anything is joined, so exact copies never meet each other.
3. Nodes sharing a band bucket are candidates. Shingles that no other candidate has cannot be shared, so a node
   with c shingles that others have too is in no pair with an intersection above c; nodes and pairs that this
   exact bound rules out are dropped before anything is emitted. A bucket of n nodes does not emit its pairs: a
   centre is chosen and joined to the other members (a star), candidates are confirmed on full sets, and
   confirmed links merge components; a second round does the same with two centres. What is then still open (members
   of one bucket, in different components, not ruled out) is compared in blocks inside tasks, on full sets too, so
   stars lose no link that the bands found.
4. Components come from min-label propagation over the confirmed links.

With 32 bands of 4 values a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.

Defined results: null text counts as no words; repeated rows share a node and a component; ``component_id``
is the smallest non-null key among the rows of the component (null if all are null); extra columns are ignored.
Two different sets share a node only if both their 64-bit keys collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from farelake.llm.tables import stored
from farelake.llm.text_arrays import Texts, chunks, grams, inside, mix

BANDS, ROWS = 32, 4
#: Rounds of stars, each with twice the centres of the one before, and the size of a block of what they leave open:
#: shingles, and nodes, as two blocks are compared in matrices of all their nodes.
STAR_ROUNDS = 2
BLOCK_SHINGLES = 1 << 17
BLOCK_NODES = 1 << 11
BINS = BANDS * ROWS
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), sorted by row and hash, without repeats."""
    h = texts.hashes(lower=True)
    n = texts.n_words
    g = grams(h, k)
    at = np.flatnonzero(inside(texts.bounds, len(g), k))
    rows, keys = texts.row_of_word[at], g[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = n[short].astype(np.uint64)  # the number of words keeps them apart from k-word shingles
        for j in range(k - 1):
            has = n[short] > j
            whole[has] = mix(whole[has] * np.uint64(0x2545F4914F6CDD1D) + h[texts.bounds[:-1][short][has] + j])
        rows, keys = np.concatenate((rows, short)), np.concatenate((keys, whole))
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
        rows, keys = rows[new], keys[new]
    return rows, keys


def set_keys(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit keys of each row's set: sums of members remixed in two ways, mixed with the size."""
    at = np.searchsorted(rows, np.arange(n + 1))
    size = mix(np.diff(at).astype(np.uint64))
    out = np.empty((2, n), np.uint64)
    for i, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        total = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mix(keys ^ np.uint64(salt)), out=total[1:])
        out[i] = mix((total[at[1:]] - total[at[:-1]]) ^ size)
    return out


def signatures(rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """n x BINS values; rows whose set is empty keep zeros."""
    bins = (keys >> _BIN_SHIFT).astype(np.int64)
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (bins[1:] != bins[:-1])  # least hash of its bin: keys are sorted
    values, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    values[rows[first], bins[first]] = keys[first]
    full[rows[first], bins[first]] = True
    r, b = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(r):  # each empty bin probes bins in an order of its own until it meets a full one
        probe = mix(b.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt + 1)) % np.uint64(BINS)
        probe = probe.astype(np.int64) if attempt < 64 * BINS else (b + attempt) % BINS
        hit = full[r, probe]
        values[r[hit], b[hit]] = values[r[hit], probe[hit]]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return values


def band_hashes(values: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(values), 1))
    cells = values.reshape(len(values), BANDS, ROWS)
    for j in range(ROWS):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + cells[:, :, j])
    return out


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """key, stamp (a hash of the text, to find the row again), n_shingles, node (null for an empty set) and
    bands, a list of band hashes."""
    cols = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("stamp"))
    key_type = cols.schema["key"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(1)):
                rows, keys = shingle_sets(texts, k)
                n = b - a
                size = np.bincount(rows, minlength=n)
                bands = band_hashes(signatures(rows, keys, n)).view(np.int64)
                some = size > 0
                node, check = set_keys(rows, keys, n).view(np.int64)
                at = np.concatenate(([0], np.cumsum(np.where(some, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).slice(a, n),
                    "stamp": batch.column(2).slice(a, n),
                    "n_shingles": pa.array(size.astype(np.int64)),
                    "node": pa.array(node, mask=~some),
                    "check": pa.array(check, mask=~some),
                    "bands": pa.ListArray.from_arrays(pa.array(at), pa.array(bands[some].ravel())),
                })

    return cols.mapInArrow(sketch, f"key {key_type}, stamp long, n_shingles long, node long, check long, bands array<long>")


def apart(sig: DataFrame) -> DataFrame:
    """``sig`` in which sets with one node but different second keys are nodes of their own (as good as never needed, so
    it is looked up first, on the keys alone)."""
    seen = sig.where("node is not null").groupBy("node").agg(F.min("check").alias("_least"), F.max("check").alias("_most"))
    clashes = stored(seen.where("_least <> _most").select("node", "_least"), "clashes")
    if not clashes.limit(1).count():
        return sig
    other = F.coalesce(F.col("check") != F.col("_least"), F.lit(False))
    named = F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))
    return stored(sig.join(clashes, "node", "left").withColumn("node", named).select(sig.columns), "sketches")


def full_sets(texts_of_nodes: DataFrame, k: int) -> DataFrame:
    """node and its sorted shingle hashes, from (node, text, check) rows whose text may be another set's."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(1)):
                rows, keys = shingle_sets(texts, k)
                at = np.searchsorted(rows, np.arange(b - a + 1))
                node, want = (batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i in (0, 2))
                own = set_keys(rows, keys, b - a)[1].view(np.int64) == want
                ends = np.concatenate(([0], np.cumsum(np.diff(at)[own]))).astype(np.int32)
                members = keys[np.repeat(own, np.diff(at))].view(np.int64)
                yield pa.RecordBatch.from_pydict({"node": pa.array(node[own]), "members": pa.ListArray.from_arrays(pa.array(ends), pa.array(members))})

    return texts_of_nodes.mapInArrow(make, "node long, members array<long>")


def shared_counts(sets: DataFrame) -> DataFrame:
    """node and shared: how many of its shingles another node has too."""
    each = sets.select("node", F.explode("members").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return sets.select("node", F.size("members").alias("n")).join(alone, "node", "left").select("node", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| on full sets."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            (x_at, x_all), (y_at, y_all) = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in batch.columns[2:])
            for i in range(len(batch)):
                x, y = x_all[x_at[i] : x_at[i + 1]], y_all[y_at[i] : y_at[i + 1]]
                at = np.searchsorted(x, y)
                common = np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(ok))

    return both.mapInArrow(test, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of the links (a, b): comp is the least node reachable. Alternating large and
    small stars; each step is a partial aggregate and a join, so no vertex's neighbours are gathered in a row."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # the edges are stars when no vertex has two parents and no parent has one
        split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        nested = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", F.lit(0).alias("n"))
        if not split.unionByName(nested).limit(1).count():
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable over links of at
    least ``percent`` % similarity, itself included) and kept (key = component_id)."""
    found = _found(docs, key, text, k, percent)
    return found.select(F.col("key").alias(key), "n_shingles", "component_id", "kept")


def _found(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    sig = apart(stored(sketches(docs, key, text, k), "sketches"))
    nodes = sig.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    members = stored(buckets.join(shared, "bucket").select("bucket", "node", "n", F.col("node").alias("comp")), "members")

    labels = None  # (node, comp) of every node that has a link
    if members.limit(1).count():
        one_row = sig.where("node is not null").groupBy("node").agg(F.min(F.struct("key", "stamp", "check")).alias("r")).select("node", F.col("r.key").alias("_key"), F.col("r.stamp").alias("_stamp"), F.col("r.check").alias("check"))
        wanted = members.select("node").distinct().join(one_row, "node")
        rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("stamp"))
        texts = rows.join(wanted, rows["key"].eqNullSafe(wanted["_key"]) & (rows["stamp"] == wanted["_stamp"]))
        sets = stored(full_sets(texts.select("node", "text", "check"), k).groupBy("node").agg(F.first("members").alias("members")), "sets")
        common = stored(shared_counts(sets), "shared")
        members = stored(_open(members.join(common, "node"), percent), "members")
        for round_ in range(STAR_ROUNDS):
            slot = F.pmod(F.xxhash64("node", "bucket", F.lit(round_)), F.lit(1 << round_))
            centres = members.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", "bucket"), "node", "n", "shared", "comp")).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.shared").alias("centre_shared"), F.col("c.comp").alias("centre_comp"))
            most = "least(n, centre_n, shared, centre_shared)"  # of the intersection
            stars = members.join(centres, "bucket").where(f"comp <> centre_comp and 100 * {most} >= {percent} * (n + centre_n - {most})")
            pairs = stored(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "pairs")
            labels = _merged(labels, stored(_confirm(pairs, sets, percent), "links"))
            # centres have met everyone in their bucket
            rest = _labelled(members, labels).join(centres.select("bucket", F.col("centre").alias("node")), ["bucket", "node"], "left_anti")
            members = stored(_open(rest, percent), "members")
        labels = _merged(labels, stored(_confirm_blocks(members, sets, percent), "links"))

    out = sig.select("key", "stamp", "n_shingles", "node")
    per_node = out.where("node is not null").groupBy("node").agg(F.min("key").alias("least"))
    if labels is not None:
        per_node = per_node.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        per_comp = per_node.groupBy("comp").agg(F.min("least").alias("component"))
        per_node = per_node.join(per_comp, "comp").select("node", F.col("component").alias("least"), "comp")
    else:
        per_node = per_node.withColumn("comp", F.col("node"))
    joined = out.join(per_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least")))
    return joined.select("key", "stamp", "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"), "comp")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members
    return members.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(members: DataFrame, percent: int) -> DataFrame:
    """The members that may still link to another component in their bucket: buckets of one component are done, and
    so is a node whose best possible partner there, a set of the bucket's least size or within the node's
    shared shingles, is too far."""
    buckets = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("n_least"), F.sum("n").alias("weight"), F.count(F.lit(1)).alias("nodes")).where("lo < hi")
    best = f"100 * shared >= {percent} * (n + greatest(n_least, shared) - shared)"
    return members.select("bucket", "node", "n", "shared", "comp").join(buckets, "bucket").where(best).select("bucket", "node", "n", "shared", "comp", "weight", "nodes")


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after new links; nodes of one component act as one vertex."""
    if not links.limit(1).count():
        return labels
    if labels is None:
        return stored(components(links), "labels")
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    merged = stored(components(links.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))), "merged")
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(moved.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "labels")


def _cuts() -> Column:
    """Into how many blocks a bucket of ``weight`` shingles and ``nodes`` nodes is cut."""
    return F.greatest(F.ceil(F.col("weight") / BLOCK_SHINGLES), F.ceil(F.col("nodes") / BLOCK_NODES)).cast("int")


def _confirm_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside the buckets that stars have left open. A bucket is cut into blocks of about
    BLOCK_SHINGLES, or of about BLOCK_NODES if that is less, and each two of its blocks are compared in one task by counting common shingles; no pair becomes
    a row, and of the links between two components one is returned."""
    cuts = _cuts()
    block = F.pmod(F.xxhash64("node"), cuts).cast("int")
    blocks = members.withColumns({"cuts": cuts, "block": block})
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")
    dealt = blocks.select("bucket", "node", "comp", "block", other).select("bucket", "node", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")

    def compare(table: pa.Table) -> pa.Table:
        node, comp, block = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
        lists = table.column("members").combine_chunks()
        linked = _linked(lists.offsets.to_numpy(), lists.values.to_numpy(), percent)
        linked &= comp[:, None] < comp[None]
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            linked &= block[:, None] != block[None]
        a, b = np.nonzero(linked)
        _, first = np.unique(np.stack((comp[a], comp[b])), axis=1, return_index=True)
        return pa.table({"a": node[a[first]], "b": node[b[first]]})

    rows = dealt.join(sets.select("node", "members"), "node")
    return rows.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def _linked(at: np.ndarray, shingles: np.ndarray, percent: int, step: int = 2048, rows: int = 512) -> np.ndarray:
    """Which two of the sets shingles[at[i]:at[i + 1]] are linked, by products of 0-1 matrices ``step`` shingles wide,
    ``rows`` sets at a time."""
    n = np.diff(at)
    values, column = np.unique(shingles[at[0] : at[-1]], return_inverse=True)
    twice = np.bincount(column, minlength=len(values)) > 1
    row = np.repeat(np.arange(len(n)), n)[twice[column]]
    place = (np.cumsum(twice) - 1)[column[twice[column]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    common = np.zeros((len(n), len(n)), np.float32)
    for k in range(0, int(twice.sum()), step):
        lo, hi = np.searchsorted(place, (k, k + step))
        some = np.zeros((len(n), step), np.float32)
        some[row[lo:hi], place[lo:hi] - k] = 1
        for r in range(0, len(n), rows):
            common[r : r + rows] += some[r : r + rows] @ some.T
    linked = np.empty(common.shape, bool)
    for r in range(0, len(n), rows):
        part = common[r : r + rows]
        linked[r : r + rows] = 100 * part >= percent * (n[r : r + rows, None] + n[None] - part)
    return linked


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 80) -> DataFrame:
    """One row of each component, all columns as they are: of the rows whose key is the component's smallest.
    Components with the same smallest key keep a row each, and so does a component without a key. Rows without words
    are components of their own; of those with equal key and text one stays."""
    found = _found(docs, key, text, k, percent).where("kept")
    mark, own, alone = (_unused(docs, name) for name in ("stamp", "comp", "alone"))
    keep = found.groupBy(F.col("key").alias("_key"), F.col("stamp").alias("_stamp")).agg(F.min("comp").alias(own))
    marked = docs.withColumn(mark, F.xxhash64(text)).alias("docs")
    rows = marked.join(keep.alias("keep"), F.col(f"docs.{key}").eqNullSafe(F.col("keep._key")) & (F.col(f"docs.{mark}") == F.col("keep._stamp"))).select("docs.*", own)
    return rows.withColumn(alone, F.when(F.col(own).isNull(), F.col(mark))).dropDuplicates([key, own, alone]).select(docs.columns)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
