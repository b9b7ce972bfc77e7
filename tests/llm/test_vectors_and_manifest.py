"""Hard negatives, nearest neighbours and the Merkle manifest against plain versions."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, nothing
from pyspark.sql import functions as F

from farelake.llm import hard_negatives as H, merkle as M, multi_index as I, vectors as V
from farelake.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string, key string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(seed, n=400, d=8, hot=False, odd=True):
    """Clustered vectors, some repeated; with nulls, bad components, other lengths and repeated ids if ``odd``."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    rows = [(i, np.float32(centres[i % 6] * 0.5 + rng.normal(size=d) * 0.4).tolist(), int(rng.integers(10)), "r", "s", "k") for i in range(n)]
    if hot:  # a third of the rows are the same vector
        rows = [(i, rows[0][1] if i % 3 == 0 else v, lab, *rest) for i, v, lab, *rest in rows]
    if odd:
        ok = rows[3][1]
        rows += [(None, ok, 1, None, None, None), (50, None, 1, "", "", ""), (100, ok, None, "", "", ""), (150, [None, *ok[1:]], 1, "", "", ""), (200, [float("nan"), *ok[1:]], 1, "", "", ""), (250, [float("inf"), *ok[1:]], 1, "", "", "")]
        rows += [(50, ok, 3, "", "", ""), (50, ok, 3, "", "", ""), (1000, ok[:3], 2, "", "", ""), (1050, [], 2, "", "", ""), (1100, ok + [5.0], 2, "", "", ""), (1150, [0.0] * d, 4, "", "", "")]
    return rows


def plain_negatives(rows):
    part = [(k, lab, [math.floor(256 * float(x)) for x in v]) for k, v, lab, *_ in rows if k is not None and lab is not None and usable(v)]
    out = []
    for i, (a, la, va) in enumerate(part):
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, vb)), b, lb) for j, (b, lb, vb) in enumerate(part) if j != i]
        for ps, p in heapq.nsmallest(5, ((s, b) for s, b, lb in scored if lb == la), key=lambda x: (-x[0], x[1])):
            inside = [(s, b) for s, b, lb in scored if lb != la and 50 * ps <= 100 * s <= 95 * ps]
            out += [(a, p, r, b, ps, s) for r, (s, b) in enumerate(sorted(inside, key=lambda x: (-x[0], x[1]))[:3], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % 50 == 0, **options).select("anchor", "positive", "rank", "negative", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("hot", [False, True])
def test_negatives_equal_brute_force_over_many_blocks(spark, monkeypatch, hot):
    monkeypatch.setattr(V, "LEAST_ROWS", 40)
    rows = vectors(3, hot=hot)
    expect = plain_negatives(rows)
    assert len(expect) > 20
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expect


def test_scores_beyond_floats_stay_exact(spark):
    big = [(50 * i if i < 3 else i, [float(1 << (15 + i % 7)) + i, 3.0e5, -1.0 * i], i % 2, "", "", "") for i in range(12)]
    rows = [(k, np.float32(v).tolist(), *rest) for k, v, *rest in big]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain_negatives(rows)
    huge = spark.createDataFrame([(0, [3e38], 1, "", "", ""), (1, [3e38], 1, "", "", ""), (2, [2e38], 2, "", "", "")], SCHEMA)
    top = (1 << 63) - 1
    assert [r.score for r in H.positives(V.numbered(huge.select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vec")), "v"), V.numbered(huge.where("vec_id = 0").select(F.col("vec_id").alias("key"), "label", F.col("embedding").alias("vec")), "a").withColumn("row", F.lit(-1).cast("long")), 1, 2, 256).collect()] == [top, top]


def test_text_keys_and_labels_empty_tables_and_few_partners(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [0.9, 0.1], "x"), ("c", [0.5, 0.5], "y"), ("d", [0.5, 0.5], "y"), ("e", [-1.0, 0.0], "z")]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    got = sorted(tuple(r) for r in H.mine(df, F.col("vec_id") == "a").collect())
    assert got == [("a", "b", 1, 1, "c", 256 * 230, 256 * 128), ("a", "b", 1, 2, "d", 256 * 230, 256 * 128)]
    assert H.mine(df, F.col("vec_id") == "e").count() == 0  # no positive
    assert H.mine(df, F.lit(None).cast("boolean")).count() == 0
    assert H.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_rule_candidates_out_before_all_columns_are_read():
    rng = np.random.default_rng(1)
    values = np.floor(256 * rng.normal(size=(2000, 64)) / 8)
    block = H.Columns(np.arange(2000), np.arange(2000), np.zeros(2000, int), values)
    anchor = np.floor(256 * rng.normal(size=64) ** 3 / 8)
    seen = []

    def watched(partial, least, most):
        seen.append(len(partial))
        return H.best(5)(partial, least, most)

    at, scores = H.scan(block, anchor, np.arange(2000), watched)
    exact = values @ anchor
    assert sorted(scores[H._first(block, at, scores, 5)]) == sorted(np.sort(exact)[-5:])
    assert seen[0] == 2000 and seen[-2] < 200


def plain_neighbours(rows, k=10):
    part = [(key, np.array(v, float)) for key, v, *_ in rows if key is not None and usable(v) and any(v)]
    width = max(len(v) for _, v in part)
    matrix = np.array([np.pad(v, (0, width - len(v))) for _, v in part])
    keys = np.array([k_ for k_, _ in part])
    out = {}
    for i in np.flatnonzero(keys % 100 == 0):
        d = np.sqrt(((matrix - matrix[i]) ** 2).sum(1))
        d[i] = np.inf
        o = np.lexsort((keys, d))[: min(k, len(keys) - 1)]
        out.setdefault(keys[i], []).append(list(zip(d[o], keys[o])))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_recall_and_exact_scores(spark, monkeypatch, hot):
    monkeypatch.setattr(V, "LEAST_ROWS", 100)
    rows = vectors(5, n=3000, d=16, hot=hot)
    found = I.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 100 == 0).collect()
    expect = plain_neighbours(rows)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query, []).append((r.score, r.key))
    single = {q: lists[0] for q, lists in expect.items() if len(lists) == 1}
    assert got.keys() == expect.keys()
    hits = sum(len({s for s, _ in got[q]} & {s for s, _ in near}) / len({s for s, _ in near}) for q, near in single.items())
    assert hits / len(single) >= 0.9  # by distance: of many equal rows any are as near
    for q, near in single.items():
        assert len(got[q]) == len(near) and got[q] == sorted(got[q])
        assert all(a[0] >= b[0] for a, b in zip(got[q], near))


def test_neighbours_of_given_embeddings(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = queries()["op12_multi_index"](spark, "/root/testdata/sf0.01").collect()
    expect = {(q, key) for q, lists in plain_neighbours(rows).items() for _, key in lists[0]}
    assert len(found) == len(expect) and len({(r.query_id, r.vec_id) for r in found} & expect) >= 0.9 * len(expect)


def test_few_rows_equal_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(100, [1.0, 2.0], 1, "", "", "")], SCHEMA)
    assert I.search(one, F.col("vec_id") % 100 == 0).count() == 0
    same = spark.createDataFrame([(100, [1.0], 1, "", "", "")] * 2 + [(7, [1.0], 1, "", "", ""), (3, [2.0], 1, "", "", "")], SCHEMA)
    rows = sorted((r.query, r["rank"], r.key, r.score) for r in I.search(same, F.col("vec_id") % 100 == 0).collect())
    assert rows == [(100, 1, 7, 0.0)] * 2 + [(100, 2, 100, 0.0)] * 2 + [(100, 3, 3, 1.0)] * 2
    none = I.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0)
    assert none.columns == ["query", "rank", "key", "score"] and none.count() == 0
    assert I.search(spark.createDataFrame([(0, [0.0], 1, "", "", ""), (100, None, 1, "", "", "")], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_cells_come_in_ascending_sum_and_each_once():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random(7), np.round(rng.random(9), 1)
    got = list(I.visiting_order(d1, d2))
    assert [t for t, *_ in got] == sorted((d1[:, None] + d2).ravel()) and len({(i, j) for _, i, j in got}) == 63
    assert all(t == d1[i] + d2[j] for t, i, j in got)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(docs):
    """(doc_id, leaf, subroot, root, proof hash, folded root, verified) of every row."""
    parts = {}
    for d in docs:
        shown = plain_leaf(d.doc_id, d.source, d.lang, d.n_chars + 1, d.text) if d.doc_id is not None and d.n_chars is not None and zlib.crc32(str(d.doc_id).encode()) % 7 == 0 else None
        leaf = plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)
        parts.setdefault(d.lang, []).append((d.doc_id is not None, d.doc_id or 0, leaf, shown or leaf, d.doc_id))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    made = {p: levels([x[2] for x in sorted(parts[p])]) for p in order}
    top = levels([made[p][-1][0] for p in order])
    out = []
    for i, p in enumerate(order):
        for at, (*_, leaf, shown, key) in enumerate(sorted(parts[p])):
            node, proof = shown, []
            for tree, pos in ((made[p], at), (top, i)):
                for level in tree[:-1]:
                    other = level[pos ^ 1] if pos ^ 1 < len(level) else None
                    node = h(node) if other is None else h(node, other) if pos % 2 == 0 else h(other, node)
                    proof += [other] if other else []
                    pos >>= 1
            out.append((key, leaf, made[p][-1][0], top[-1][0], h(*proof), node, node == top[-1][0]))
    return out


def manifest_rows(df, levels_=M.LAYER):
    fields = [F.col(c) for c in ("doc_id", "source", "lang")]
    leaf = M.leaf_of(*fields, F.col("n_chars"), F.col("text"))
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, M.leaf_of(*fields, F.col("n_chars") + 1, F.col("text"))).otherwise(leaf)
    made = M.manifest(df, "doc_id", "lang", leaf, levels_, shown=shown)
    rows = M.checked(M.proofs(made, made.leaves), "shown").collect()
    return [(r.key, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in rows]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("levels_", [1, 2, 12])
def test_manifest_equals_plain_version(spark, levels_):
    docs = documents(spark)
    got = manifest_rows(docs, levels_)
    assert by_text(got) == by_text(plain_manifest(docs.collect()))
    assert {r[0] for r in got if not r[-1]} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}


def test_manifest_of_odd_rows(spark):
    docs = awkward(spark)
    assert by_text(manifest_rows(docs, 1)) == by_text(plain_manifest(docs.collect()))
    same = docs.where("doc_id = 1").limit(1)
    for _ in range(5):  # 32 equal rows
        same = same.unionByName(same)
    mixed = same.unionByName(docs)
    assert by_text(manifest_rows(mixed, 2)) == by_text(plain_manifest(mixed.collect()))
    assert manifest_rows(nothing(spark)) == []
    one = docs.where("doc_id = 3")
    (row,) = manifest_rows(one)
    assert row[1] == row[2] and row[4] == h() and row[3] == row[1]


def test_many_parts(spark):
    docs = documents(spark).withColumn("lang", F.concat(F.lit("p"), (F.col("doc_id") % 37).cast("string")))
    assert by_text(manifest_rows(docs, 2)) == by_text(plain_manifest(docs.collect()))


def test_proofs_of_some_rows_fetch_only_what_is_missing(spark):
    docs = documents(spark)
    leaf = M.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    made = M.manifest(docs, "doc_id", "lang", leaf, levels=3)
    some = made.leaves.where("key % 11 = 0")
    rows = M.proofs(made, some).collect()
    expect = {r[0]: r for r in plain_manifest(docs.collect())}
    assert len(rows) == some.count() and all(h(*r.proof) == expect[r.key][4] and r.root == expect[r.key][3] for r in rows)


def test_missing_nodes_are_minimal_and_enough():
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 8, 21):
        leaves = [h(str(i)) for i in range(n)]
        tree = levels(leaves)
        for _ in range(8):
            targets = sorted(rng.sample(range(n), rng.randint(1, n)))
            coords = M.missing(targets, n)
            # a node is needed if it is beside a path and no target lies below it
            need = {(lv, (t >> lv) ^ 1) for t in targets for lv in range(len(tree) - 1) if (t >> lv) ^ 1 < len(tree[lv])}
            need = {(lv, p) for lv, p in need if not any(t >> lv == p for t in targets)}
            assert set(coords) == need and len(coords) == len(need)
            known = M.derived({t: leaves[t] for t in targets}, {(lv, p): tree[lv][p] for lv, p in coords}, n)
            assert known[len(tree) - 1, 0] == tree[-1][0]
    assert M.missing(range(21), 21) == []


def test_a_changed_leaf_or_sibling_gives_another_root(spark):
    tree = levels([h(str(i)) for i in range(5)])
    proof = [tree[lv][p] for lv, p, there in M.path(3, 5) if there]
    assert M.fold(tree[0][3], proof, 3, 5, 0, 1) == tree[-1][0]
    assert M.fold(tree[0][2], proof, 3, 5, 0, 1) != tree[-1][0]
    assert M.fold(tree[0][3], proof[::-1], 3, 5, 0, 1) != tree[-1][0]
