"""Quality rules and near-duplicates against plain versions."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import awkward, documents, nothing

from farelake.llm import minhash_dedup as M, quality_rules as Q, text_arrays as TA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    upper = sum(len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w) for w in words)
    stutter = sum(a == b for a, b in zip(words, words[1:]))
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    kept = not (base or 100 * out["n_symbols"] > 10 * len(words) or 100 * upper > 30 * len(words) or 100 * stutter > 30 * len(words) or 100 * out["n_dup_lines"] > 50 * len(lines))
    return out | {"base_failed": base, "kept": kept}


def test_rules_equal_plain_counts(spark):
    for docs in (documents(spark), awkward(spark)):
        rows = Q.verdicts(docs.select("doc_id", "text"), stats=True).collect()
        expect = sorted((str(r.doc_id), *map(str, plain_counts(r.text).values())) for r in docs.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), *(str(r[c]) for c in (*Q.STATS, "base_failed", "kept"))) for r in rows) == expect


def test_order_changes_cost_not_verdict(spark):
    docs = documents(spark)
    names = [r.name for r in Q.RULES]
    assert sorted(Q.learn_order(docs)) == sorted(names)
    a = Q.verdicts(docs, order=names).collect()
    b = Q.verdicts(docs, order=names[::-1]).collect()
    assert sorted((r.doc_id, r.kept) for r in a) == sorted((r.doc_id, r.kept) for r in b)
    assert all((r.failed_rule is None) == r.kept for r in a)
    assert all(r.rules_met == (len(names) if r.kept else names.index(r.failed_rule) + 1) for r in a)


def test_keep_good_keeps_columns_and_good_rows(spark):
    docs = documents(spark)
    kept = Q.keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if plain_counts(r.text)["kept"])
    assert [r.doc_id for r in Q.keep_good(awkward(spark)).collect()] == [5]
    assert Q.keep_good(nothing(spark)).count() == 0 and Q.verdicts(nothing(spark), stats=True).count() == 0


def plain_components(rows, k=4, percent=80):
    """Exact sets, all pairs."""
    sets = []
    for _, text in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted((str(key), len(sets[i]), str(least.get(top(i)) if sets[i] else key)) for i, (key, _) in enumerate(rows))


def found(docs, **how):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in M.near_duplicates(docs, **how).collect())


def test_components_equal_all_pairs(spark):
    for docs in (documents(spark), awkward(spark)):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        assert found(docs) == plain_components(rows)
    assert M.near_duplicates(nothing(spark)).count() == 0


def test_chains_and_stars_lose_no_link(spark):
    """Variants of one text at all distances: many share buckets without being links, and links form chains."""
    import random

    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for key in range(160):
        words = list(base)
        for _ in range(random.randint(0, 6)):
            words[random.randrange(60)] = f"v{random.randrange(40)}"
        rows.append((key * 3 % 160, " ".join(words)))
    chain = list(base)
    for key in range(200, 230):  # each one word further
        chain[(key * 7) % 60] = f"c{key}"
        rows.append((key, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expect = plain_components(rows)
    assert found(docs) == expect
    old = M.STAR_ROUNDS, M.BLOCK_SHINGLES
    try:  # everything by blocks, many of them
        M.STAR_ROUNDS, M.BLOCK_SHINGLES = 0, 500
        assert found(docs) == expect
    finally:
        M.STAR_ROUNDS, M.BLOCK_SHINGLES = old


def test_one_of_each_stays(spark):
    docs = awkward(spark)
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "4", "5", "6", "7", "7", "None"]
    kept = {r.doc_id for r in M.near_duplicates(documents(spark)).collect() if r.kept}
    assert {r.doc_id for r in M.drop_near_duplicates(documents(spark)).collect()} == kept


def test_each_component_of_one_key_keeps_a_row(spark):
    texts = ["one", "two", "alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zeta", "ALPHA beta gamma delta epsilon zeta", None, "", ""]
    rows = [(7, t) for t in texts] + [(9, "two"), (None, "three"), (None, "THREE"), (None, "four"), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, str(r.text).lower()) for r in M.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, "one"), (7, "two"), (7, texts[2]), (7, "none"), (7, ""), (None, "three"), (None, "four")], key=str)


def test_two_keys_tell_sets_apart(spark):
    rng = np.random.default_rng(3)
    keys, rows = rng.integers(0, 1 << 63, 6000).astype(np.uint64), np.sort(rng.integers(0, 500, 6000))
    both = M.set_keys(rows, keys, 502)
    for one in both:  # either tells sets apart by itself; the two last rows are both empty
        assert len(np.unique(one[:501])) == 501 and one[500] == one[501]
    order = np.lexsort((rng.random(6000), rows))  # the order inside a set does not matter
    assert (M.set_keys(rows[order], keys[order], 502) == both).all()
    sig = spark.createDataFrame([(1, 5, 70), (2, 5, 71), (3, 5, 70), (4, 6, 70), (5, None, None)], "key long, node long, check long")
    node = {r.key: r.node for r in M.apart(sig).collect()}
    assert node[1] == node[3] == 5 and node[2] not in (5, 6, None) and node[4] == 6 and node[5] is None
    assert M.apart(sig.where("key <> 2")).collect() == sig.where("key <> 2").collect()


def test_small_sets_keep_recall(spark):
    """Five shingles against four: similarity 0.8 with few filled bins."""
    rows = [(i, " ".join(f"{'abcdefghij'[j]}{i // 2}" for j in range(8 - i % 2))) for i in range(400)]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_blocks_are_bounded_by_nodes(spark):
    """Many short sets that share most shingles and are not linked: few shingles, many nodes."""
    import tracemalloc

    import numpy as np

    sizes = spark.createDataFrame([(5 * 26_000, 26_000), (10**7, 100), (10, 2)], "weight long, nodes long")
    assert [r.c for r in sizes.select(M._cuts().alias("c")).collect()] == [-(-26_000 // M.BLOCK_NODES), 77, 1]
    n = 2 * M.BLOCK_NODES
    sets = np.array([[1, 2, 3, 4, 100 + i // 2] for i in range(n)], np.uint64)
    tracemalloc.start()
    linked = M._linked(np.arange(n + 1) * 5, sets.ravel(), 80)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert (linked == (np.arange(n)[:, None] // 2 == np.arange(n)[None] // 2)).all()
    rows = [(i, f"w1 w2 w3 w4 w5 w6 w7 x{i}") for i in range(300)] + [(300, "w1 w2 w3 w4 w5 w6 w7")]
    old = M.STAR_ROUNDS, M.BLOCK_NODES
    try:
        M.STAR_ROUNDS, M.BLOCK_NODES = 0, 64
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain_components(rows)
    finally:
        M.STAR_ROUNDS, M.BLOCK_NODES = old


def test_memory_of_a_batch_of_texts():
    words = np.random.default_rng(7).integers(0, 10**6, (2000, 400)).astype(str)
    column = pa.array([" ".join(w) for w in words])
    assert column.nbytes > 5 << 20
    whole = {}
    for size in (1 << 40, TA.CHUNK_BYTES):  # all at once, then as tasks do it
        tracemalloc.start()
        out = []
        for a, b, texts in TA.chunks(column, size):
            rows, keys = M.shingle_sets(texts, 4)
            out.append(M.band_hashes(M.signatures(rows, keys, b - a)))
        peak = tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in out)
        tracemalloc.stop()
        whole[size] = np.concatenate(out)
    assert peak < 24 << 20
    assert (whole[1 << 40] == whole[TA.CHUNK_BYTES]).all()
