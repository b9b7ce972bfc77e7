"""Language identification, chat formatting and WARC against plain versions."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, nothing
from hypothesis import given, settings, strategies as st

from farelake.llm import chat_format as C, language_mix as L, q_chat_format, q_language_mix, warc as W
from farelake.llm.text_arrays import Texts


def texts_of(*values):
    data = [v.encode() for v in values]
    return Texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data]))).astype(np.int64))


def plain_trigrams(text):
    low = bytes(L._LETTERS[np.frombuffer(text.encode(), np.uint8)])
    out = []
    for word in low.split():
        padded = b" " + word + b" "
        out.append([padded[i : i + 3] for i in range(len(word))])
    return out


def bucket(gram):
    return ((gram[0] << 16 | gram[1] << 8 | gram[2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abÄé .9\n漢")), max_size=12), max_size=6))
def test_trigrams_stay_in_their_words(values):
    words, buckets = L.trigrams(texts_of(*values))
    want = [bucket(g) for v in values for word in plain_trigrams(v) for g in word]
    assert buckets.tolist() == want
    assert words.n_words.tolist() == [len(plain_trigrams(v)) for v in values]


def plain_shares(model, text):
    """The same inference, word by word."""
    fits = [[sum(float(model.table[bucket(g), k]) for g in word) for k in range(len(model.languages))] for word in plain_trigrams(text)]

    def maximise(share):
        for _ in range(L.STEPS):
            new = [0.0] * len(share)
            for f in fits:
                top = max(f)
                each = [s * math.exp(x - top) for s, x in zip(share, f)]
                total = max(sum(each), 1e-300)
                new = [a + e / total for a, e in zip(new, each)]
            share = [x / len(fits) if x >= 0.1 else 0.0 for x in new]
            share = [x / sum(share) for x in share]
        score = sum(math.log(max(sum(s * math.exp(x - max(f)) for s, x in zip(share, f)), 1e-300)) for f in fits)
        return share, score

    share, score = maximise([1 / len(model.languages)] * len(model.languages))
    while sum(x > 0 for x in share) > 1:
        trial = list(share)
        least = min(x for x in share if x > 0)
        trial[max(i for i, x in enumerate(share) if x == least)] = 0.0
        new, new_score = maximise([x / sum(trial) for x in trial])
        if new_score < score - L.PENALTY * math.log(len(fits) + 1):
            break
        share, score = new, new_score
    return share


def test_inference_equals_word_by_word(spark):
    docs = documents(spark)
    model = L.Model.fit(docs)
    rows = [r.text for r in docs.limit(40).collect()]
    mixed = rows[0] + "\n" + rows[1] + "\n" + rows[20]
    got = model.shares(texts_of(*rows, mixed))
    for own, text in zip(got, [*rows, mixed]):
        assert own == pytest.approx(plain_shares(model, text), abs=2e-3)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in q_language_mix.op1_language_mix(spark, "/root/testdata/sf0.01").collect()}
    docs = documents(spark, "sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got.values())


def test_mixture_shares(spark):
    docs = documents(spark, "sf0.01")
    model = L.Model.fit(docs)
    by = defaultdict(list)
    for r in docs.collect():
        if len(r.text.split()) > 300 and not re.search(r"[#|!]", r.text):
            by[r.lang].append(" ".join(r.text.split()[:300]))
    share = model.shares(texts_of(by["en"][0] + " " + by["fr"][0], by["de"][0] + " " + " ".join(by["es"][0].split()[:100])))
    at = {x: i for i, x in enumerate(model.languages)}
    assert share[0, at["en"]] == pytest.approx(0.5, abs=0.05) and share[0, at["fr"]] == pytest.approx(0.5, abs=0.05)
    assert share[1, at["de"]] == pytest.approx(0.75, abs=0.06) and share[1].sum() == pytest.approx(1)


def test_languages_of_awkward_rows(spark):
    model = L.Model.fit(documents(spark))
    got = L.identify(awkward(spark), model)
    assert got.columns == ["doc_id", "lang_pred", "score", "mixture"]
    rows = got.collect()
    assert len(rows) == 11
    und = sorted(str(r.doc_id) for r in rows if r.lang_pred == L.UNKNOWN)
    assert und == ["2", "3", "4"] and all(r.score == 0 and r.mixture == [] for r in rows if r.lang_pred == L.UNKNOWN)
    assert L.identify(nothing(spark), model).count() == 0
    empty = L.Model.fit(nothing(spark))
    assert empty.languages == [] and {r.lang_pred for r in L.identify(awkward(spark), empty).collect()} == {L.UNKNOWN}


ODD = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "a<", "<\\\\|x|>", "|", "\n\n", "é😀<|", "%0A%25", "<|im_end|>\n"]


def plain_digests(rows):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_odd_texts(spark):
    rows = [(c, t, role, ODD[(c + 3 * t) % len(ODD)]) for c in range(22) for t, role in enumerate(["system", "user", "assistant", "user\n%0A<|", "assistant", None][: 1 + c % 6])]
    rows += [(100, None, "user", "first"), (100, 1, "assistant", "x"), (100, 1, "assistant", "x"), (None, 0, "assistant", "lost"), (101, 0, "user", "no reply")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = C.expand(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in q_chat_format.digests(examples).collect()}
    assert got == plain_digests(rows)
    each = examples.collect()
    replies = Counter(conv for conv, _, role, _ in rows if role == "assistant")
    trained = Counter()
    for r in each:
        assert r.text.startswith(C.START) and r.text.endswith(C.END)
        n = r.text.count("<|im_start|>")
        assert n == r.text.count("<|im_end|>") == r.example + 1  # no text can add a mark
        reply = r.text.split("<|im_start|>")[-1]
        if reply.startswith("assistant\n"):
            trained[r.conv_id] += 1
            assert r.text[r.loss_start : r.loss_start + r.loss_chars] == reply[len("assistant\n") : -len(C.END)]
            assert r.text[r.loss_start + r.loss_chars :] == C.END
        else:
            assert r.loss_chars == 0 and r.is_last
    assert trained == replies
    assert C.expand(frame.limit(0)).count() == 0


def pages(spark):
    rows = [(1, "http://a/é x%20", "<p>same</p>", "x"), (5, "http://b", "<p>same</p>", "x"), (5, "http://b", "<p>same</p>", "x"), (3, None, "<p>same</p>", None), (None, "http://c", "<p>same</p>", None),
            (7, "http://d", None, None), (8, "http://e", "", None), (9, "http://f", "\x1f\x8b\x08 gz WARC/1.0\r\n\r\n" + "é" * 70_000, None), (None, "http://g", "alone", None), (-4, "http://h\r\nX: y", "neg", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string")


def plain_pages(rows):
    last = {}
    for page_id, _, html in rows:
        if page_id is not None:
            last[html or ""] = max(page_id, last.get(html or "", page_id))
    out = []
    n = Counter((html or "") for _, _, html in rows)
    for page_id, url, html in rows:
        data = (html or "").encode()
        keeper = last.get(html or "")
        copy = n[html or ""] > 1 and keeper is not None and (page_id is None or page_id < keeper)
        out.append((page_id, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if copy else "response", keeper if copy else None, None if copy else html or ""))
    return sorted(map(str, out))


@pytest.mark.parametrize("split", [1, 700, 50_000, 1 << 30])
def test_warc_round_trip_at_any_split(spark, split):
    frame = pages(spark)
    want = plain_pages([tuple(r)[:3] for r in frame.collect()])
    manifest = W.write(frame.repartition(2))
    if split == 1 and manifest.agg({"bytes": "sum"}).first()[0] > 5000:
        split = 97
    rows = W.read(manifest, split).collect()
    assert sorted(str((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html)) for r in rows) == want


def test_warc_splits_are_read_by_many_tasks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    manifest = W.write(pages)
    splits = sum(-(-r.bytes // 4096) for r in manifest.collect())
    read = W.read(manifest, 4096)
    tasks = {r[0] for r in read.selectExpr("spark_partition_id()").distinct().collect()}
    assert splits > 8 and len(tasks) > min(splits, 8) / 2
    assert read.count() == pages.count()


def test_warc_record_larger_than_many_blocks(spark):
    text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 6_000_000)))
    pages = spark.createDataFrame([(1, "u", "small"), (2, "u", text), (3, "u", "last")], "page_id long, url string, html string")
    rows = {r.page_id: r.html for r in W.read(W.write(pages.coalesce(1)), 1 << 20).collect()}
    assert rows == {1: "small", 2: text, 3: "last"}


def test_warc_is_plain_gzip_members(spark):
    manifest = W.write(pages(spark).coalesce(1))
    for row in manifest.collect():
        store, path = W._opened(row.file)
        data = store.open_input_file(path).read()
        whole = gzip.decompress(data)
        assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == row.records and len(data) == row.bytes


def test_warc_damage_costs_one_record(tmp_path):
    import pyarrow as pa

    members = [W.member(i, "http://x", b"p%d " % i * 500, None) for i in range(5)]
    data = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) + 60
    data[at] ^= 0xFF
    found = [int(re.search(r"\d+", h["warc-record-id"])[0]) for _, h, _ in W.records(pa.BufferReader(bytes(data)), 0, len(data), len(data))]
    assert found == [0, 1, 3, 4]


def test_warc_small_payloads_and_empty(spark):
    types = {r.record_type for r in W.read(W.write(pages(spark).where("html = '<p>same</p>'"))).collect()}
    assert types == {"response", "revisit"}
    assert {r.refers_to for r in W.with_types(pages(spark).drop("refers_to"), min_bytes=12).collect()} == {None}
    assert W.read(W.write(pages(spark).limit(0))).count() == 0
