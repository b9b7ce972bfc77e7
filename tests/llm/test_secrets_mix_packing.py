"""Secret scans, source mix and packing against plain versions."""

import base64
import gzip
import hashlib
import json
import re
import time
import urllib.parse
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward, documents, nothing
from hypothesis import given, settings, strategies as st

from farelake.llm import packing as P, q_secret_scans, secret_scans as S, source_mix as X

SECRET = "password=hunter2secret"
ENCODINGS = {
    "url": lambda t: urllib.parse.quote(t, safe=""),
    "all url": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: base64.b64encode(t.encode()).decode(),
    "gzip": lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(),
    "zlib": lambda t: base64.urlsafe_b64encode(zlib.compress(t.encode())).decode(),
    "gzip url": lambda t: "".join(f"%{b:02x}" for b in gzip.compress(t.encode(), mtime=0)),
}


@pytest.mark.parametrize("outer", ENCODINGS)
@pytest.mark.parametrize("inner", ENCODINGS)
def test_nested_layers_map_to_their_span(outer, inner):
    hidden = ENCODINGS[outer](ENCODINGS[inner](SECRET))
    text = f"é says {hidden} and so on"
    base, spans = S.all_spans(text)
    assert (0, 7, 7 + len(hidden)) in [(k, a, b) for a, k, b in spans], spans
    assert set(base) <= set(spans)


def test_partly_escaped_maps_to_characters():
    assert S.all_spans("x \\u0070assword%3Dhunter2secret y")[1] == [(2, 0, 31)]
    assert S.all_spans("a %41KIA" + "B" * 16 + " b")[1] == [(2, 1, 24)]


def test_cycles_and_bombs_end():
    quine = bytes.fromhex("1f8b0800000000000003") + b"\x00" * 8  # no valid data: nothing opens
    assert S.all_spans(base64.b64encode(quine).decode())[1] == []
    bomb = base64.b64encode(gzip.compress(b"0" * (S.MAX_LAYER_BYTES + 1))).decode()
    assert S.all_spans(f"x {bomb}")[1] == [(2, 2, 2 + len(bomb))]  # read to its end: one run of hex digits
    assert S.all_spans("%25" * 50)[1] == []


LINE = b"nothing to see on this line, which is sixty-four bytes long....\n"
LARGE = 64 << 20


def large(at: int, secret: bytes) -> bytes:
    """64 MiB of harmless lines with ``secret`` at a place."""
    text = LINE * (LARGE // len(LINE))
    return text[:at] + b" " + secret + b" " + text[at:]


@pytest.mark.parametrize("at", [0, 17 << 20, (32 << 20) - 9, (32 << 20) + 3, LARGE - 64, LARGE])
def test_layers_of_any_size_are_read(at):
    assert len(LINE) == 64
    run = base64.b64encode(gzip.compress(large(at, b"password = hunter2secret"), 1)).decode()
    text = f"see {run} end"
    assert S.all_spans(text)[1] == [(4, 0, 4 + len(run))]


def test_large_layers_without_finds_and_with_others_behind():
    clean, small = gzip.compress(large(5, b"word"), 1), gzip.compress(b"token=abcdef123456 " * 3)
    run = base64.b64encode(clean).decode()
    assert S.all_spans(run)[1] == []
    both = base64.b64encode(clean + b"--" + small).decode()  # the scan goes on behind a large layer
    assert [k for _, k, _ in S.all_spans(both)[1]] == [0]


def test_what_runs_from_piece_to_piece_is_decoded(monkeypatch):
    for name, size in (("MAX_LAYER_BYTES", 1 << 18), ("PIECE_BYTES", 1 << 16), ("OVERLAP_BYTES", 1 << 10)):
        monkeypatch.setattr(S, name, size)
    letters = np.frombuffer(b"ghijklmnopqrstuvwxyz GHIJKLMNOPQRSTUVWXYZ", np.uint8)
    noise = letters[np.random.default_rng(7).integers(0, len(letters), 400_000)].tobytes()
    inner = gzip.compress(noise + b" AKIA" + b"Q" * 20 + b" ", 1)
    assert len(inner) > 3 * S.PIECE_BYTES
    for wrap in (lambda b: b, base64.b64encode, base64.encodebytes):
        data = gzip.compress(LINE * 999 + wrap(inner) + LINE * 999, 1)
        kinds, end, ended = S.large_kinds(data, 0)
        assert 1 in kinds and (end, ended) == (len(data), True)
    spaces = gzip.compress(LINE + b"token" + b" " * 500_000 + b"=" + b" " * 300_000 + b"abcdef12", 1)
    assert S.large_kinds(spaces, 0)[0] == {0}
    assert S.large_kinds(gzip.compress(LINE * 9999 + b"%7" + b"%41" * 9999, 1), 0)[0] == {3}
    damaged = data[: len(data) - 9]
    assert S.large_kinds(damaged, 0)[1:] == (len(damaged), False)


def test_a_hot_id_falls_into_many_shards_and_reruns_agree(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"s{i % 2}", "w " * (i % 11) + str(i)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.selectExpr("doc_id AS key", "source", "cast(regexp_count(text, '[^ ]+') AS long) AS size", "xxhash64(text) AS stamp")
    sources, quotas = X.plan(sized, shard_rows=100)
    shards = X.mixed(sized, sources, quotas, "key", "source", "size", "stamp")
    hot = sized.where("key = 7").join(sources, "source").select(X._shard(X.SEED).alias("shard")).distinct().count()
    assert hot == quotas.select("shard").distinct().count() == 15
    taken = shards.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r[1] - r[2]) <= 0.02 * r[2] or abs(r[1] - r[2]) <= 2 * X.BLOCK_WORDS for r in taken)
    first, again = (sorted(map(str, X.resampled(d).collect())) for d in (docs, docs.repartition(7).orderBy("text")))
    assert first == again


@pytest.mark.parametrize("before,after", [("https://x.io/cb/", ""), ("path/", ""), ("auth_", ""), ("log-", "/next"), ("a", "b"), ("x+y_", "-z"), ("key=", "/")])
@pytest.mark.parametrize("inner", ["base64", "gzip", "zlib"])
def test_runs_that_touch_other_characters(before, after, inner):
    for body in (SECRET, SECRET + "ab ~~~???>>>", "??>>~~ " + SECRET):
        run = ENCODINGS[inner](body)
        run = run.rstrip("=") if after else run
        text = f"go {before}{run}{after} on"
        at = text.index(run)
        spans = S.all_spans(text)[1]
        hidden = text[min(a for a, _, _ in spans) : max(b for _, _, b in spans)]
        assert hunted(run, body, inner) in hidden and at - 4 <= spans[0][0] and spans[-1][2] <= at + len(run) + 4
        assert not S.all_spans(S.masked(text, spans, "[REDACTED]"))[1]


def hunted(run, body, inner):
    """The characters of ``run`` that hold the secret."""
    first = body.index(SECRET)
    return run if inner != "base64" else run[first * 4 // 3 : ((first + len(SECRET)) * 4 + 2) // 3]


@pytest.mark.parametrize(
    "data",
    [f"{SECRET}\u00a0ok", f"\ufeff{SECRET}", f"\u65e5\u672c\u3000\u8a9e {SECRET}", f"{SECRET} \U0001f468\u200d\U0001f469", f"\u00ad{SECRET}\x0c", f"\x1b[1m{SECRET}\x00"]
    + [SECRET.encode() + b" \xff ok", b"\xe9t\xe9 " + SECRET.encode(), SECRET.encode("utf-16"), SECRET.encode("utf-16-le"), SECRET.encode("utf-16-be"), b"x" + SECRET.encode("utf-16-le"), f"\u65e5\u3000\U0001f600 {SECRET}".encode("utf-16")],
)
def test_layers_that_are_not_clean_text(data):
    data = data if isinstance(data, bytes) else data.encode()
    wide = b"\x00a" in data or b"a\x00" in data
    secret = next(SECRET.encode(code) for code in (["utf-16-le", "utf-16-be"] if wide else ["utf-8"]) if SECRET.encode(code) in data)
    first = data.index(secret) * 4 // 3
    for wrap in (lambda b: b, gzip.compress):
        run = base64.b64encode(wrap(data)).decode()
        (a, kind, b), *_ = spans = S.all_spans(f"x {run}")[1]
        assert kind == 0 and a <= 2 + first and b >= 2 + first + len(secret) * 4 // 3
        assert not S.all_spans(S.masked(f"x {run}", spans, "[REDACTED]"))[1]


LITERAL = {
    "quote": lambda b: urllib.parse.quote(b),
    "quote_plus": lambda b: urllib.parse.quote_plus(b),
    "repr": lambda b: repr(b)[2:-1],
    "json": lambda b: json.dumps(b.decode("latin-1"))[1:-1],
    "entities": lambda b: "".join(chr(c) if 48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 else f"&#{c};" for c in b),
}


@pytest.mark.parametrize("escaped", LITERAL)
@pytest.mark.parametrize("packed", [lambda b: gzip.compress(b, mtime=0), zlib.compress])
def test_compressed_bytes_with_literal_characters(escaped, packed):
    for i in range(40):  # other bytes each time: letters, spaces, plus signs
        hidden = LITERAL[escaped](packed(f"{i * 7919} {SECRET}{i}".encode()))
        for before, after in (("", ""), ("d=", "&x=1")):
            text = f"x {before}{hidden}{after} y"
            at = 2 + len(before)
            assert (at, 0, at + len(hidden)) in S.all_spans(text)[1], text


@pytest.mark.parametrize("packed", [lambda b: gzip.compress(b, mtime=0), zlib.compress])
def test_every_member_is_read(packed):
    for parts in ([b"first log\n", f"second {SECRET}\n".encode()], [b"a" * 50_000, b"", b"pass", b"word=hunter2secret"]):
        for between in (b"", b"\x00" * 5):
            hidden = base64.b64encode(between.join(map(packed, parts))).decode()
            spans = S.all_spans(f"x {hidden}")[1]
            assert (2, 0, 2 + len(hidden)) in spans


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    assert S.all_spans(base64.b64encode(np.random.default_rng(1).bytes(1 << 18)).decode())[1] == []
    assert time.perf_counter() - start < 30


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_spans_equal_plain_patterns(spark):
    spark_rows = {r.doc_id: r for r in q_secret_scans.op6_secret_scans(spark, "/root/testdata/sf0.01").collect()}
    hits = 0
    for r in documents(spark, "sf0.01").collect():
        want = plain_base(r.text)
        got = spark_rows[r.doc_id]
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got.n_assign, got.n_access, got.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(filter(None, joined.split(","))) <= set(got.spans.split(","))
        hits += len(want)
    assert hits > 20


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "=", ":", " ", '"', "secret", "apikey", "api_key", "abc", "abcdef", "AKIA", "A" * 16, "0123456789abcdef", "é", "K", "ſecret", "%41", "\\u0041", "\n", "&#65;"]), max_size=12))
def test_base_spans_on_odd_texts(parts):
    text = "".join(parts)
    base, spans = S.all_spans(text)
    assert base == plain_base(text) and set(base) <= set(spans)
    assert all(0 <= a < b <= len(text) for a, _, b in spans)


def test_prefilter_passes_every_text_with_a_span(spark):
    import pyarrow as pa

    texts = [r.text for r in documents(spark, "sf0.01").collect()] + [f"x {e(SECRET)}" for e in ENCODINGS.values()] + [None, ""]
    look = S.suspects(pa.array(texts))
    assert all(look[i] for i, t in enumerate(texts) if S.all_spans(t or "")[1])


def test_redaction(spark):
    docs = documents(spark, "sf0.01")
    before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, S.redact(docs)))
    assert S.redact(docs).schema == docs.schema
    for key, old in before.items():
        new = after[key]
        assert not S.all_spans(new.text)[1] and new.n_chars == len(new.text)
        if not S.all_spans(old.text)[1]:
            assert new == old
    rows = sorted(map(str, S.redact(awkward(spark)).collect()))
    assert rows == sorted(map(str, awkward(spark).collect()))
    assert S.redact(nothing(spark)).count() == 0 and S.scan(nothing(spark)).count() == 0
    assert S.scan(awkward(spark)).count() == 11


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: X.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return target


def check_mix(docs):
    rows = [(r, s) for r, s in zip(*(X.mix(d).orderBy("doc_id", "size").collect() for d in (docs, docs)))]
    assert all(a == b for a, b in rows)  # reruns agree
    return [a for a, _ in rows]


def test_mix_meets_targets(spark):
    docs = documents(spark, "sf0.01")
    got = {r.doc_id: r for r in check_mix(docs)}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        g = got[r.doc_id]
        assert g.size == n and 0 <= g.taken <= 3 * n
        sizes[r.source] += n
        taken[r.source] += g.taken
        target[r.source] = g.target
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.02)


def test_mix_caps_tiny_and_null_sources(spark):
    text = " ".join(["w"] * 500)
    rows = [(i, text, "big") for i in range(300)] + [(1000, "a b c", "tiny"), (1001, "d e", None), (1002, None, "void"), (1003, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in check_mix(docs)}
    assert (got[1000].taken, got[1001].taken, got[1002].taken, got[1003].taken) == (9, 6, 0, 0)
    big = [got[i] for i in range(300)]
    assert big[0].target == pytest.approx(150_005 - 15) and sum(r.taken for r in big) == pytest.approx(big[0].target, rel=0.02)
    assert check_mix(nothing(spark).drop("target")) == []
    assert len(check_mix(awkward(spark))) == 11


def plain_sainte_lague(votes, seats, most):
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        free = [k for k in votes if got[k] < most[k] and votes[k] > 0]
        if not free:
            break
        got[max(free, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))] += 1
    return got


def test_highest_averages_equal_seat_by_seat(spark):
    import random

    random.seed(5)
    rows = []
    for g in range(30):
        n = random.randint(1, 12)
        claim = [random.choice([0.0, 1.0, random.random() * 10, random.random() * 500]) for _ in range(n)]
        seats = round(sum(claim))
        rows += [(g, i, c, seats, 10**6) for i, c in enumerate(claim)]
    out = X.highest_averages(spark.createDataFrame(rows, "g int, k int, v double, s long, m long"), ["g"], "k", "v", "s", "m").collect()
    for g in range(30):
        own = [r for r in out if r.g == g]
        want = plain_sainte_lague({r.k: r.v for r in own}, own[0].s, {r.k: r.m for r in own})
        assert {r.k: r.quota for r in own} == want


def test_resampled_documents_are_whole(spark):
    docs = documents(spark, "sf0.01")
    out = X.resampled(docs)
    assert out.schema == docs.schema
    known = {r.doc_id: r for r in docs.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    count = defaultdict(int)
    for r in out.collect():
        assert r == known[r.doc_id]
        count[r.doc_id] += 1
        taken[r.source] += len((r.text or "").split())
    assert max(count.values()) <= 3
    for r in known.values():
        sizes[r.source] += len((r.text or "").split())
    want = plain_targets(sizes)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.1)
    assert X.resampled(awkward(spark)).columns == awkward(spark).columns
    assert X.resampled(nothing(spark)).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_pieces_hold_every_id_once(spark):
    t = tokenizer()
    for docs in (documents(spark), awkward(spark).select("doc_id", "text", "kept")):
        rows = P.pieces(docs, P.default_vocabulary(), with_ids=True).collect()
        by_sequence, by_doc = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.array(r.ids, "<u4")
            assert r.length == len(ids) >= 1 and r.ids_crc32 == zlib.crc32(ids.tobytes())
            by_sequence[r.sequence_id].append(r)
            by_doc[r.doc_id].append(r)
        last = max(by_sequence)
        for s, own in by_sequence.items():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            assert sum(r.length for r in own) == P.LENGTH or s == last
        if docs.columns == ["doc_id", "text", "kept"]:
            assert sum(r.doc_tokens for r in rows if r.start == 0) == sum(r.length for r in rows)
            continue
        for r in docs.collect():
            own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
            want = t.encode(r.text or "", add_special_tokens=False).ids + [0]
            assert [x for p in own for x in p.ids] == want
            assert all(p.doc_tokens == len(want) for p in own)
            assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
    assert P.pieces(nothing(spark), P.default_vocabulary()).count() == 0


def test_sequences_are_padded(spark):
    docs = documents(spark)
    cut = P.pieces(docs, P.default_vocabulary(), with_ids=True)
    whole = P.sequences(cut).collect()
    assert sum(r.n_ids for r in whole) == sum(r.length for r in cut.collect())
    assert all(len(r.ids) == P.LENGTH or (r.n_ids & (r.n_ids - 1)) == 0 and len(r.ids) == r.n_ids for r in whole)


_ENCODERS = {}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abcé ßA.,'!\n\t\r1  ") + [" ", "—", "中", "\U0001f600", "\x00", "\x1c", "\u0085", "　", "<|endoftext|>"]), max_size=60).map("".join))
def test_encoder_equals_the_tokenizer(text):
    if not _ENCODERS:
        _ENCODERS.update(own=P.Encoder(P.default_vocabulary()), plain=tokenizer())
    ids = np.frombuffer(_ENCODERS["own"](text), "<u2").tolist()
    assert ids == _ENCODERS["plain"].encode(text, add_special_tokens=False).ids
    assert json.dumps(ids)


def test_encoder_on_long_runs():
    own, plain = P.Encoder(P.default_vocabulary()), tokenizer()
    for text in ("a " + "\n" * 1_500_000 + "b", " \n" * 700_000, "a" * 100_000, "a  b " * 1000, "x\n \ty\t z"):
        assert np.frombuffer(own(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
