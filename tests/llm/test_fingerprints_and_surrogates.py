"""Winnowing, neighbours, surrogates and the pipeline against plain versions."""

import hashlib
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from helpers import awkward, documents, nothing
from pyspark.sql import functions as F

from farelake.llm import minhash_dedup, neighbours, q_winnowing, quality_rules, secret_scans, source_mix, surrogates as P, winnowing as W

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprints(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    made = W.with_fingerprint(frame, "text", "fp").select("i", W.hashes("fp").alias("h"), W.positions("fp").alias("p"), F.transform("fp", lambda p: F.shiftright(p, 30)).alias("each"))
    return {r.i: r for r in made.collect()}


def hashed_words(spark, texts):
    words = [[w for w in WORDS.findall(t.lower())] for t in texts]
    frame = spark.createDataFrame(list(enumerate(words)), "i long, w array<string>").select("i", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.xxhash64(F.transform("w", lambda x: F.xxhash64(x))).alias("all"))
    return {r.i: (r.h, r["all"]) for r in frame.collect()}


def rotated(x, n):
    x &= (1 << 64) - 1
    return (x << n | x >> 64 - n) & (1 << 64) - 1 if n else x


def plain_winnow(words, all_):
    k, w = W.K, W.WINDOW
    if not words:
        return []
    grams = [0] * max(0, len(words) - k + 1)
    for i in range(len(grams)):
        for j in range(k):
            grams[i] ^= rotated(words[i + j], k - 1 - j)
    if len(words) < k:
        grams = [all_ & (1 << 64) - 1]
    grams = [g >> 31 for g in grams]
    out = set()
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s : s + w]
        least = min(window)
        out.add(s + max(i for i, g in enumerate(window) if g == least))
    return [(grams[i], i) for i in sorted(out)]


def test_winnowing_equals_plain_windows(spark):
    texts = [r.text for r in documents(spark).collect()] + ["", "a", "a b c", "x " * 50, "a b " * 20, "A  b\tC\nd e", "p q r s t u v w x y z " * 3]
    got, words = fingerprints(spark, texts), hashed_words(spark, texts)
    for i in range(len(texts)):
        assert list(zip(got[i].each, got[i].p)) == plain_winnow(*words[i]), texts[i][:80]


def test_shared_runs_are_found(spark):
    """Any run of WINDOW + K - 1 words shared by two texts leaves a shared hash at positions inside the run."""
    run = " ".join(f"r{i}" for i in range(W.WINDOW + W.K - 1))
    texts = [" ".join(f"a{i}" for i in range(n)) + " " + run + " " + " ".join(f"b{i}" for i in range(60 - n)) for n in (0, 7, 31)] + [" ".join(f"z{i}" for i in range(80))]
    got = fingerprints(spark, texts)
    for i, n in enumerate((0, 7, 31)):
        own = dict(zip(got[i].each, got[i].p))
        shared = set(own) & set(got[(i + 1) % 3].each)
        assert shared and any(n <= own[h] <= n + W.WINDOW - 1 for h in shared)
        assert not set(own) & set(got[3].each)


def test_edited_texts_and_likeness(spark):
    for docs in (documents(spark), documents(spark, "sf0.01").where("doc_id % 7 = 3")):
        rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
        got = {r.doc_id: r for r in q_winnowing.edited_pairs(docs).collect()}
        assert len(got) == len(rows)
        for i, r in enumerate(rows):
            text, after = r.text or "", rows[(i + 1) % len(rows)].text or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            g = got[r.doc_id]
            assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            hashes = [{x.split(":")[0] for x in f.split(",") if x} for f in (g.fingerprint, g.edited_fingerprint, got[rows[(i + 1) % len(rows)].doc_id].fingerprint)]
            for near, other in ((g.near_edited, hashes[1]), (g.near_next, hashes[2])):
                assert near == pytest.approx(len(hashes[0] & other) / len(hashes[0] | other) if hashes[0] | other else 1.0)


def test_awkward_rows_have_neighbours(spark):
    got = q_winnowing.edited_pairs(awkward(spark)).collect()
    assert len(got) == 11 and all(r.near_next is not None and r.near_edited is not None for r in got)
    same = [r.fingerprint for r in got if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1] != ""
    assert {r.fingerprint for r in got if r.doc_id in (2, 3, 4)} == {""}
    assert q_winnowing.edited_pairs(nothing(spark)).count() == 0
    one = q_winnowing.edited_pairs(awkward(spark).where("doc_id = 6")).collect()
    assert one[0].near_next == 1.0


def test_ranges_follow_descending_keys(spark):
    import random

    random.seed(2)
    keys = [random.choice([random.randrange(-50, 50), random.randrange(10**12)]) for _ in range(900)] + [None]
    rows = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "doc_id long, text string")
    order = neighbours.following("text")
    got = neighbours.ranged(rows, "doc_id").withColumn("next", F.lead("text").over(order)).where("not _ghost").collect()
    want = sorted(((k, f"t{i}") for i, k in enumerate(keys)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    after = {t: want[(i + 1) % len(want)][1] for i, (_, t) in enumerate(want)}
    assert {r.text: r.next for r in got} == after


TEXTS = [
    "Call Mr. John Smith at (415) 555-1234 or +1 415 555 1234; Foo.Bar@Mail.example.com, foo.bar@mail.example.com.",
    "Frau Müller: 4111 1111 1111 1111, 4111-1111-1111-1111, 4111111111111112. IBAN DE89 3704 0044 0532 0130 00, 123-45-6789",
    "Анна Петрова, г-н Иванов, Άννα Παπαδοπούλου and Maria Lopez from 10.20.30.40 or 152.143.123.131.",
    "Mr John Smith again, +1 (415) 555-1234, 4111111111111111 $$$ 10.20.30.40",
]
ORIGINALS = ["John Smith", "Foo.Bar", "foo.bar@", "555-1234", "4111", "0532", "123-45-6789", "Müller", "Петрова", "Иванов", "Παπαδοπούλου", "Lopez", "10.20.30.40", "152.143.123.131"]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates_keep_type_gender_script_and_coreference(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.pseudonymised(docs).orderBy("doc_id").collect()}
    for r in got.values():
        assert not any(o in r.text for o in ORIGINALS)
    names = [e.surrogate for r in got.values() for e in r._entities if e.kind == "name"]
    assert names[0].startswith("Mr. ") and names[0].split()[1] in P.GIVEN["m", "latin"]
    assert got[0]._entities[0].surrogate.replace(".", "") == got[3]._entities[0].surrogate
    assert got[0].text.split("; ")[1].lower().count("@") == 2
    emails = [e.surrogate for e in got[0]._entities if e.kind == "email"]
    assert emails[0].lower() == emails[1] and emails[0][0].isupper() and emails[0].endswith(".com")
    phones = [e.surrogate for i in (0, 3) for e in got[i]._entities if e.kind == "phone"]
    assert phones[1].startswith("+1 ") and len({re.sub(r"\D", "", p)[-10:] for p in phones}) == 1
    cards = [e.surrogate for e in got[1]._entities if e.kind == "card"]
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] != digits[2] and luhn(digits[0]) and not luhn(digits[2]) and all(d[0] == "4" for d in digits)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", cards[0]) and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", cards[1])
    assert re.search(r"IBAN DE\d\d( \d{4}){4} \d\d, \d{3}-\d\d-\d{4}$", got[1].text)
    given = [e.surrogate.split() for e in got[2]._entities if e.kind == "name"]
    assert given[0][0] in P.GIVEN["f", "cyrillic"] and given[1][0] == "г-н" and given[2][0] in P.GIVEN["f", "greek"] and given[3][0] in P.GIVEN["f", "latin"]
    ips = [e.surrogate for r in got.values() for e in r._entities if e.kind == "ip"]
    assert ips[0] == ips[2] != ips[1] and all(0 < int(p) < 256 for ip in ips for p in ip.split("."))
    assert got[3].text.endswith(f"$$$ {ips[0]}")


def test_one_person_with_any_title_and_case(spark):
    people = {
        "smith": ["Mr. John Smith", "John Smith", "Dr John Smith", "JOHN SMITH", "MR. JOHN SMITH", "John SMITH"],
        "weber": ["Dr. Anna Weber", "Frau Anna Weber", "Prof. Dr. Anna Weber", "Anna Weber", "ANNA WEBER"],
        "maria": ["Anna Maria Weber", "Dr. Anna Maria Weber", "Frau Anna Maria Weber"],
        "quince": ["Dr. Xavia Quince", "Mrs. Xavia Quince", "Prof. Xavia Quince"],
        "kennedy": ["John F. Kennedy", "John F Kennedy", "Mr John F. Kennedy"],
        "solo": ["Herr Weiß", "HERR WEISS", "Dr. Weiß"],
    }
    rows = [(i, f"so {m}, and {m}'s own; no more") for i, m in enumerate(m for ms in people.values() for m in ms)]
    got = P.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = {r.doc_id: r for r in got}
    made, i = {}, 0
    for who, mentions in people.items():
        for mention in mentions:
            r = texts[i]
            i += 1
            assert [e.kind for e in r._entities] == ["name", "name"] and r._entities[1].surrogate == r._entities[0].surrogate + "'s"
            title = re.match(r"(?:(?:Mrs?|MR|Dr|Prof|Frau|Herr|HERR)\.? )*", mention)[0]
            assert r._entities[0].surrogate.startswith(title)
            made.setdefault(who, set()).add(r._entities[0].surrogate[len(title) :].lower())
            assert not re.search("smith|weber|maria weber|quince|kennedy|weiß|weiss", r.text, re.I)
    assert all(len(x) == 1 for x in made.values()) and len(set.union(*made.values())) == len(people)
    assert {n.lower() for n in P.GIVEN["f", "latin"]} >= {s.split()[0] for who in ("weber", "maria", "quince") for s in made[who]}


def test_distinct_entities_stay_distinct(spark):
    """A key space smaller than a birthday's worth: ids of nine digits would not collide, addresses of two parts do."""
    rows = [(i, f"a{i // 100}{i % 100:02d}@b.c and 1.2.{i // 250}.{i % 250} or Mr {'ABCDEFGHIJ'[i % 10]}{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'aeiou'[i % 5]}{'bcdfgh'[i // 400]}{chr(97 + i // 26 % 26)}n") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = P.retries(docs)
    assert again is not None and again.count() > 0
    got = {r.doc_id: r for r in P.pseudonymised(docs).collect()}
    mapped = defaultdict(set)
    for i, text in rows:
        real = [text.split(" ")[0], text.split(" ")[2], " ".join(text.split(" ")[4:6])]
        assert [e.kind for e in got[i]._entities] == ["email", "ip", "name"]
        for r, e in zip(real, got[i]._entities):
            mapped[e.kind, e.surrogate].add(r)
    originals = {r for x in mapped.values() for r in x}
    assert all(len(x) == 1 for x in mapped.values())
    assert not originals & {s for _, s in mapped}


def test_clean_and_awkward_rows_are_left_alone(spark):
    docs = awkward(spark)
    out = P.pseudonymised(docs)
    assert out.columns == [*docs.columns, "_entities"]
    assert sorted(str(tuple(r)[:-1]) for r in out.collect()) == sorted(str(tuple(r)) for r in docs.collect())
    assert P.pseudonymised(nothing(spark)).count() == 0
    real = documents(spark)
    before = {r.doc_id: r.text for r in real.collect()}
    for r in P.pseudonymised(real).collect():
        assert (r.text == before[r.doc_id]) == (not r._entities)
        if not re.search(r"\d|@", before[r.doc_id]):
            assert not r._entities


def test_pipeline_equals_its_stages_on_plain_lists(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    good = {r.doc_id for r in quality_rules.verdicts(docs).collect() if r.kept}
    left = docs.where(F.col("doc_id").isin(*good))
    single = {r.doc_id for r in minhash_dedup.near_duplicates(left, k=5).collect() if r.kept}
    left = left.where(F.col("doc_id").isin(*single))
    clean = {r.doc_id: r for r in secret_scans.redact(left).collect()}
    assert not any(secret_scans.all_spans(r.text)[1] for r in clean.values())
    copies = {r.doc_id: r.copies for r in source_mix.mix(secret_scans.redact(left)).collect()}
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append(r)
    from farelake.llm.packing import Encoder, default_vocabulary

    encode = Encoder(default_vocabulary())
    assert {k: sum(p.start == 0 for p in v) for k, v in whole.items()} == {k: n for k, n in copies.items() if n}
    for key, pieces in whole.items():
        n = len(encode(clean[key].text)) // 2 + 1
        assert all(p.doc_tokens == n for p in pieces) and sum(p.length for p in pieces) == n * copies[key]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scans", "source mix", "packing"]


def plain_mentions(text):
    """(kind, mention) of a text, by the same patterns without Spark."""
    import regex

    found = regex.findall(P.ANY, text or "") if regex.search(P.HINT, text or "") else []
    kinds = [next((k for k in P.KINDS[:-1] if regex.fullmatch(P.PATTERNS[k], m)), "name") for m in found]
    return list(zip(kinds, found)), regex.split(P.ANY, text or "")


def plain_entity(kind, mention):
    import regex

    digits = re.sub("[^0-9]", "", mention)
    if kind in ("card", "ssn"):
        return digits
    if kind == "phone":
        code = regex.match(r"\+(1|7|\d{1,3}(?=[ .(-])|\d{2})", mention)
        return digits[len(code[1]) if code else 0 :]
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "name":
        bare = regex.sub(P._POSSESSIVE, "", regex.sub(P._LEADING, "", mention)).replace(".", "").lower().replace("ß", "ss")
        return regex.sub(r"σ(?!\p{L})", "ς", bare)
    return mention.lower()


def hold_against_plain(rows, got):
    """Every mention found, nothing else changed, one surrogate an entity, one entity a surrogate, none of them real."""
    made, real = defaultdict(set), set()
    for key, text in rows:
        mentions, between = plain_mentions(text)
        entities = [(k, plain_entity(k, m)) for k, m in mentions]
        persons = {e for k, e in entities if k == "name" and " " in e}
        of = got[key]
        assert [e.kind for e in of._entities] == [k for k, _ in mentions]
        if mentions:
            assert of.text == "".join(a + b for a, b in zip(between, [e.surrogate for e in of._entities] + [""]))
        for (kind, mention), (_, entity), e in zip(mentions, entities, of._entities):
            same = [p for p in persons if p.split(" ")[-1] == entity] if kind == "name" and " " not in entity else []
            real.add((kind, entity))
            if len(same) == 1:
                assert plain_entity(kind, e.surrogate) in {s.split(" ")[-1] for k, p in made if (k, p) == (kind, same[0]) for s in made[k, p]} | {None} or (kind, same[0]) not in made
            else:
                made[kind, entity].add(plain_entity(kind, e.surrogate))
    assert all(len(s) == 1 for s in made.values())
    pairs = [(k, s) for (k, _), (s,) in made.items()]
    assert len(set(pairs)) == len(pairs) and not set(pairs) & real


def test_equal_to_plain_detection_on_all_documents(spark):
    docs = documents(spark, "sf0.01").select("doc_id", "text")
    got = {r.doc_id: r for r in P.pseudonymised(docs).collect()}
    assert sum(len(r._entities) for r in got.values()) > 50
    hold_against_plain([tuple(r) for r in docs.collect()], got)


def test_a_format_that_is_used_up_ends(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(0, " ".join(f"{a}@{b}.co" for a in letters for b in letters))] + [(1 + i, f"call +1 23 {i:02d}") for i in range(100)]
    got = {r.doc_id: r for r in P.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    made = [e.surrogate for e in got[0]._entities]
    assert len(set(made)) == 676 and not set(made) & set(rows[0][1].split(" ")) and all(re.fullmatch(r"[a-z]+@[a-z]\.co", m) for m in made)
    phones = [re.sub(r"\D", "", got[i]._entities[0].surrogate) for i in range(1, 101)]
    assert len(set(phones)) == 100 and not set(phones) & {f"123{i:04d}"[-6:] for i in range(100)}


def test_a_family_name_alone_is_the_person_of_its_text(spark):
    rows = [(0, "Mr. John Smith met. Then Mr. Smith left, SMITH'S dog, Mr SMITH'S dog."), (1, "Mr. Smith was alone."), (2, "Mary Smith and John Smith saw Mrs. Smith"), (3, "Mr. John Smith")]
    got = {r.doc_id: r for r in P.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    full, family, again = (e.surrogate for e in got[0]._entities)
    assert family == "Mr. " + full.split(" ")[-1] and again.lower() == f"mr {full.split(' ')[-1]}'s".lower()
    assert got[3].text == full and got[2]._entities[1].surrogate == full.removeprefix("Mr. ")
    other = {got[1]._entities[0].surrogate.split(" ")[-1], got[2]._entities[2].surrogate.split(" ")[-1]}
    assert len(other) == 1 and full.split(" ")[-1] not in other


def test_marked_rows_are_the_only_ones_joined(spark, monkeypatch):
    rows = [(i, f"Mrs. Xavia Quince{'abcdefghij'[i % 10]} has {i} mails") for i in range(50)] + [(100, "Dr. Xavia Quincea"), (101, "nothing here"), (102, "a@b.example")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r.doc_id: r.text for r in P.pseudonymised(docs).collect()}
    monkeypatch.setattr(P, "FEW", 0)
    assert {r.doc_id: r.text for r in P.pseudonymised(docs).collect()} == few
    texts = P.marked(docs)
    known = P.untold(texts)
    assert [r.entity for r in known.collect()] == ["xavia quincea"]
    touched = {r[0] for r in texts.where(P._touched(P._bitmap(known))).select("doc.doc_id").collect()}
    assert touched == {i for i in range(0, 50, 10)} | {100}
