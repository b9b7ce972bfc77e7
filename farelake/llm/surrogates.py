"""Personal data: detected entities are replaced by keyed surrogates of their own type and format.

Detection is one pattern per kind, matched left to right. The canonical form of an entity (digits of a number,
lower case of an address or name) decides its surrogate, so every mention of an entity, however it is written, gets the
same one in all documents. A surrogate is made from a keyed SHA-512 of kind, canonical form and attempt:

* email: each letter or digit by one of its class, separators and the last label stay;
* card, phone, id number: each digit by a digit, punctuation stays; a card keeps its first digit, and its check digit
  stays valid if it was; a phone keeps its country code; an IBAN keeps its country;
* IP: another valid address; its number of parts stays;
* name: title stays as written and is no part of the entity, the given name is one of the same gender and script, the
  family name is made of syllables of the same script; capitals stay. A name takes all its capitalised words. Its gender is
  that of its titles anywhere in the corpus, or else of its given name.

A family name alone ("Mr. Smith") is the person of that document with that last name, if there is just one, and gets the
family part of that person's surrogate; otherwise it is an entity of its own.

Collision checks run over the distinct entities of the whole corpus: if two entities of a kind have the same
surrogate, or a surrogate is a real entity of the corpus, all but the first take their next attempt, until none collide.
From attempt ``LONGER`` on a surrogate has more letters or digits than its entity, so a format whose space is used up
(all addresses ``x@y.co``) ends too. The tables hold one row per distinct entity, counted before they move.

Texts are searched once, and written with their mentions. Entities that needed another attempt, or whose gender not every
mention tells, are marked in a bitmap of fixed size. Rows without a marked entity are finished where they lie; only the
others are joined with what is known of theirs.

Outputs never hold an original. Defined results: null text stays null, empty text stays empty, both with no
entities; repeated rows get the same replacements; a null document key is allowed; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelake.llm.tables import stored

DEFAULT_KEY = "replace-me"
#: From this attempt on, surrogates grow by a letter or digit an attempt.
LONGER = 4
#: Bits of the bitmap of entities that need more than their own text tells (its size does not follow the corpus; where it
#: fills up, more rows are joined).
BITS = 1 << 20
#: Entities told to rows that are broadcast (a few hundred bytes each); beyond, marked rows are shuffled, no others.
FEW = 20_000
# Word lists by gender and script, and alphabets of the scripts that are kept.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Catherine Christine Claudia Diana Elena Elizabeth Emma Eva Helen Jane Julia Laura Linda Lucia Maria Marie Martha Mary Monica Patricia Paula Rosa Sarah Sofia Susan Teresa".split(),
    ("m", "latin"): "Albert Alexander Andrew Anthony Carlos Charles Daniel David Edward Frank George Hans Henry James Jean John Joseph Karl Luis Mark Martin Michael Paul Peter Pierre Richard Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Владимир Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Άννα Βασιλική Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "greek"): "Ανδρέας Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Mme Madame Señora Sra Signora г-жа κα".split(),
    "m": "Mr Herr Monsieur Señor Signor г-н κος".split(),
    "x": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa so ta te".split(),
    "cyrillic": "ба ве го да жи за ка ле ми но па ро са ту фе хо".split(),
    "greek": "βα γε δο ζα θε κα λο μα νε πα ρο σα τε φα χο ψα".split(),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

def _written(words: list[str]) -> str:
    """Each word as listed, with a capital, and in capitals."""
    return "|".join(dict.fromkeys(v for w in words for v in (w, w[0].upper() + w[1:], w.upper())))


_TITLES = {g: _written(group) for g, group in TITLES.items()}
_TITLE = "|".join(_TITLES.values())
_KNOWN = _written([n for names in GIVEN.values() for n in names])
#: Where a title or a listed name can begin: one look at the first letter rules out nearly every place.
_START = r"(?=[\p{Lu}гκ])(?<![\p{L}\p{N}])"
_CAP = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: The capitalised words, or initials before one, that follow in a name.
_MORE = rf"(?: (?:{_CAP}|\p{{Lu}}\.?(?= \p{{Lu}})))"
_POSSESSIVE = r"['’][sS]$"
_LEADING = rf"^(?:(?:{_TITLE})\.? )+"
#: Kind -> pattern, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])",
    "name": rf"{_START}(?:(?:(?:{_TITLE})\.? )+(?:{_CAP}|\p{{Lu}}\.?(?= \p{{Lu}})){_MORE}*|(?:{_KNOWN}){_MORE}+)(?![\p{{L}}\p{{N}}])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match has a digit, an @, a title or a listed name; other texts are not searched further.
HINT = rf"[\d@]|{_START}(?:{_TITLE}|{_KNOWN})[. ]"


def kind_of(mention: Column) -> Column:
    out = F.when(mention.rlike(rf"^(?:{PATTERNS['email']})$"), "email")
    for kind in KINDS[1:]:
        out = out.when(mention.rlike(rf"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("name")


def _country(mention: Column) -> Column:
    """A phone number's country code, as far as it is written."""
    return F.regexp_extract(mention, r"^\+(1|7|\d{1,3}(?=[ .(-])|\d{2})", 1)


def canonical(kind: Column, mention: Column) -> Column:
    """What all ways of writing an entity share: a number's digits (a phone's without its country code), an IBAN
    without spaces, lower case, a name without its titles, dots and possessive ending, all letters folded."""
    bare = F.regexp_replace(mention, "[^0-9]", "")
    national = F.substring(bare, F.length(_country(mention)) + 1, F.length(bare))
    return F.when(kind == "phone", national).when(kind.isin("card", "ssn"), bare).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind == "name", _folded(F.replace(F.regexp_replace(F.regexp_replace(mention, _LEADING, ""), _POSSESSIVE, ""), F.lit("."), F.lit("")))).otherwise(F.lower(mention))


def _folded(name: Column) -> Column:
    """Lower case, with what capitals do not tell apart: ß is ss, a last sigma has its own form."""
    return F.regexp_replace(F.replace(F.lower(name), F.lit("ß"), F.lit("ss")), r"σ(?!\p{L})", "ς")


def _title_gender(kind: Column, mention: Column) -> Column:
    """f, m or nothing, as a name's titles say."""
    of = lambda g: (kind == "name") & mention.rlike(rf"^(?:(?:{_TITLE})\.? )*(?:{_TITLES[g]})\.? ")
    return F.when(of("f"), "f").when(of("m"), "m").otherwise("")


def _given_gender(entity: Column) -> Column:
    """f, m or nothing, as the first of a name's words says."""
    first = F.substring_index(entity, " ", 1)
    listed = {g: [n.lower() for (x, _), names in GIVEN.items() if x == g for n in names] for g in "fm"}
    return F.when(first.isin(*listed["f"]), "f").when(first.isin(*listed["m"]), "m").otherwise("")


def _gender(title: Column, kind: Column, entity: Column) -> Column:
    return F.when(kind != "name", "").when(title != "", title).otherwise(_given_gender(entity))


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can make."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 512)), 512)


def _draw(stream: Column, i: Column, n: int | Column) -> Column:
    """The i-th number below n (three hexadecimal digits each, from the start again after 42)."""
    three = F.substring(stream, (F.pmod(i, F.lit(42)) * 3 + 1).cast("int"), F.lit(3))
    return F.pmod(F.conv(three, 16, 10).cast("int") + i.cast("int") * 7, n if isinstance(n, Column) else F.lit(n))


def _pick(values: list[str], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def _drawn_char(c: Column, n: Column) -> Column:
    """A character of the same class, case and script as ``c``, the ``n``-th of its alphabet; any other as it is.
    Letters with marks become plain letters of the Latin script."""
    low = F.lower(c)
    letters = F.when(F.instr(F.lit("0123456789"), c) > 0, "0123456789").when(F.instr(F.lit(ALPHABETS["cyrillic"]), low) > 0, ALPHABETS["cyrillic"]).when(F.instr(F.lit(ALPHABETS["greek"]), low) > 0, ALPHABETS["greek"]).when(c.rlike(r"^\p{L}$"), ALPHABETS["latin"])
    new = F.substring(letters, F.pmod(n, F.length(letters)).cast("int") + 1, F.lit(1))
    return F.coalesce(F.when(c == low, new).otherwise(F.upper(new)), c)


def _redrawn(entity: Column, stream: Column, kept: Column) -> Column:
    """Every character after the first ``kept`` redrawn in its class."""
    chars = F.split(entity, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(i < kept, c).otherwise(_drawn_char(c, _draw(stream, i, 4096)))), "")


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after ``digits``."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.pmod(10 - F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10, F.lit(10)).cast("int")


def _script(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name(entity: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    script = _script(entity)
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in SYLLABLES:
        of = {g: _pick([n.lower() for n in GIVEN[g, s]], _draw(stream, F.lit(0), len(GIVEN[g, s]))) for g in "fm"}
        any_ = F.when(_draw(stream, F.lit(1), 2) == 0, of["f"]).otherwise(of["m"])
        given = F.when(script == s, F.when(gender == "f", of["f"]).when(gender == "m", of["m"]).otherwise(any_)).otherwise(given)
        made = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(5) + attempt), _syllables(s, stream)), "")
        family = F.when(script == s, made).otherwise(family)
    return F.when(F.instr(entity, " ") > 0, F.concat_ws(" ", given, family)).otherwise(family)


def _syllables(script: str, stream: Column):
    return lambda i: _pick(SYLLABLES[script], _draw(stream, i, len(SYLLABLES[script])))


def _drawn(kind: Column, entity: Column, attempt: Column, gender: Column, stream: Column) -> Column:
    """Canonical form of the surrogate of a canonical entity."""
    last_dot = F.length(entity) - F.length(F.substring_index(entity, ".", -1)) - 1
    # which characters are redrawn: from ``first`` on, up to ``end``
    first = F.when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)
    end = F.when(kind == "email", last_dot).when(kind == "card", F.length(entity) - 1).otherwise(F.length(entity))
    body = _redrawn(F.substring(entity, F.lit(1), end), stream, first)
    tail = F.substring(entity, end + 1, F.length(entity))
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda p, i: (_draw(stream, i, 254) + 1).cast("string")), ".")
    phone = F.concat((_draw(stream, F.lit(30), 8) + 2).cast("string"), F.substring(body, F.lit(2), F.length(body)))
    number = F.when(kind == "card", F.concat(body, _check_digit(entity, body, stream))).when(kind == "phone", phone).otherwise(F.concat(body, tail))
    letters, digits = (_more(stream, attempt, a) for a in (ALPHABETS["latin"], "0123456789"))
    return F.when(kind == "name", _name(entity, stream, attempt, gender)).when(kind == "ip", ip).when(kind == "email", F.concat(letters, number)).otherwise(F.concat(number, digits))


def _more(stream: Column, attempt: Column, alphabet: str) -> Column:
    """What a late attempt adds."""
    extra = F.when(attempt >= LONGER, F.sequence(F.lit(1), attempt - LONGER + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(extra, lambda i: F.substring(F.lit(alphabet), _draw(stream, i + 20, len(alphabet)).cast("int") + 1, F.lit(1))), "")


def _check_digit(entity: Column, body: Column, stream: Column) -> Column:
    """The last digit of a card: valid if the entity's is."""
    ends = F.transform(F.array(body, F.substring(entity, F.lit(1), F.length(entity) - 1)), _luhn)
    valid = F.get(ends, F.lit(1)).cast("string") == F.substring(entity, -1, 1)
    return F.pmod(F.get(ends, F.lit(0)) + F.when(valid, 0).otherwise(1 + _draw(stream, F.lit(20), 9)), F.lit(10)).cast("string")


def surrogates_of(key: str, entities: Column) -> Column:
    """An array of structs with kind, entity, attempt and gender, each with ``made`` in place of the attempt. The keyed
    digits of an entity are made once, before everything that is drawn from them."""
    streamed = F.transform(entities, lambda e: F.struct(e.alias("e"), _stream(key, e["kind"], e["entity"], e["attempt"]).alias("stream")))
    return F.transform(streamed, lambda x: F.struct(x["e"].alias("e"), _drawn(x["e"]["kind"], x["e"]["entity"], x["e"]["attempt"], x["e"]["gender"], x["stream"]).alias("made")))


def written_like(mention: Column, kind: Column, made: Column) -> Column:
    """The canonical surrogate in the mention's own way of writing."""
    chars = F.split(mention, "")
    before = lambda i, what: F.regexp_count(F.substring(mention, F.lit(1), (i + 1).cast("int")), F.lit(what))
    code = F.when(kind == "phone", F.length(_country(mention))).otherwise(0)
    # a longer surrogate has its further digits at the end, its further letters in front
    rest = lambda used: F.substring(made, used + 1, F.greatest(F.length(made) - used, F.lit(0)))
    numbered = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$") & (before(i, "[0-9]") > code), F.substring(made, (before(i, "[0-9]") - code).cast("int"), F.lit(1))).otherwise(c)), "")
    numbered = F.concat(numbered, rest(F.regexp_count(mention, F.lit("[0-9]")) - code))
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, before(i, "[^ ]").cast("int"), F.lit(1)))), "")
    spaced = F.concat(spaced, rest(F.regexp_count(mention, F.lit("[^ ]"))))
    more = F.greatest(F.length(made) - F.length(mention), F.lit(0))
    at = lambda i: F.substring(made, (i + 1).cast("int") + more, F.lit(1))
    cased = F.concat(F.substring(made, F.lit(1), more), F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(at(i))).otherwise(at(i))), ""))
    bare = F.regexp_replace(F.regexp_replace(mention, _LEADING, ""), _POSSESSIVE, "")
    person = F.when(bare == F.upper(bare), F.upper(made)).otherwise(F.initcap(made))
    titled = F.concat(F.regexp_extract(mention, f"({_LEADING})?", 0), person, F.regexp_extract(mention, _POSSESSIVE, 0))
    return F.when(kind.isin("card", "ssn", "phone"), numbered).when(kind == "iban", spaced).when(kind == "email", cased).when(kind == "name", titled).otherwise(made)


def _first(column: Column) -> Column:
    return F.get(column, F.lit(0))


def _of_row(key: str) -> Column:
    """The surrogate of a row's kind, entity, attempt and gender."""
    return _first(surrogates_of(key, F.array(F.struct("kind", "entity", "attempt", "gender"))))["made"]


def _each(found: Column) -> Column:
    """Array of (mention, kind, entity, title, alone) of a text's mentions. ``alone``: a family name that stands for the
    only person of the text with that last name, whose entity it has."""
    each = F.transform(found, lambda m: F.struct(m.alias("mention"), kind_of(m).alias("kind")))
    each = F.transform(each, lambda e: F.struct(e["mention"].alias("mention"), e["kind"].alias("kind"), canonical(e["kind"], e["mention"]).alias("entity"), _title_gender(e["kind"], e["mention"]).alias("title")))
    # in an array of one, so that the persons are looked up once a text
    with_persons = F.transform(F.array(each), lambda a: F.struct(a.alias("all"), _persons(a).alias("persons")))
    return F.get(F.transform(with_persons, lambda s: F.transform(s["all"], lambda e: _resolved(e, s["persons"]))), F.lit(0))


def _persons(all_: Column) -> Column:
    """Distinct names of more than one word."""
    names = F.filter(all_, lambda e: (e["kind"] == "name") & (F.instr(e["entity"], " ") > 0))
    return F.array_distinct(F.transform(names, lambda e: e["entity"]))


def _resolved(e: Column, persons: Column) -> Column:
    single = (e["kind"] == "name") & (F.instr(e["entity"], " ") == 0)
    of = F.filter(persons, lambda p: F.substring_index(p, " ", -1) == e["entity"])
    alone = single & (F.size(of) == 1)
    return F.struct(e["mention"].alias("mention"), e["kind"].alias("kind"), F.when(alone, _first(of)).otherwise(e["entity"]).alias("entity"), e["title"].alias("title"), alone.alias("alone"))


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text searched once, and written: row (a number of its own), doc (the other columns), text (if it has no
    mention), between (the parts around its mentions) and each (its mentions)."""
    column = F.col(f"`{text}`")
    found = F.when(column.rlike(HINT), F.regexp_extract_all(column, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("doc"), column.alias("text"), F.coalesce(found, F.array().cast("array<string>")).alias("found"))
    some = F.size("found") > 0
    rows = rows.select("doc", F.when(~some, F.col("text")).alias("text"), F.when(some, F.split("text", ANY, -1)).alias("between"), F.when(some, _each(F.col("found"))).otherwise(F.lit(None)).alias("each"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")


def retries(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY) -> DataFrame | None:
    """``untold`` of the rows of a table."""
    return untold(marked(docs, text), key)


def untold(texts: DataFrame, key: str = DEFAULT_KEY) -> DataFrame | None:
    """(kind, entity, attempt, gender) of the entities whose first surrogate collides or whose gender some mention does
    not tell; None if there are none. ``texts``: as ``marked`` gives them."""
    mentions = texts.select(F.explode("each").alias("e")).select("e.kind", "e.entity", "e.title")
    titles = {f"_{g or 'x'}": F.max(F.col("title") == g) for g in ("f", "m", "")}
    entities = mentions.groupBy("kind", "entity").agg(F.lit(0).alias("attempt"), *(c.alias(n) for n, c in titles.items()))
    one = F.when(F.col("_f") & ~F.col("_m"), "f").when(F.col("_m") & ~F.col("_f"), "m").otherwise("")
    entities = entities.withColumn("gender", _gender(one, F.col("kind"), F.col("entity")))
    silent = F.col("_x") & (_gender(F.lit(""), F.col("kind"), F.col("entity")) != F.col("gender"))
    entities = entities.withColumn("mixed", (F.col("_f") & (F.col("gender") != "f")) | (F.col("_m") & (F.col("gender") != "m")) | silent).drop(*titles)
    entities = stored(entities.withColumn("made", _of_row(key)), "entities")
    real = entities.select("kind", F.col("entity").alias("made"))
    while True:
        taken = entities.groupBy("kind", "made").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "made", F.col("first.entity").alias("owner"))
        twice = entities.join(taken, ["kind", "made"]).where("entity <> owner").select("kind", "entity")
        known = entities.join(real, ["kind", "made"], "left_semi").select("kind", "entity")
        again = stored(twice.unionByName(known).distinct(), "again")
        if not again.limit(1).count():
            known = entities.where("attempt > 0 or mixed").select("kind", "entity", "attempt", "gender")
            return known if known.limit(1).count() else None
        next_ = entities.join(again.withColumn("retry", F.lit(1)), ["kind", "entity"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("retry", F.lit(0)))
        entities = stored(next_.withColumn("made", F.when(F.col("retry") == 1, _of_row(key)).otherwise(F.col("made"))).drop("retry"), "entities")


def _bit(kind: Column, entity: Column) -> Column:
    return F.pmod(F.xxhash64(kind, entity), F.lit(BITS)).cast("int")


def _bitmap(known: DataFrame) -> Column:
    """A literal with the bits of all known entities: BITS / 8 bytes, whatever their number."""
    bit = _bit(F.col("kind"), F.col("entity"))
    bytes_ = known.groupBy((bit / 8).cast("int").alias("at")).agg(F.bit_or(F.pow(F.lit(2), bit % 8).cast("int")).alias("value"))
    out = bytearray(BITS // 8)
    for at, value in bytes_.collect():  # at most BITS / 8 rows
        out[at] = value
    return F.lit(bytes(out))


def _touched(bitmap: Column) -> Column:
    """Whether some mention of the row has its bit set."""

    def set_(e: Column) -> Column:
        bit = _bit(e["kind"], e["entity"])
        byte = F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1

    return F.coalesce(F.exists("each", set_), F.lit(False))


def _finished(rows: DataFrame, key: str, tries: Column) -> DataFrame:
    """(doc, text, found) with surrogates in place of mentions. ``tries``: what is known of the row's entities."""
    each = F.transform("each", lambda e: F.struct(*(e[c].alias(c) for c in ("mention", "kind", "entity", "title", "alone")), F.element_at(tries, F.concat_ws("|", e["kind"], e["entity"])).alias("known")))
    each = F.transform(each, lambda e: F.struct(*(e[c].alias(c) for c in ("mention", "kind", "entity", "alone")), F.coalesce(e["known"]["attempt"], F.lit(0)).alias("attempt"), F.coalesce(e["known"]["gender"], _gender(e["title"], e["kind"], e["entity"])).alias("gender")))
    rows = rows.withColumn("made", surrogates_of(key, each))
    said = lambda x: F.when(x["e"]["alone"], F.substring_index(x["made"], " ", -1)).otherwise(x["made"])
    found = F.transform("made", lambda x: F.struct(x["e"]["kind"].alias("kind"), written_like(x["e"]["mention"], x["e"]["kind"], said(x)).alias("surrogate")))
    rows = rows.withColumn("found", F.coalesce(found, F.array().cast("array<struct<kind:string,surrogate:string>>")))
    joined = F.array_join(F.zip_with("between", "found", lambda a, b: F.concat(a, F.coalesce(b["surrogate"], F.lit("")))), "")
    return rows.select("doc", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"), "found")


def pseudonymised(docs: DataFrame, text: str = "text", key: str = DEFAULT_KEY, found: str = "_entities") -> DataFrame:
    """The rows with surrogates in ``text``; ``found`` is added: an array of (kind, surrogate) in text order."""
    texts = marked(docs, text)
    known = untold(texts, key)
    none = F.lit(None).cast("map<string,struct<attempt:int,gender:string>>")
    if known is None:
        out = _finished(texts, key, none)
    else:
        touched = _touched(_bitmap(known))
        own = texts.where(touched).select("row", F.explode("each").alias("e")).select("row", "e.kind", "e.entity").distinct().join(known, ["kind", "entity"])
        own = stored(own, "told")
        lists = own.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "entity"), F.struct("attempt", "gender")))).alias("tries"))
        if own.limit(FEW + 1).count() <= FEW:
            out = _finished(texts.join(F.broadcast(lists), "row", "left"), key, F.col("tries"))
        else:
            joined = texts.where(touched).join(lists, "row", "left")
            out = _finished(texts.where(~touched), key, none).unionByName(_finished(joined, key, F.col("tries")))
    columns = [F.col("text").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns, F.col("found").alias(found))
