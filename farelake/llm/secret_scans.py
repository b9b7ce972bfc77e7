"""Secret scans: base patterns plus a recursive decoding worklist.

A document's text is scanned for the base kinds. Then every layer that the text wraps is opened and scanned
too: percent escapes, Unicode escapes, base64 runs, and gzip or zlib data (all its members) inside any of these. Opened layers
join a worklist until nothing new opens (a fixpoint); a layer already seen at the same place is not opened
again (cycle detection). Each character of a layer knows the span of the original text it came from, so a find
in any layer maps to a span there: to its own escapes where the layer was escaped, to the whole run
where it was base64 or compressed, and to the characters of its own stretch of text where the run holds more than text.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one; extra columns
pass through ``redact`` untouched. A compressed layer of more than ``MAX_LAYER_BYTES`` is read to its end in pieces that
overlap, in bounded memory, as all its finds map to one span: the kinds found are reported there. What runs on from
piece to piece inside it (compressed data, base64) is decoded as it comes. Only a run of escapes longer than the overlap
inside such a layer is not followed as bytes; the layer is then of kind ``opaque`` too, so nothing is passed over in silence.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from farelake.llm.text_arrays import chunks

# The base kinds, in their order.
KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
MIN_VALUE, MIN_ACCESS = 6, 20

#: The largest layer that is held whole; a larger one is read in pieces, each with the end of the one before.
MAX_LAYER_BYTES = 16 << 20
PIECE_BYTES, OVERLAP_BYTES = 4 << 20, 1 << 16
MIN_BASE64 = 16
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+\r?\n)+[A-Za-z0-9+/_-]+={0,2}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]+)\}|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
#: Runs in which escapes and literal characters together may be bytes, and the bytes of them one by one.
_PERCENT_RUN = re.compile(r"[!-~]+")
_PERCENT_BYTE = re.compile(r"%(?P<hex>[0-9A-Fa-f]{2})|(?P<plain>.)")
_ESCAPE_RUN = re.compile(r"[ -~\x80-\xff]+")
_ESCAPE_BYTE = re.compile(r"\\u(?P<hex4>[0-9A-Fa-f]{4})|\\u\{(?P<hex6>[0-9A-Fa-f]{1,6})\}|\\U(?P<hex8>[0-9A-Fa-f]{8})|\\x(?P<hex>[0-9A-Fa-f]{2})|&#(?P<ent>[0-9]{1,7});|&#[xX](?P<hexent>[0-9A-Fa-f]{1,6});|\\(?P<octal>[0-3]?[0-7]{1,2})|\\(?P<short>[abefnrtv\\'\"/])|(?P<plain>.)")
_SHORT = dict(zip("abefnrtv", map(ord, "\a\b\x1b\f\n\r\t\v")))
_KEYWORD = r"(?i)password|passwd|secret|token|api_?key"

#: The least text that can hold a find ("token=" and a value of 6), as bytes of text and as bytes of UTF-16.
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_ASCII = re.compile(r"[\t\n\r\x20-\x7e]{12,}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){11}|(?:\x00[\t\n\r\x20-\x7e]){11}")
#: Where gzip or zlib data (without a preset dictionary) may begin.
_MAGIC = re.compile(b"\x1f\x8b\x08|" + b"|".join(re.escape(bytes([c, f])) for c in range(0x08, 0x80, 16) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20))
_MEMBER = re.compile(b"\\x00*(" + _MAGIC.pattern + b")", re.S)  # members may have zeros between them
FEED_BYTES = 1 << 12
_PIECE = re.compile(r"[A-Za-z0-9]{%d,}={0,2}" % MIN_BASE64)

Span = tuple[int, int, int]  # start, place in KINDS, end
Origin = Callable[[int, int], tuple[int, int]]  # the characters that bytes i..j-1 came from


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


class Layer:
    """A text and, for its parts, the original span they came from.

    ``parts`` lists (first character, original start, step): with step 1 the characters from there on stand for
    one original character each; with step 0 each of them stands for original start..stop of its part.
    """

    def __init__(self, text: str, parts: list[tuple[int, int, int, int]]):
        self.text, self.parts = text, parts  # (at, start, stop, step)
        self._at = [p[0] for p in parts]

    @classmethod
    def root(cls, text: str) -> Layer:
        return cls(text, [(0, 0, len(text), 1)])

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The original span of the characters a..b-1."""
        at, start, _, step = self.parts[bisect.bisect_right(self._at, a) - 1]
        first = start + (a - at) * step
        at, start, stop, step = self.parts[bisect.bisect_right(self._at, b - 1) - 1]
        return first, start + (b - at) if step else stop

    def rewritten(self, pieces: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer | None:
        """This layer with each (a, b, [(text, from, to), ...]) in place of a..b."""
        out, parts, n, done = [], [], 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal n
            k = bisect.bisect_right(self._at, a) - 1
            while a < b:
                at, start, stop, step = self.parts[k]
                end = min(b, self.parts[k + 1][0] if k + 1 < len(self.parts) else b)
                parts.append((n, start + (a - at) * step, stop, step))
                out.append(self.text[a:end])
                n += end - a
                a, k = end, k + 1

        for a, b, made in pieces:
            copy(done, a)
            for text, x, y in made:
                start, stop = self.origin(x, y)
                parts.append((n, start, stop, 0))
                out.append(text)
                n += len(text)
            done = b
        copy(done, len(self.text))
        text = "".join(out)
        return Layer(text, parts) if text != self.text else None


def readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if text and all(c.isprintable() or c in "\t\n\r" for c in text) else None


def inflate(data: bytes, at: int = 0) -> tuple[bytes, int, bool] | None:
    """What the gzip or zlib data from ``at`` on holds, all members that follow one another together, where it ends and
    whether its end was met; None if it holds nothing; raises MemoryError (see ``large_kinds``) if that is more than MAX_LAYER_BYTES."""
    out, size, end, ended = [], 0, at, False
    while m := _MEMBER.match(data, end):
        machine, before, begin = zlib.decompressobj(47), size, m.start(1)
        try:
            while begin < len(data) and not machine.eof:
                feed = data[begin : begin + FEED_BYTES]
                begin += len(feed)
                while feed and not machine.eof:
                    out.append(machine.decompress(feed, MAX_LAYER_BYTES + 1 - size))
                    feed = machine.unconsumed_tail
                    size += len(out[-1])
                    if size > MAX_LAYER_BYTES:
                        raise MemoryError
        except zlib.error:
            pass
        if not machine.eof:  # damaged or cut off: what was read counts
            if size > before:
                end, ended = len(data), False
            break
        end, ended = begin - len(machine.unused_data), True
    return (b"".join(out), end, ended) if size else None


def _text_layers(layer: Layer, data: bytes, origin: Origin) -> list[Layer]:
    """The bytes as text. The base patterns and all escapes are ASCII, so bytes that are no UTF-8 are read as
    latin-1, each stretch of text in them with its own span; what may be UTF-16 is read so at both places and orders."""
    out = []
    try:
        out.append(Layer(data.decode(), [(0, *origin(0, len(data)), 0)]))
    except UnicodeDecodeError:
        parts, done = [], 0
        for m in _STRETCH.finditer(data):
            if m.start() > done:
                parts.append((done, *origin(done, m.start()), 0))
            parts.append((m.start(), *origin(*m.span()), 0))
            done = m.end()
        if parts:
            if done < len(data):
                parts.append((done, *origin(done, len(data)), 0))
            out.append(Layer(data.decode("latin-1"), parts))
    if _WIDE.search(data):
        for first in (0, 1):
            for order in "<>":
                units = np.frombuffer(data, f"{order}u2", (len(data) - first) // 2, first).astype("<u2")
                text = np.where((units >= 0xD800) & (units < 0xE000), 0xFFFD, units).astype("<u2").tobytes().decode("utf-16-le")
                if readable(text.lstrip("﻿").encode()):
                    out.append(Layer(text, [(0, *origin(0, len(data)), 0)]))
                    continue
                parts, done = [], 0
                for m in _ASCII.finditer(text):
                    if m.start() > done:
                        parts.append((done, *origin(first + 2 * done, first + 2 * m.start()), 0))
                    parts.append((m.start(), *origin(first + 2 * m.start(), first + 2 * m.end()), 0))
                    done = m.end()
                if parts:
                    if done < len(text):
                        parts.append((done, *origin(first + 2 * done, first + 2 * len(text)), 0))
                    out.append(Layer(text, parts))
    return [Layer(new.text, [(at, *layer.origin(a, b), 0) for at, a, b, _ in new.parts]) for new in out if new.text]


def _segment(layer: Layer, data: bytes, origin: Origin, plain: bool = True) -> tuple[list[Layer], list[Span]]:
    """Layers, and opaque spans, that decoded bytes give; ``origin`` tells which characters of ``layer`` bytes came
    from. Compressed data is opened wherever it begins. Without ``plain`` only UTF-16 is read as text itself."""
    layers, spans, seen = [], [], set()
    work = [(data, origin, plain)]
    while work:
        data, origin, plain = work.pop()
        if plain or _WIDE.search(data):
            layers += _text_layers(layer, data, origin)
        done = 0
        while m := _MAGIC.search(data, done):
            done = m.start() + 1
            try:
                got = inflate(data, m.start())
            except MemoryError:
                kinds, end, ended = large_kinds(data, m.start())
                a, b = layer.origin(*origin(m.start(), end))
                spans += [(a, kind, b) for kind in sorted(kinds)]
                done = end if ended else done
                continue
            if got is None:
                continue
            if got[2]:
                done = got[1]
            key = hashlib.sha1(got[0]).digest()
            if key not in seen:
                seen.add(key)
                work.append((got[0], _whole(*origin(m.start(), got[1])), True))
    return layers, spans


class Inflating:
    """One gzip or zlib member, chunk by chunk; done when its end, or damage, was met."""

    def __init__(self):
        self.machine, self.done, self.size = zlib.decompressobj(47), False, 0

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        try:
            while chunk and not self.machine.eof:
                out = self.machine.decompress(chunk, PIECE_BYTES)
                chunk = self.machine.unconsumed_tail
                self.size += len(out)
                yield out
        except zlib.error:
            self.done = True
        self.done |= self.machine.eof


class Decoding64:
    """A base64 run, wrapped or not, from one of its four alignments on, chunk by chunk; done when the run ends."""

    ALPHABET = bytes(sorted(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-\r\n"))

    def __init__(self, skip: int):
        self.skip, self.rest, self.done = skip, b"", False

    def feed(self, chunk: bytes) -> Iterator[bytes]:
        run = chunk[: len(chunk) - len(chunk.lstrip(self.ALPHABET))]
        self.done = len(run) < len(chunk)
        body = self.rest + run.translate(None, b"\r\n").replace(b"-", b"+").replace(b"_", b"/")
        if self.skip and body:
            body, self.skip = body[self.skip :], max(0, self.skip - len(body))
        whole = len(body) // 4 * 4
        self.rest = body[whole:]
        yield base64.b64decode(body[:whole])


class Stream:
    """The kinds found, in any layer, in bytes that come chunk by chunk: each piece is scanned with the end of the one before,
    equal pieces once. Compressed data and base64 that a piece does not hold whole feed streams of their own."""

    def __init__(self):
        self.kinds: set[int] = set()
        self._new, self._tail, self._seen = bytearray(), b"", set()
        self._open: list[tuple[Inflating | Decoding64, Stream]] = []

    def feed(self, chunk: bytes) -> None:
        self._new += chunk
        while len(self._new) >= PIECE_BYTES:
            self._piece(bytes(self._new[:PIECE_BYTES]))
            del self._new[:PIECE_BYTES]

    def close(self) -> set[int]:
        self._piece(bytes(self._new), last=True)
        for _, child in self._open:
            self.kinds |= child.close()
        return self.kinds

    def _piece(self, new: bytes, last: bool = False) -> None:
        still = []
        for decoder, child in self._open:
            for out in decoder.feed(new):
                child.feed(out)
            if decoder.done:
                self.kinds |= child.close()
            else:
                still.append((decoder, child))
        self._open = still
        piece, before = self._tail + new, len(self._tail)
        if (key := hashlib.sha1(piece).digest()) not in self._seen:
            self._seen.add(key)
            layers, spans = _segment(Layer.root(" "), piece, _whole(0, 1))
            self.kinds.update(kind for _, kind, _ in spans)
            for layer in layers:
                self.kinds.update(kind for _, kind, _ in all_spans(layer.text)[1])
        if last:
            return
        for m in _MAGIC.finditer(piece, max(0, before - 2)):
            self._go_on(Inflating(), piece[m.start() :])
        run = piece.rstrip(Decoding64.ALPHABET)
        if len(piece) - len(run) > OVERLAP_BYTES and not any(isinstance(d, Decoding64) for d, _ in self._open):
            for skip in range(4):
                self._go_on(Decoding64(skip), piece[len(run) :])
        tail = piece[-OVERLAP_BYTES:]
        if (b"%" in tail or b"\\" in tail or b"&#" in tail) and not re.search(rb"[\x20\n]", tail):
            self.kinds.add(KINDS.index("opaque"))
        # an assignment may hold any number of spaces: what stands before them comes along
        if (lead := piece[: len(piece) - len(tail)]) and lead[-1:] == tail[:1] == b" ":
            tail = re.sub(rb"\x20+", b" ", lead)[-24:] + tail
        self._tail = tail

    def _go_on(self, decoder: Inflating | Decoding64, data: bytes) -> None:
        """Keep the decoder if the data does not end what it reads."""
        child = None
        for out in decoder.feed(data):
            child = child or Stream()
            child.feed(out)
        if not decoder.done:
            self._open.append((decoder, child or Stream()))


def large_kinds(data: bytes, at: int) -> tuple[set[int], int, bool]:
    """Of the gzip or zlib data from ``at`` on, all members together: the kinds found in it, where it ends and whether its end
    was met."""
    stream, end, ended = Stream(), at, False
    while m := _MEMBER.match(data, end):
        member, begin = Inflating(), m.start(1)
        while begin < len(data) and not member.done:
            for out in member.feed(data[begin : begin + FEED_BYTES]):
                stream.feed(out)
            begin = min(begin + FEED_BYTES, len(data))
        if not member.machine.eof:  # damaged or cut off: what was read counts
            if member.size:
                end, ended = len(data), False
            break
        end, ended = begin - len(member.machine.unused_data), True
    return stream.close(), end, ended


def _whole(a: int, b: int) -> Origin:
    return lambda i, j: (a, b)


def _byte_runs(layer: Layer, run: re.Pattern, escape: re.Pattern, one: re.Pattern) -> tuple[list[Layer], list[Span]]:
    """What the bytes hold that escapes and the literal characters between them stand for: escapers leave letters,
    digits and more as they are, so compressed data is never escapes alone."""
    more, spans = [], []
    for m in run.finditer(layer.text) if escape.search(layer.text) else ():
        if not escape.search(m[0]):
            continue
        starts, data = [], bytearray()
        for c in one.finditer(m[0]):
            if (code := _code(c)) < 256:
                starts.append(m.start() + c.start())
                data.append(code)
            else:  # no byte: nothing runs across it
                starts += [m.start() + c.start()] * 2
                data += b"\xff\xff"
        starts.append(m.end())
        for plus in (b"+", b" ") if one is _PERCENT_BYTE and "+" in m[0] else (b"+",):  # a form's plus is a space
            got = _segment(layer, bytes(b if b != 43 or layer.text[starts[i]] == "%" else plus[0] for i, b in enumerate(data)), lambda i, j, starts=starts: (starts[i], starts[j]), plain=False)
            more += got[0]
            spans += got[1]
    return more, spans


def _code(c: re.Match) -> int:
    """The code that an escape or a literal character stands for."""
    kind, text = c.lastgroup, c[c.lastgroup]
    if kind == "short":
        return _SHORT.get(text, ord(text))
    return ord(text) if kind == "plain" else int(text, {"hex": 16, "hex4": 16, "hex6": 16, "hex8": 16, "hexent": 16, "octal": 8, "ent": 10}[kind])


def _percent(layer: Layer) -> tuple[list[Layer], list[Span]]:
    pieces, (more, spans) = [], _byte_runs(layer, _PERCENT_RUN, _PERCENT, _PERCENT_BYTE)
    for m in _PERCENT.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        a, i, made = m.start(), 0, []
        while i < len(data):  # character by character; bytes that are no UTF-8 stay escaped
            for width in (1, 2, 3, 4):
                if c := readable(data[i : i + width]):
                    made.append((c, a + 3 * i, a + 3 * (i + len(data[i : i + width]))))
                    break
            else:
                width = 1
                made += [(layer.text[a + 3 * i + j], a + 3 * i, a + 3 * i + 3) for j in range(3)]
            i += width
        pieces.append((a, m.end(), made))
    new = layer.rewritten(pieces) if pieces else None
    return more + ([new] if new else []), spans


def _unicode(layer: Layer) -> tuple[list[Layer], list[Span]]:
    pieces, (more, spans) = [], _byte_runs(layer, _ESCAPE_RUN, _ESCAPE, _ESCAPE_BYTE)
    for m in _ESCAPE.finditer(layer.text):
        codes = [(int(next(g for g in e.groups() if g), 10 if e[5] else 16), m.start() + e.start(), m.start() + e.end()) for e in _ONE_ESCAPE.finditer(m[0])]
        made, i = [], 0
        while i < len(codes):
            c, a, b = codes[i]
            if 0xD800 <= c < 0xDC00 and i + 1 < len(codes) and 0xDC00 <= codes[i + 1][0] < 0xE000:
                i += 1
                c, b = 0x10000 + ((c - 0xD800) << 10) + codes[i][0] - 0xDC00, codes[i][2]
            if 0xD800 <= c < 0xE000 or c > 0x10FFFF or not (chr(c).isprintable() or chr(c) in "\t\n\r"):
                made += [(layer.text[j], a, b) for j in range(a, b)]  # no character: stays escaped
            else:
                made.append((chr(c), a, b))
            i += 1
        pieces.append((m.start(), m.end(), made))
    new = layer.rewritten(pieces) if pieces else None
    return more + ([new] if new else []), spans


def _base64(layer: Layer) -> tuple[list[Layer], list[Span]]:
    """Each run, and its pieces between the alphabet's own separators (a run may touch what stands before and after
    it: path/, auth_, -next), at all four alignments."""
    more, spans = [], []
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            runs = [m.span()]
            if pattern is _BASE64:
                runs += [(m.start() + p.start(), m.start() + p.end()) for p in _PIECE.finditer(m[0]) if p.end() - p.start() < len(m[0])]
            for a, b in runs:
                chars = layer.text[a:b]
                places = None if pattern is _BASE64 else [i for i, c in enumerate(chars) if c not in "\r\n="]
                body = re.sub(r"[\r\n=]", "", chars).replace("-", "+").replace("_", "/")
                for skip in range(4):
                    run = body[skip:]
                    run = run[: len(run) - (len(run) % 4 == 1)]
                    if len(run) < MIN_BASE64:
                        continue
                    data = base64.b64decode(run + "=" * (-len(run) % 4))
                    stop = b if skip + len(run) == len(body) else None

                    def origin(i: int, j: int) -> tuple[int, int]:
                        first, last = skip + i * 4 // 3, skip - (-j * 4 // 3)
                        if places:
                            first, last = places[first], places[last - 1] + 1
                        return a + first, stop if stop and j == len(data) else a + last

                    got = _segment(layer, data, origin)
                    more += got[0]
                    spans += got[1]
    return more, spans


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans of the text, and all spans with those of every layer."""
    base = base_spans(text)
    found, work = set(base), [Layer.root(text)]
    seen = {(hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest(), (0, len(text)))}
    while work:
        layer = work.pop()
        for open_ in (_percent, _unicode, _base64):
            layers, opaque = open_(layer)
            found.update(opaque)
            for new in layers:
                key = (hashlib.sha1(new.text.encode("utf-8", "surrogatepass")).digest(), new.origin(0, len(new.text)))
                if key not in seen:
                    seen.add(key)
                    for a, kind, b in base_spans(new.text):
                        start, end = new.origin(a, b)
                        found.add((start, kind, end))
                    work.append(new)
    return base, sorted(found)


def suspects(column: pa.Array) -> np.ndarray:
    """Rows that can have a span: a keyword, an escape, or a word long enough for a key or a base64 run."""
    column = column.fill_null("") if column.null_count else column
    out = pc.match_substring_regex(column, _KEYWORD).to_numpy(zero_copy_only=False).astype(bool)
    for a, b, texts in chunks(column):
        flag = np.zeros(256, bool)
        flag[list(b"%\\&")] = True
        out[a:b] |= texts.per_row(flag[texts.data]) > 0
        long_ = np.concatenate(([0], np.cumsum(texts.ends - texts.starts >= MIN_BASE64)))
        out[a:b] |= long_[texts.bounds[1:]] > long_[texts.bounds[:-1]]
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _listed(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, base and spans (arrays of kind, start, end in code points of the text)."""
    cols = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([T.StructField("_key", cols.schema["_key"].dataType), T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            look = suspects(column)
            base, spans = [[]] * len(batch), [[]] * len(batch)
            for i in np.flatnonzero(look):
                b, s = all_spans(column[i].as_py() or "")
                base[i], spans[i] = _listed(b), _listed(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _ARROW_SPANS), pa.array(spans, _ARROW_SPANS)], names=["_key", "base", "spans"])

    return cols.mapInArrow(find, schema).withColumnRenamed("_key", key)


def masked(text: str, spans: list[Span], mark: str) -> str:
    out, done = [], 0
    for a, _, b in sorted(spans):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", mark: str = "[REDACTED]") -> DataFrame:
    """The rows with every span (of any layer) replaced by ``mark``; the column ``chars``, if there, follows the
    new text; all other columns stay. Nothing is shuffled."""
    at = docs.columns.index(text)
    count = docs.columns.index(chars) if chars in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, look = batch.column(at), np.flatnonzero(suspects(batch.column(at)))
            new = {}
            for i in look:
                old = texts[i].as_py()
                if old and (spans := all_spans(old)[1]):
                    new[int(i)] = masked(old, spans, mark)
            if new:
                touched = np.zeros(len(batch), bool)
                touched[list(new)] = True
                rows = sorted(new)
                columns = list(batch.columns)
                columns[at] = pc.replace_with_mask(texts, pa.array(touched), pa.array([new[i] for i in rows], texts.type))
                if count is not None:
                    columns[count] = pc.replace_with_mask(columns[count], pa.array(touched), pa.array([len(new[i]) for i in rows], columns[count].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)
