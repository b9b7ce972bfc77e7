"""Vectorised word arithmetic on Arrow string columns (used inside Arrow tasks).

A *word* is a maximal run of bytes other than space and ``\\t..\\r``; UTF-8 never uses those bytes
inside a longer sequence, so byte runs and code point runs are the same words. Rows are worked in
chunks of about ``CHUNK_BYTES`` so that a task's memory does not follow the size of its batch; a
single longer text is one chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Odd multipliers of the polynomial and the mixing steps (any odd 64-bit numbers do).
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..n-1 and their inverses modulo 2^64 (kept for the usual chunk size only)."""
    have = _POWERS.get("up")
    if have is not None and len(have) >= n:
        return have[:n], _POWERS["down"][:n]
    m = max(n, CHUNK_BYTES + 65536)
    up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if m <= 4 * CHUNK_BYTES:
        _POWERS.update(up=up, down=down)
    return up[:n], down[:n]


class Texts:
    """Some rows' texts as one byte array, with their words found on first use."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, keep: np.ndarray) -> Texts:
        """The rows at the given positions."""
        lengths = np.diff(self.offsets)[keep]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        if not offsets[-1]:
            return Texts(np.zeros(0, np.uint8), offsets)
        at = np.repeat(self.offsets[:-1][keep] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return Texts(self.data[at], offsets)

    def _find_words(self) -> None:
        word = ~_SPACE[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        at = self.offsets[(self.offsets > 0) & (self.offsets < len(word))]  # a word ends with its text
        first[at] |= word[at]
        last[at - 1] |= word[at - 1]
        self._starts, self._ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._bounds = np.searchsorted(self._starts, self.offsets)

    @property
    def starts(self) -> np.ndarray:
        if not hasattr(self, "_starts"):
            self._find_words()
        return self._starts

    @property
    def ends(self) -> np.ndarray:
        self.starts  # noqa: B018
        return self._ends

    @property
    def bounds(self) -> np.ndarray:
        """Row i has the words bounds[i]:bounds[i + 1]."""
        self.starts  # noqa: B018
        return self._bounds

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.n_words)

    def per_row(self, of_bytes: np.ndarray) -> np.ndarray:
        """Sums over each row of something counted at bytes."""
        total = np.concatenate(([0], np.cumsum(of_bytes, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def per_word(self, of_bytes: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(of_bytes, dtype=np.int64)))
        return total[self.ends] - total[self.starts]

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` folds A-Z first."""
        name = "_lower" if lower else "_plain"
        if not hasattr(self, name):
            data = _LOWER[self.data] if lower else self.data
            setattr(self, name, spans_hash(data, self.starts, self.ends))
        return getattr(self, name)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, by prefix sums: the same bytes give the same hash anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions with fewer words after them are left out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + hashes[j : j + n]
    return mix(out)


def inside(bounds: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of the n window starts have all k words in one row."""
    ok = np.ones(max(0, n), bool)
    for j in range(1, k):
        at = bounds[1:-1] - j
        ok[at[(at >= 0) & (at < n)]] = False
    return ok


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets (int64, from 0); null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) in pieces of about ``size`` bytes."""
    data, offsets = string_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end
