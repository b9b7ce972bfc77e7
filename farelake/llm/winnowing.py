"""Document fingerprints by winnowing.

Words are folded to lower case and hashed; the hash of k words in a row is a cyclic polynomial (the words' hashes,
each rotated by its place, under exclusive or), built for all positions at once from shorter runs. Of each window
of w such hashes the least is chosen, the rightmost of equal ones, and kept with its position. So any run of
w + k - 1 equal words gives the two texts an equal hash whose positions lie in the run, and no run of under k
words does.

Everything is array arithmetic inside a row: no word is ever a row and nothing is shuffled.

Defined results: a text of fewer than k words has one hash of them all; null text and text without words have an
empty fingerprint; two empty fingerprints are alike (1), an empty and another one are not (0); a text with fewer than
w hashes is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K = 4  # words in a hash; a power of two
WINDOW = 8  # hashes in a window; a power of two
_PLACE_BITS = 30  # a string cannot hold 2^30 words
_PLACES = (1 << _PLACE_BITS) - 1
_SPACES = r"[\x20\x09-\x0D]+"


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _paired(column: str, step: int, how) -> Column:
    """how(x[i], x[i + step]) for all i that have both."""
    n = F.greatest(F.size(column) - step, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, step + 1, n), how)


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``name``: array of longs, each a hash (33 bits) above an inverted position (30 bits)."""
    w, g = f"_words_{name}", f"_grams_{name}"
    rows = rows.withColumn(w, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _SPACES), ""))
    rows = rows.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    rows = rows.withColumn(g, F.col(w))
    step = 1
    while step < K:
        rows = rows.withColumn(g, _paired(g, step, _joined(step)))
        step *= 2
    short = F.when(F.size(w) == 0, F.slice(w, 1, 0)).otherwise(F.array(F.xxhash64(w)))
    rows = rows.withColumn(g, F.when(F.size(w) < K, short).otherwise(F.col(g))).drop(w)
    rows = rows.withColumn(g, F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 1 + _PLACE_BITS), _PLACE_BITS).bitwiseOR(F.lit(_PLACES).cast("long") - i)))
    rows = rows.withColumn(name, F.col(g))
    step = 1
    while step < WINDOW:
        rows = rows.withColumn(name, _paired(name, step, lambda x, y: F.least(x, y)))
        step *= 2
    one = F.when(F.size(g) == 0, F.col(g)).otherwise(F.array(F.array_min(g)))
    return rows.withColumn(name, F.when(F.size(g) < WINDOW, one).otherwise(F.array_distinct(name))).drop(g)


def _joined(step: int):
    return lambda x, y: _rotated(x, step).bitwiseXOR(y)


def hashes(fingerprint: str | Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda p: F.shiftright(p, _PLACE_BITS)))


def positions(fingerprint: str | Column) -> Column:
    """Word positions (from 0) at which the chosen hashes start."""
    return F.transform(fingerprint, lambda p: F.lit(_PLACES).cast("long") - p.bitwiseAND(F.lit(_PLACES)))


def written(fingerprint: str | Column) -> Column:
    """``hash:position`` of each chosen hash, in text order."""
    entry = lambda p: F.concat(F.hex(F.shiftright(p, _PLACE_BITS)), F.lit(":"), (F.lit(_PLACES).cast("long") - p.bitwiseAND(F.lit(_PLACES))).cast("string"))
    return F.array_join(F.transform(fingerprint, entry), ",")


def likeness(a: str, b: str) -> Column:
    """Shared hashes over all hashes of two arrays from ``hashes``."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)
