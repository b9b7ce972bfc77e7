"""Quality rules as a short-circuit cascade.

Every rule is a yes/no test on one document. A document is kept if no rule rejects it, so the order
of the rules cannot change the verdict, only its cost: a rule sees just the documents that all
earlier rules let pass. ``learn_order`` measures each rule's cost and rejection share on a sample and
puts the rules with the most rejections per second first.

Defined results: a null or empty text has no words and is rejected (``too_few_words``); ties in the
measured order fall back to the rules' given order; repeated rows are judged one by one; other columns,
whatever their names, pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from farelake.llm.text_arrays import Texts, chunks, grams, inside, mix, spans_hash

WINDOW = 8  # words in a repeated window
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
#: Symbols `#*$%&|<>` to a hundred words, repeated lines to a hundred lines, shouted words and words equal
#: to the one before to a hundred words.
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 50
MAX_UPPER_PCT = 30
MAX_STUTTER_PCT = 30
SAMPLE_ROWS = 2000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Features:
    """Counts of some documents, each made when a rule first asks for it."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self._made: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def take(self, keep: np.ndarray) -> Features:
        """The documents at ``keep``, with the counts already made."""
        out = Features(self.texts.take(keep))
        out._made = {k: v[keep] for k, v in self._made.items()}
        return out

    def _n_words(self) -> np.ndarray:
        return self.texts.n_words

    def _word_chars(self) -> np.ndarray:
        t = self.texts
        return _sum_by_row(t, t.per_word((t.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self.texts.per_row(_SYMBOL[self.texts.data])

    def _n_upper(self) -> np.ndarray:
        """Words of two or more letters A-Z and no letter a-z."""
        t = self.texts
        upper = t.per_word((t.data >= 0x41) & (t.data <= 0x5A))
        lower = t.per_word((t.data >= 0x61) & (t.data <= 0x7A))
        return _sum_by_row(t, (upper >= 2) & (lower == 0))

    def _n_stutter(self) -> np.ndarray:
        """Words equal to the word before them."""
        t = self.texts
        same = np.zeros(len(t.starts), bool)
        if len(same) > 1:
            h = t.hashes()
            same[1:] = h[1:] == h[:-1]
            first = t.bounds[:-1]
            same[first[first < len(same)]] = False
        return _sum_by_row(t, same)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and content hash of each line that has a word (lines end at \\n)."""
        t = self.texts
        breaks = np.flatnonzero(t.data == 0x0A)
        starts = np.union1d(breaks + 1, t.offsets[:-1])
        starts = starts[starts < len(t.data)]
        row = np.searchsorted(t.offsets, starts, "right") - 1
        next_break = np.append(breaks, len(t.data))[np.searchsorted(breaks, starts)]
        ends = np.minimum(next_break, t.offsets[row + 1])
        has = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
        return row[has], spans_hash(t.data, starts[has], ends[has])

    def _n_lines(self) -> np.ndarray:
        self._made["n_dup_lines"] = self._n_dup_lines()
        return self._made["n_lines"]

    def _n_dup_lines(self) -> np.ndarray:
        row, h = self._lines()
        self._made["n_lines"] = np.bincount(row, minlength=len(self.texts))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        again = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        return np.bincount(row[1:][again], minlength=len(self.texts))

    def _n_repeat_words(self) -> np.ndarray:
        """Words lying in a WINDOW-word window that the text has twice or more."""
        t = self.texts
        g = grams(t.hashes(), WINDOW)
        ok = inside(t.bounds, len(g), WINDOW)
        at = np.flatnonzero(ok)
        if not len(at):
            return np.zeros(len(t), np.int64)
        row = t.row_of_word[at]
        key = mix(g[at] ^ mix(row.astype(np.uint64) + np.uint64(1)))  # equal windows of one text
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(t.starts) + 1, np.int64)
        hit = at[order[twice]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        return _sum_by_row(t, np.cumsum(cover[:-1]) > 0)


def _sum_by_row(t: Texts, of_words: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(of_words, dtype=np.int64)))
    return total[t.bounds[1:]] - total[t.bounds[:-1]]


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean for each document of a ``Features``."""

    name: str
    rejects: Callable[[Features], np.ndarray]


RULES = [
    Rule("too_few_words", lambda f: f["n_words"] < MIN_WORDS),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > MAX_REPEAT_PCT * f["n_words"]),
    Rule("symbols", lambda f: 100 * f["n_symbols"] > MAX_SYMBOL_PCT * f["n_words"]),
    Rule("shouting", lambda f: 100 * f["n_upper"] > MAX_UPPER_PCT * f["n_words"]),
    Rule("stutter", lambda f: 100 * f["n_stutter"] > MAX_STUTTER_PCT * f["n_words"]),
    Rule("repeated_lines", lambda f: 100 * f["n_dup_lines"] > MAX_DUP_LINE_PCT * f["n_lines"]),
]
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(features: Features, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """First rejecting rule of each document (its place in ``order``, or -1) and how many rules it met."""
    by_name = {r.name: r for r in RULES}
    failed = np.full(len(features.texts), -1)
    met = np.zeros(len(features.texts), np.int64)
    alive, f = np.arange(len(failed)), features
    for k, name in enumerate(order):
        if not len(alive):
            break
        met[alive] += 1
        no = np.asarray(by_name[name].rejects(f), bool)
        if no.any():
            failed[alive[no]] = k
            alive = alive[~no]
            f = f.take(np.flatnonzero(~no))
    return failed, met


def learn_order(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """Rule names by rejections per second, measured on a sample of about ``rows`` documents.

    The sample is bounded by ``rows`` and decides the order only. Costs are timed in the tasks that read the
    sample, each rule on features of its own, so that no rule gains from another's work.
    """
    total = docs.count()
    names = [r.name for r in RULES]
    if not total:
        return names
    sample = docs.select(text).sample(fraction=min(1.0, rows / total), seed=seed)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, hits, n = np.zeros(len(RULES)), np.zeros(len(RULES), np.int64), 0
        for batch in batches:
            for a, b, texts in chunks(batch.column(0)):
                n += b - a
                for k, rule in enumerate(RULES):
                    fresh = Texts(texts.data, texts.offsets)
                    began = time.process_time()
                    hits[k] += int(np.count_nonzero(rule.rejects(Features(fresh))))
                    cost[k] += time.process_time() - began
        yield pa.RecordBatch.from_pydict({"rule": names, "cost": cost, "hits": hits, "n": np.full(len(RULES), n)})

    got = sample.mapInArrow(measure, "rule string, cost double, hits long, n long")
    rates = {r["rule"]: (r["hits"] or 0) / max(r["cost"] or 0.0, 1e-9) for r in got.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()}
    return sorted(names, key=lambda name: (-rates.get(name, 0.0), names.index(name)))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None, stats: bool = False) -> DataFrame:
    """One row per document: ``key``, kept, failed_rule (null if kept), rules_met; with ``stats`` also the
    counts in ``STATS`` and base_failed. Without ``stats`` a rejected document costs no further rule."""
    order = order or learn_order(docs, text)
    cols = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    fields = [T.StructField("_key", cols.schema["_key"].dataType)]
    fields += [T.StructField(s, T.LongType()) for s in STATS] + [T.StructField("base_failed", T.BooleanType())] if stats else []
    fields += [T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType()), T.StructField("rules_met", T.LongType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(1)):
                f = Features(texts)
                failed, met = cascade(f, order)
                out = {"_key": batch.column(0).slice(a, b - a)}
                if stats:
                    out |= {s: pa.array(f[s].astype(np.int64)) for s in STATS}
                    out["base_failed"] = pa.array((f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PCT * f["n_words"]))
                out |= {"kept": pa.array(failed < 0), "failed_rule": pa.array([order[k] if k >= 0 else None for k in failed], pa.string()), "rules_met": pa.array(met)}
                yield pa.RecordBatch.from_pydict(out)

    return cols.mapInArrow(judge, T.StructType(fields)).withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows that no rule rejects, all columns as they are; each task streams its batches, nothing is shuffled."""
    order = order or learn_order(docs, text)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch.column(at)):
                failed, _ = cascade(Features(texts), order)
                yield batch.slice(a, b - a).filter(pa.array(failed < 0))

    return docs.mapInArrow(keep, docs.schema)
