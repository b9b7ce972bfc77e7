"""Multilingual mixture inference for language identification.

Training counts byte trigrams of words (A-Z folded, a space on either side of each word) for each language over
all labelled training rows; the model is one log probability for each of ``BUCKETS`` hashed trigrams and language, so its
size does not follow the corpus. A document is a mixture: each word was drawn from one language, in unknown
proportions. Expectation-maximisation estimates the proportions from the words' trigram likelihoods. The language
set is chosen by penalised likelihood: from all languages, the one with the least share is dropped while the
log likelihood falls by no more than the penalty, ``PENALTY`` * ln(words) a language. The prediction is the
language with the largest share, and the score is its share.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing
is labelled; letters outside every known trigram are scored by smoothing; equal shares go to the language that
sorts first; repeated rows are judged one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from farelake.llm.text_arrays import CHUNK_BYTES, Texts, chunks

BUCKETS = 1 << 16
#: Bytes of texts worked at once, as every chunk has tables of all buckets.
CHUNK = 4 * CHUNK_BYTES
SMOOTHING = 0.05
PENALTY = 0.5
STEPS = 6
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def trigrams(texts: Texts) -> tuple[Texts, np.ndarray]:
    """The texts' letter words, and the bucket of the trigram around each byte of them, word after word."""
    words = Texts(_LETTERS[texts.data], texts.offsets)
    starts, ends = words.starts, words.ends
    if not len(starts):
        return words, np.zeros(0, np.int64)
    at = np.flatnonzero(words.data != 0x20)
    around = np.full(len(words.data) + 2, 0x20, np.uint32)
    around[1:-1] = words.data
    before, after = around[at], around[at + 2]
    length = ends - starts
    first = np.cumsum(length) - length
    before[first], after[first + length - 1] = 0x20, 0x20  # texts lie side by side
    code = before << np.uint32(16) | around[at + 1] << np.uint32(8) | after
    return words, ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)


def counts(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows; each task hands on at most BUCKETS rows a language."""
    cols = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for a, b, texts in chunks(batch.column(1), CHUNK):
                words, buckets = trigrams(texts)
                size = np.diff(np.concatenate(([0], np.cumsum(words.ends - words.starts)))[words.bounds])
                name_of = np.repeat(names[a:b], size)
                for name in set(names[a:b]):
                    found.setdefault(name, np.zeros(BUCKETS, np.int64))
                    found[name] += np.bincount(buckets[name_of == name], minlength=BUCKETS)
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at.astype(np.int32), "n": n[at]})

    return cols.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """languages in code point order, and a BUCKETS x languages table of log probabilities."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
        """At most BUCKETS numbers a language come to the driver."""
        got = counts(labelled, text, lang).toArrow()
        names = got.column("lang").to_pylist()
        languages = sorted(set(names))
        place = {name: i for i, name in enumerate(languages)}
        n = np.zeros((BUCKETS, len(languages)))
        if names:
            n[got.column("bucket").to_numpy(), [place[x] for x in names]] = got.column("n").to_numpy()
        n += SMOOTHING
        return cls(languages, np.log(n / n.sum(0, keepdims=True)).astype(np.float32))

    def shares(self, texts: Texts) -> np.ndarray:
        """Rows x languages: estimated proportions, 0 for languages outside the chosen set."""
        words, buckets = trigrams(texts)
        n_rows, n_langs = len(texts), len(self.languages)
        out = np.zeros((n_rows, n_langs))
        if not len(words.starts):
            return out
        length = words.ends - words.starts
        fit = np.add.reduceat(self.table[buckets], np.cumsum(length) - length, axis=0).astype(np.float64)
        top = fit.max(1)
        like = np.exp(fit - top[:, None])
        rows = np.flatnonzero(words.n_words)
        starts, n = words.bounds[:-1][rows], words.n_words[rows]
        share, score = _maximise(like, starts, n, np.full((len(rows), n_langs), 1 / n_langs))
        open_ = np.arange(len(rows))
        while len(open_):
            # try each open row without its least language
            kept = share[open_] > 0
            several = kept.sum(1) > 1
            open_ = open_[several]
            if not len(open_):
                break
            trial = share[open_]
            least = np.where(trial > 0, trial, np.inf)
            trial[np.arange(len(open_)), n_langs - 1 - np.argmin(least[:, ::-1], axis=1)] = 0
            total = trial.sum(1, keepdims=True)
            at, sub_starts, sub_n = _take(starts[open_], n[open_])
            new, new_score = _maximise(like[at], sub_starts, sub_n, np.where(total > 0, trial / np.maximum(total, 1e-300), 0))
            better = new_score >= score[open_] - PENALTY * np.log(sub_n + 1)
            share[open_[better]], score[open_[better]] = new[better], new_score[better]
            open_ = open_[better]
        out[rows] = share
        return out


def _take(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.cumsum(n) - n
    return np.repeat(starts - new, n) + np.arange(n.sum()), new, n


def _maximise(like: np.ndarray, starts: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after STEPS steps, and the log likelihood there; words of row i are starts[i]...+n[i]. A language
    whose share falls under a tenth of a word is out."""
    row = np.repeat(np.arange(len(n)), n)
    for _ in range(STEPS):
        each = share[row] * like
        total = np.maximum(each.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(each / total, starts, axis=0) / n[:, None]
        share[share * n[:, None] < 0.1] = 0
        share /= share.sum(1, keepdims=True)
    total = np.maximum((share[row] * like).sum(1), 1e-300)
    return share, np.add.reduceat(np.log(total), starts)


def has_letter(texts: Texts) -> np.ndarray:
    out = texts.per_row(_ASCII_LETTER[texts.data]) > 0
    for i in np.flatnonzero(~out & (texts.per_row(texts.data >= 0x80) > 0)):
        text = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes().decode(errors="ignore")
        out[i] = any(map(str.isalpha, text))
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, lang_pred, score and mixture, its languages and shares, largest first."""
    cols = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers, whatever the corpus
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([T.StructField("_key", cols.schema["_key"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", mixture)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for a, b, texts in chunks(batch.column(1), max(1 << 14, CHUNK * 4 // max(4, len(m.languages)))):
                share = m.shares(texts) if m.languages else np.zeros((b - a, 1))
                best = share.argmax(1)
                score = np.where(has_letter(texts), share[np.arange(b - a), best], 0.0)
                best = np.where(score > 0, best, len(m.languages))
                order = np.argsort(-share, axis=1, kind="stable")
                listed = [[{"lang": names[j], "share": float(share[i, j])} for j in order[i] if share[i, j] > 0] if score[i] > 0 else [] for i in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(listed, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=["_key", "lang_pred", "score", "mixture"],
                )

    return cols.mapInArrow(predict, schema).withColumnRenamed("_key", key)
