"""Hard-negative mining by BOND: branch and bound over columns.

Vectors are quantised to whole numbers; a score is an exact inner product. Rows are dealt to blocks that keep their
components as columns, rows of a label together. Every block meets all anchors in one task. An anchor reads the
columns in descending order of its own components' magnitude, a few at a time, and adds them to the candidates' partial
scores. What the columns not read yet can still add lies between sums of their least and greatest contributions, so
a candidate's score has bounds, and the candidates that the bounds rule out leave the bitmap:

* positives: those that cannot reach the k-th best lower bound of the anchor's label;
* negatives: those that can be in no positive's window, or behind enough candidates that are surely in it.

The few that are left have exact scores when all columns are read. Blocks give their best, a ranking over all blocks
picks the result; the windows follow from the positives of the whole table, so there are two scans.

Defined results: rows with a null key, label or vector, or a vector with a null or non-finite component, take no
part; vectors of different lengths are compared as if the shorter ended in zeros; repeated rows are rows of their
own (an anchor's own row is never its partner, an equal one can be); windows of a positive with a negative score
are empty; a scaled component or a score beyond a long is the nearest long. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.llm.tables import stored
from farelake.llm.vectors import arrays, arrow_type, block_count, finite, met, numbered, widened

#: Columns read between two looks at the bounds.
STEP = 8
LONG = np.iinfo(np.int64)


class Columns:
    """A block's rows as columns, sorted by label."""

    def __init__(self, row: np.ndarray, key: np.ndarray, label: np.ndarray, values: np.ndarray):
        by = np.argsort(label, kind="stable")
        self.row, self.key, self.label = row[by], key[by], label[by]
        self._values = np.ascontiguousarray(values[by].T)
        self.low, self.high = self._values.min(1), self._values.max(1)
        with np.errstate(over="ignore"):
            self.reach = float(np.sqrt((self._values**2).sum(0).max(initial=0)))
        self._as: dict = {}

    def exact_for(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Columns, their ends and the anchor, in a number type that holds all sums exactly (by Cauchy and Schwarz)."""
        with np.errstate(over="ignore"):
            most = float(np.sqrt((anchor**2).sum())) * self.reach * len(anchor) ** 0.5
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        if kind not in self._as:
            whole = np.vectorize(int, otypes=[object]) if kind is object and self._values.size else lambda x: x.astype(kind)
            self._as[kind] = tuple(map(whole, (self._values, self.low, self.high)))
        columns, low, high = self._as[kind]
        wide = np.float64 if kind is np.float32 else kind
        return columns, low.astype(wide), high.astype(wide), np.array([int(x) for x in anchor], object) if kind is object else anchor.astype(kind)

    def of_label(self, label) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


def scan(block: Columns, anchor: np.ndarray, start: np.ndarray, alive: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``start`` that stay alive to the end, with their exact scores.

    ``alive(partial, least, most)`` gives the bitmap of candidates that can still matter, when the columns not read yet
    add between ``least`` and ``most`` to each partial score.
    """
    columns, low, high, anchor = block.exact_for(anchor)
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    ends = np.stack([a * low[order], a * high[order]]) if len(a) else np.zeros((2, 0))
    least, most = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (ends.min(0), ends.max(0)))
    at, partial = start, np.zeros(len(start), columns.dtype)
    whole = len(at) == columns.shape[1]
    for i in range(0, len(order), STEP):
        dims = order[i : i + STEP]
        part = columns[dims] if whole else columns[np.ix_(dims, at)]
        partial = partial + anchor[dims] @ part
        j = i + len(dims)
        keep = alive(partial, least[j], most[j])
        if keep is not None and not keep.all():
            at, partial, whole = at[keep], partial[keep], False
        if not len(at):
            break
    return at, partial


def best(k: int) -> Callable:
    """Keeps what can still be among the ``k`` greatest."""

    def alive(partial, least, most):
        if len(partial) <= k or partial.max() - partial.min() <= most - least:
            return None
        kth = np.partition(partial, len(partial) - k)[len(partial) - k]
        return partial >= kth - (most - least)

    return alive


def within(windows: list[tuple[int, int]], k: int) -> Callable:
    """Keeps what can still be among the ``k`` greatest of some window (low, high), both ends included."""

    def alive(partial, least, most):
        if not len(partial):
            return None
        keep, top = np.zeros(len(partial), bool), partial.max()
        for low, high in windows:
            # a candidate's score lies in partial + least .. partial + most
            first, last = low - most, high - least
            if last - first < top - partial.min() and high - low >= most - least:
                sure = partial[(partial >= low - least) & (partial <= high - most)]
                if len(sure) >= k:
                    first = max(first, np.partition(sure, len(sure) - k)[len(sure) - k] + least - most)
            keep |= (partial >= first) & (partial <= last)
        return keep

    return alive


def _opened(scale: int) -> Callable:
    def opened(part: dict[str, pa.Array]) -> Columns:
        key, label = (part[c].to_numpy(zero_copy_only=False) for c in ("key", "label"))
        return Columns(part["row"].to_numpy(), key, label, _quantised(part["vec"], scale))

    return opened


def _quantised(vectors: pa.Array, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * arrays(vectors)), float(LONG.min), float(LONG.max))


def _longs(scores) -> pa.Array:
    return pa.array([min(max(int(s), LONG.min), LONG.max) for s in scores], pa.int64())


def _first(block: Columns, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest scores, ties by key."""
    some = np.arange(len(at))
    if len(at) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(at) - k)[len(at) - k])
    keys, least = block.key[at[some]], -scores[some]
    if object in (keys.dtype, least.dtype):
        return some[heapq.nsmallest(k, range(len(some)), key=lambda i: (least[i], keys[i]))]
    return some[np.lexsort((keys, least))[:k]]


def positives(rows: DataFrame, anchors: DataFrame, n_blocks: int, k: int, scale: int) -> DataFrame:
    """(anchor, key, score, rank): each anchor's ``k`` best other rows of its label."""
    key_type = rows.schema["key"].dataType.simpleString()

    def ask(block: Columns, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = {"anchor": [], "key": [], "score": []}
        own, labels, values = (batch.column(c) for c in ("row", "label", "vec"))
        values = widened(_quantised(values, scale), len(block.low))
        for row, label, anchor in zip(own.to_pylist(), labels.to_pylist(), values):
            start = np.arange(*block.of_label(label))
            at, scores = scan(block, anchor, start[block.row[start] != row], best(k))
            took = _first(block, at, scores, k)
            out["anchor"] += [row] * len(took)
            out["key"] += block.key[at[took]].tolist()
            out["score"] += list(scores[took])
        yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["key"], rows_key), _longs(out["score"])], ["anchor", "key", "score"])

    rows_key = arrow_type(key_type)
    found = met(rows, anchors, n_blocks, _opened(scale), ask, f"anchor long, key {key_type}, score long")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def negatives(rows: DataFrame, asked: DataFrame, n_blocks: int, k: int, scale: int, low: int, high: int) -> DataFrame:
    """(anchor, rank, key, score): of each block, the ``k`` best rows of other labels in the window of the anchor's
    positive of that rank. ``asked``: anchors with ``scores``, those of their positives."""
    key_type = rows.schema["key"].dataType.simpleString()
    rows_key = arrow_type(key_type)

    def ask(block: Columns, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = {"anchor": [], "rank": [], "key": [], "score": []}
        values = widened(_quantised(batch.column("vec"), scale), len(block.low))
        for row, label, anchor, of in zip(batch.column("row").to_pylist(), batch.column("label").to_pylist(), values, batch.column("scores").to_pylist()):
            windows = {s: (-(-low * s // 100), high * s // 100) for s in of}
            open_ = sorted({w for w in windows.values() if w[0] <= w[1]})
            if not open_:
                continue
            a, b = block.of_label(label)
            start = np.concatenate([np.arange(a), np.arange(b, len(block.row))])
            at, scores = scan(block, anchor, start, within(open_, k))
            for rank, s in enumerate(of, 1):
                inside = np.flatnonzero((scores >= windows[s][0]) & (scores <= windows[s][1]))
                took = inside[_first(block, at[inside], scores[inside], k)] if len(inside) else inside
                out["anchor"] += [row] * len(took)
                out["rank"] += [rank] * len(took)
                out["key"] += block.key[at[took]].tolist()
                out["score"] += list(scores[took])
        yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["rank"], pa.int32()), pa.array(out["key"], rows_key), _longs(out["score"])], ["anchor", "rank", "key", "score"])

    return met(rows, asked, n_blocks, _opened(scale), ask, f"anchor long, rank int, key {key_type}, score long")


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding", n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """One row per hard negative: anchor, positive and negative keys, the positive's rank among the anchor's, the rank
    of the negative in the window from ``low`` to ``high`` per cent of the positive's score, and both scores.

    ``is_anchor`` is an expression over the columns of ``vectors``."""
    taking_part = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector))
    rows = numbered(taking_part.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchors")), "vectors")
    n_blocks = block_count(rows)
    anchors, rows = rows.where("anchors").select("row", "key", "label", "vec"), rows.drop("anchors")
    found = stored(positives(rows, anchors, n_blocks, n_positives, scale), "positives")
    scores = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    asked = anchors.join(scores, F.col("row") == F.col("anchor")).select("row", "label", "vec", "scores")
    inside = negatives(rows, asked, n_blocks, n_negatives, scale, low, high)
    best_ = Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("negative_score"), "negative")
    inside = inside.select("anchor", F.col("rank").alias("positive_rank"), F.col("key").alias("negative"), F.col("score").alias("negative_score"))
    inside = inside.withColumn("rank", F.row_number().over(best_)).where(F.col("rank") <= n_negatives)
    pairs = found.select("anchor", F.col("rank").alias("positive_rank"), F.col("key").alias("positive"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_key"))
    out = inside.join(pairs, ["anchor", "positive_rank"]).join(named, "anchor")
    return out.select(F.col("anchor_key").alias("anchor"), "positive", "positive_rank", "rank", "negative", "positive_score", "negative_score")
