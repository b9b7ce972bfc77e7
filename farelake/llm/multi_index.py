"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, by codebooks fitted on a bounded sample; a row's cell is its pair of
centroids, so c centroids a half make c * c fine cells from 2 * c distances. Every row is indexed: its cell is stored
with it, rows are dealt by ranges of cells (a cell with very many rows is cut by row number), and no list is capped.

A query visits cells in ascending sum of its two halves' squared distances to the centroids. A heap over the two
sorted lists gives them one by one, by (i, j) -> (i + 1, j), (i, j + 1). It stops when the cells hold ``share`` of all
rows; the last sum is the query's radius, and all cells within it are visited whole. The rows of visited cells are
reranked by exact distances on the original vectors.

``share`` is learned on the sample: for sampled queries, the place of each true neighbour in the visiting order is known
by brute force there, and the share that reaches ``recall`` of them is taken. (In the whole table neighbours are
nearer than in the sample, so it errs to the safe side.)

Defined results: rows with a null key, or a vector that is null, zero, empty or has a null or non-finite component, take no
part; vectors of different lengths are compared as if the shorter ended in zeros; repeated rows are rows of their own
(a query's own row is never found, an equal one can be); ties go to the smaller key. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from farelake.llm.tables import stored
from farelake.llm.vectors import arrays, arrow_type, block_count, finite, met, numbered, widened

#: Rows that the codebooks and the share are learned from, and queries among them for the share (bounds of what is collected).
SAMPLE, SAMPLE_QUERIES = 16384, 256
ROUNDS, MOST_CENTROIDS = 12, 1024
RECALL = 0.97


class Index:
    """Two codebooks, and how much of the table a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, width: int):
        self.books, self.width = (first, second), width
        self.share = 1.0

    @property
    def size(self) -> int:
        """Centroids of a half."""
        return len(self.books[0])

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = widened(vectors, self.width)
        return whole[:, : self.width // 2], whole[:, self.width // 2 :]

    def distances(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its centroids."""
        return [_squared(half, book) for half, book in zip(self.halves(vectors), self.books)]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.distances(vectors))
        return a * self.size + b


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def _centroids(points: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Lloyd's method from seeded distinct points; an empty centroid takes the point that is farthest from its own."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(ROUNDS):
        d = _squared(points, centres)
        of = d.argmin(1)
        count = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        centres[empty] = points[np.argsort(-d.min(1), kind="stable")[: len(empty)]][: len(empty)]
    return centres


def visiting_order(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, centroid of the first half, of the second) in ascending sum, by a heap over the two sorted lists."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield total, int(o1[i]), int(o2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))


def fit(rows: DataFrame, n_neighbours: int, recall: float = RECALL, sample: int = SAMPLE, seed: int = 1) -> Index | None:
    """Codebooks from a sample of about ``sample`` rows (all, if fewer), and the share of rows to visit. None for no rows."""
    n = rows.count()
    if not n:
        return None
    bound = min(1.0, sample / n)
    chosen = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(bound * (1 << 30))) if bound < 1 else rows
    got = chosen.select("vec").toArrow().column("vec").chunks
    points = arrays(pa.concat_arrays(got)) if got else np.array([rows.first()["vec"]], float)
    width = max(2, points.shape[1])
    points = widened(points, width)
    cells = 2 ** round(np.log2(max(16, n / 8)) / 2)
    wanted = int(min(MOST_CENTROIDS, cells, max(1, len(points) // 8)))
    index = Index(*(_centroids(half, wanted, seed + i) for i, half in enumerate((points[:, : width // 2], points[:, width // 2 :]))), width)
    most = max(map(len, index.books))
    index.books = tuple(np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in index.books)  # a half with fewer distinct points
    index.share = _share(index, points, n_neighbours, recall)
    return index


def _share(index: Index, points: np.ndarray, k: int, recall: float) -> float:
    """The share of the sample, in visiting order, that reaches ``recall`` of the true neighbours of sampled queries."""
    n = len(points)
    if n <= k + 1:
        return 1.0
    cells = index.cells(points)
    places = []
    for q in np.linspace(0, n - 1, min(n, SAMPLE_QUERIES)).astype(int):
        d = ((points - points[q]) ** 2).sum(1)
        d[q] = np.inf
        near = np.argpartition(d, k)[:k]
        d1, d2 = (x[0] for x in index.distances(points[q : q + 1]))
        sums = (d1[:, None] + d2)[cells // index.size, cells % index.size]
        places += [(sums <= sums[i]).mean() for i in near]
    return float(min(1.0, np.quantile(places, recall)))


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", n_neighbours: int = 10, recall: float = RECALL) -> DataFrame:
    """(query, rank, key, score): each query's nearest other rows found, by Euclidean distance.

    ``is_query`` is an expression over the columns of ``vectors``."""
    spark = vectors.sparkSession
    taking_part = vectors.where(F.col(key).isNotNull() & finite(vector)).where(F.exists(vector, lambda x: x != 0))
    rows = numbered(taking_part.select(F.col(key).alias("key"), F.col(vector).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    key_type = rows.schema["key"].dataType.simpleString()
    index = fit(rows, n_neighbours, recall)
    if index is None:
        return spark.createDataFrame([], f"query {key_type}, rank int, key {key_type}, score double")
    indexed = stored(rows.mapInArrow(_placed(index), f"row long, key {key_type}, vec {rows.schema['vec'].dataType.simpleString()}, asks boolean, cell int"), "indexed")

    n_blocks = block_count(indexed)
    # the inverted lists: rows of a cell together, cells cut into ranges of like size
    ranges = indexed.drop("asks").repartitionByRange(n_blocks, "cell", "row").withColumn("block", F.spark_partition_id())
    lists = stored(ranges, "lists")
    held = lists.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most one row a cell and one a block
    queries = stored(indexed.where("asks").drop("cell", "asks").mapInArrow(_visits(index, held), f"row long, key {key_type}, vec {rows.schema['vec'].dataType.simpleString()}, radius double, blocks array<int>"), "queries")
    found = met(lists, queries, n_blocks, _opened(index), _rerank(index, n_neighbours, arrow_type(key_type)), f"asker long, query {key_type}, key {key_type}, score double", F.col("block"), F.col("blocks"))
    rank = F.row_number().over(Window.partitionBy("asker").orderBy("score", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n_neighbours).select("query", "rank", "key", "score")


def _placed(index: Index):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict({"row": by["row"], "key": by["key"], "vec": by["vec"], "asks": by["asks"], "cell": index.cells(arrays(by["vec"])).astype(np.int32)})

    return place


def _visits(index: Index, held: pa.Table):
    """Each query's radius, and the blocks that have rows within it."""
    cell, block, n = (held.column(c).to_numpy() for c in ("cell", "block", "n"))
    count = np.bincount(cell, weights=n, minlength=index.size**2)
    wanted = index.share * count.sum()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            radii, blocks = [], []
            for d1, d2 in zip(*index.distances(arrays(batch.column("vec")))):
                have, radius = 0.0, 0.0
                for radius, i, j in visiting_order(d1, d2):
                    have += count[i * index.size + j]
                    if have >= wanted:
                        break
                radii.append(radius)
                blocks.append(np.unique(block[d1[cell // index.size] + d2[cell % index.size] <= radius]).astype(np.int32))
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "key": batch.column("key"), "vec": batch.column("vec"), "radius": np.array(radii, float), "blocks": pa.array(blocks, pa.list_(pa.int32()))})

    return visit


class Lists:
    """A block's rows by cell."""

    def __init__(self, row, key, cell, vectors):
        by = np.argsort(cell, kind="stable")
        self.row, self.key, self.vectors = row[by], key[by], vectors[by]
        self.cells, self.starts = np.unique(cell[by], return_index=True)
        self.ends = np.append(self.starts[1:], len(by))


def _opened(index: Index):
    def opened(part: dict[str, pa.Array]) -> Lists:
        return Lists(part["row"].to_numpy(), part["key"].to_numpy(zero_copy_only=False), part["cell"].to_numpy(), arrays(part["vec"]))

    return opened


def _rerank(index: Index, k: int, key_type: pa.DataType):
    def ask(lists: Lists, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = {"asker": [], "query": [], "key": [], "score": []}
        vectors = arrays(batch.column("vec"))
        width = max(vectors.shape[1], lists.vectors.shape[1])
        entries, wide = widened(lists.vectors, width), widened(vectors, width)
        first, second = index.distances(vectors)
        for q, (row, name, radius) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "key", "radius")))):
            visited = first[q][lists.cells // index.size] + second[q][lists.cells % index.size] <= radius
            if not visited.any():
                continue
            at = np.concatenate([np.arange(a, b) for a, b in zip(lists.starts[visited], lists.ends[visited])]) if not visited.all() else np.arange(len(lists.row))
            at = at[lists.row[at] != row]
            score = np.sqrt(((entries[at] - wide[q]) ** 2).sum(1))
            if len(at) > k:
                near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                at, score = at[near], score[near]
            keys = lists.key[at]
            took = heapq.nsmallest(k, range(len(at)), key=lambda i: (score[i], keys[i])) if keys.dtype == object else np.lexsort((keys, score))[:k]
            out["asker"] += [row] * len(took)
            out["query"] += [name] * len(took)
            out["key"] += keys[took].tolist()
            out["score"] += score[took].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out["asker"], pa.int64()), pa.array(out["query"], key_type), pa.array(out["key"], key_type), pa.array(out["score"], pa.float64())], ["asker", "query", "key", "score"])

    return ask
