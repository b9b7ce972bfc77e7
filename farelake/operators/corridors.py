"""Nearest rows within a corridor (I4): all history and all queries between two cities, in either direction, meet in one task.

Rows of a corridor are kept by cells, each with the exact box of its rows; queries by blocks, cells of their places. A block
has a greatest possible k-th score (the cells' farthest corners, nearest first, until they hold k rows), and only cells whose nearest
corner may reach it are compared with the block, as one matrix. So no pair of query and row is ever written or shuffled:
a query leaves with its k lowest scores and what ties with them. Scores leave unrounded, added up in the order of ``comparables._score``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers in a matrix of scores (queries of a block times rows): bounds what a task holds.
MATRIX = 1 << 20
#: Rows a cell and queries a block that are aimed for, and the least side of either.
ROWS_A_CELL, QUERIES_A_BLOCK, LEAST_SIDE = 32, 16, 1 / 16
#: Scores are rounded to six decimals later: so far apart, two may still be equal.
ROUNDING = 2e-6


def grouped(kinds: np.ndarray, place: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which those of a kind and a cube of places come together, and where each such group starts. Cubes get
    smaller until the groups hold ``most`` rows on average."""
    side = 1.0
    while True:
        codes = np.column_stack([kinds, np.floor(place / side)])
        order = np.lexsort(codes.T[::-1])
        codes = codes[order]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(1)])
        if len(place) <= most * len(starts) or side <= LEAST_SIDE:
            return order, starts
        side /= 2


class Cells:
    """Rows in the order of their cells: a cell is a direction and a cube of places, with the box of its rows."""

    def __init__(self, place: np.ndarray, forward: np.ndarray):
        self.order, self.starts = grouped(np.column_stack([forward]), place, ROWS_A_CELL)
        self.sizes = np.diff(np.r_[self.starts, len(place)])
        self.forward = forward[self.order][self.starts]
        sorted_place = place[self.order]
        self.low, self.high = np.minimum.reduceat(sorted_place, self.starts), np.maximum.reduceat(sorted_place, self.starts)

    def within_reach(self, low: np.ndarray, high: np.ndarray, bonus: np.ndarray, extra: float, k: int) -> np.ndarray:
        """Rows that may be among the k lowest scores of any query in a box. A row's score is its squared distance less its cell's
        ``bonus`` and less up to ``extra``."""
        far = (np.maximum(np.abs(self.high - low), np.abs(high - self.low)) ** 2).sum(1) - bonus
        near = (np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(1) - bonus - extra
        nearest_first = np.argsort(far, kind="stable")
        held = np.searchsorted(np.cumsum(self.sizes[nearest_first]), k)
        most = far[nearest_first[held]] if held < len(far) else np.inf
        cells = np.flatnonzero(near <= most + 1e-9 * (1 + abs(most)) + ROUNDING)
        return np.concatenate([self.order[s : s + n] for s, n in zip(self.starts[cells], self.sizes[cells])])


def _codes(column: pa.ChunkedArray, values: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(column, value_set=values), -1).to_numpy()


def _numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([pc.fill_null(table.column(c), float("nan")).to_numpy() for c in names])


def without_needless_ties(query: np.ndarray, raw: np.ndarray, price: np.ndarray, k: int) -> np.ndarray:
    """Which pairs stay: of those of a query with the very same score the k cheapest, and what costs as much as the k-th."""
    order = np.lexsort((price, raw, query))
    q, s, p = query[order], raw[order], price[order]
    at = np.arange(len(order))
    begins = np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])] if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(begins, at, 0))
    return order[(at - first < k) | (p == p[np.minimum(first + k - 1, at)])]


def nearest_of(k: int, scales: tuple[float, float, float], bonuses: tuple[float, float, float, float], kept: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a corridor's queries and rows: (qkey, raw, exact, reverse, kept columns) of every query's nearest rows."""
    exact_bonus, reverse_bonus, airline_bonus, stops_bonus = bonuses
    extra = airline_bonus + stops_bonus

    def nearest(queries: pa.Table, rows: pa.Table) -> pa.Table:
        here, there = _numbers(rows, ["h_km", "duration", "h_days"]), _numbers(queries, ["q_km", "q_h", "q_days"])
        rows, here = rows.filter(pa.array(np.isfinite(here).all(1))), here[np.isfinite(here).all(1)]
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool), np.zeros(0, bool))]
        if len(rows) and len(queries):
            cells = Cells(here / scales, rows.column("h_forward").to_numpy())
            same = {}
            for name in ("airline", "stops"):
                values = pc.unique(queries.column(f"q_{name}"))
                same[name] = _codes(queries.column(f"q_{name}"), values), _codes(rows.column(f"h_{name}"), values)
            price = np.unique(rows.column("price").to_numpy(), return_inverse=True)[1]
            h_forward = rows.column("h_forward").to_numpy()
            q_forward, both, round_trip = (queries.column(c).to_numpy() for c in ("q_forward", "q_both", "q_round"))
            place = there / scales
            order, starts = grouped(np.column_stack([q_forward, both]), place, QUERIES_A_BLOCK)
            for a, b in zip(starts, np.r_[starts[1:], len(order)]):
                block = order[a:b]
                one = block[0]

                def given(forward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    own = forward == q_forward[one]
                    return own & both[one], (~own | round_trip[one]) & both[one]

                exact, back = given(cells.forward)
                at = cells.within_reach(place[block].min(0), place[block].max(0), exact * exact_bonus + back * reverse_bonus, extra, k)
                exact, back = given(h_forward[at])
                step = max(1, MATRIX // len(at))
                for i in range(0, len(block), step):
                    some = block[i : i + step]
                    s = np.zeros((len(some), len(at)))
                    for d, scale in enumerate(scales):
                        gap = (here[at, d] - there[some, d, None]) / scale
                        s += gap * gap
                    s -= exact * exact_bonus
                    s -= back * reverse_bonus
                    for name, bonus in (("airline", airline_bonus), ("stops", stops_bonus)):
                        s -= (same[name][1][at] == same[name][0][some, None]) * bonus
                    most = np.partition(s, k - 1, axis=1)[:, k - 1 : k] if len(at) > k else np.full((len(some), 1), np.inf)
                    x, y = np.nonzero(s <= most + ROUNDING)
                    raw = s[x, y]
                    stay = without_needless_ties(x, raw, price[at[y]], k)
                    x, y, raw = x[stay], y[stay], raw[stay]
                    found.append((some[x], at[y], raw, exact[y], back[y]))
        q_at, h_at, raw, exact, back = (np.concatenate(x) for x in zip(*found))
        taken = rows.select(kept).take(pa.array(h_at))
        made = {"qkey": queries.column("qkey").take(pa.array(q_at)), "raw": pa.array(raw), "exact": pa.array(exact), "reverse": pa.array(back)}
        return pa.table(made | {c: taken.column(c) for c in kept})

    return nearest
