"""Comparables along corridors: pruned blocks equal plain scores, dense routes read no other route, busy corridors are dealt."""

import random

import numpy as np
import pytest

from farelake.operators import comparables as CMP
from farelake.operators import corridors as CO
from tests.test_comparables_and_entry import _rows
from tests.test_comparables_reach import ASKED, HISTORY, _tables


def _dense(spark):
    dice = random.Random(9)
    ends = [("Aa", "Bb"), ("Bb", "Aa"), ("Aa", "Cc")]
    km = {"Bb": 700.0, "Aa": 700.0, "Cc": 1500.0}
    rows = [(100.0 + i % 41, a, b, dice.choice(["X", "Y", "Z"]), dice.choice(["zero", "one"]), float(1 + i % 20), float(i % 17), f"F{i % 9}", "Morning", "Night", "Economy", km[b]) for a, b in ends for i in range(700)]
    asked = [(i, "Economy", "X", "one", 1.0 + i % 20, float(i % 17), km[b], a, b) for i, (a, b) in enumerate(dice.choice(ends) for _ in range(50))]
    return spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, HISTORY)


def test_dense_routes_never_meet_the_cells_of_others(spark, monkeypatch):
    q, h = _dense(spark)

    def met(*_):
        raise AssertionError("history was joined by cells")

    monkeypatch.setattr(CMP.Grid, "meet", met)
    assert _rows(CMP.nearest_comparables(q, h, k=6)) == _rows(CMP.brute_force_comparables(q, h, k=6))


def test_busy_corridors_are_dealt_to_several_tasks(spark, monkeypatch):
    q, h = _tables(spark)
    monkeypatch.setattr(CMP, "ROWS_A_TASK", 40)
    monkeypatch.setattr(CMP, "QUERIES_A_TASK", 4)
    assert _rows(CMP.nearest_comparables(q, h, k=6)) == _rows(CMP.brute_force_comparables(q, h, k=6))


@pytest.mark.parametrize("far", [0.0, 40.0])
def test_rows_out_of_reach_cannot_be_among_the_best(far):
    rng = np.random.default_rng(3)
    place, forward = np.column_stack([np.full(3000, 2.0), rng.uniform(0, 25, 3000), rng.integers(0, 50, 3000) / 8]), rng.random(3000) < 0.5
    cells = CO.Cells(place, forward)
    assert cells.sizes.sum() == 3000 and len(cells.sizes) > 50
    bonus, extra = np.where(cells.forward, 10.0, 2.0), rng.choice([0.0, 0.5, 0.8, 1.3], 3000)
    for _ in range(20):
        asked = np.array([2.0, rng.uniform(0, 25), rng.uniform(0, 6) + far]) + rng.uniform(0, 0.5, (5, 3))
        kept = cells.within_reach(asked.min(0), asked.max(0), bonus, 1.3, 6)
        for one in asked:
            best = np.argsort(((place - one) ** 2).sum(1) - np.where(forward, 10.0, 2.0) - extra)[:6]
            assert set(best) <= set(kept)
        assert far or len(kept) < 1000


def test_ties_keep_the_cheapest_and_what_costs_the_same():
    query, raw, price = np.array([0, 0, 0, 0, 0, 1, 1]), np.array([1.0, 1.0, 1.0, 1.0, 2.0, 1.0, 1.0]), np.array([5, 3, 4, 4, 9, 7, 7])
    assert sorted(CO.without_needless_ties(query, raw, price, 2)) == [1, 2, 3, 4, 5, 6]
    assert list(CO.without_needless_ties(np.zeros(0, int), np.zeros(0), np.zeros(0, int), 2)) == []
