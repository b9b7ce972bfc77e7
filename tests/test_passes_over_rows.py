"""Work that follows the rows alone: numbers are checked at the scan, splits are written before they are fitted on, and Huber
folds share the rows whose side of the bend no fold changes."""

import numpy as np
from pyspark.sql import functions as F

from farelake.operators import clean as C
from farelake.operators import robust as RB
from farelake.operators import splits as SP
from farelake.plans import datasets as D
from farelake.plans import q_training as QT
from tests.conftest import SF_SMALL


def test_valid_rows_are_those_without_a_reason(spark):
    cities = [None, "Pune", "Goa"]
    numbers = [None, -1.0, 0.0, 2.5, float("inf"), float("nan")]
    rows = [(a, b, d, p) for a in cities for b in cities for d in numbers for p in numbers]
    base = C.coerce_numeric(spark.createDataFrame(rows, "source_city string, destination_city string, duration double, price double"), ["duration", "price"])
    checked = base.select(F.size(C.rejection_reasons(base)).alias("n"), C.is_valid().alias("ok")).collect()
    assert all(r.ok == (r.n == 0) for r in checked) and any(r.ok for r in checked)


def test_numbers_are_checked_at_the_scan(spark):
    plan = D.tickets(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "l_quantity" in line]
    assert filters and not any("array" in line for line in filters)


def test_the_random_split_is_made_once(spark, monkeypatch):
    calls, whole = [], SP.random_holdout
    monkeypatch.setattr(SP, "random_holdout", lambda *a, **k: calls.append(1) or whole(*a, **k))
    seen = []
    monkeypatch.setattr(QT.TR, "load_class_models", lambda spark, folder, fit: seen.append(fit) or Stub())
    monkeypatch.setattr(QT.TR, "fit_class_models", lambda train, estimator: train)

    class Stub:
        def predict(self, rows):
            seen.append(rows)
            return rows.withColumn("pred", F.col("price"))

    assert QT.g17_trained_router(spark, SF_SMALL).count() > 1 and len(calls) == 1
    train, test = seen[0](), seen[1]
    assert train.count() > test.count() > 0
    assert all("split-random" in f for df in (train, test) for f in df.inputFiles())


def test_folds_share_rows_on_one_side(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x, route = rng.normal(size=n), rng.integers(0, 40, n)
    route[:2500] = 40  # one group holds out more than half
    y = 2 * x + rng.standard_t(2, n) * 0.3
    rows = [(f"r{a}" if a else None, f"c{a % 7}", float(b), float(c)) for a, b, c in zip(route, x, y)]
    df = spark.createDataFrame(rows, "route string, corridor string, f double, y_log double").repartition(3)
    folds = RB.Folds(df, ["route", "corridor"])
    k = len(folds)
    beta = np.column_stack([rng.normal(scale=0.01, size=k), 2 + rng.normal(scale=0.01, size=k)])
    beta[3] += 5  # a fold that lies far off
    bend = 0.4 + rng.random(k) / 100
    kinds = {"route": np.array([r[0] for r in rows]), "corridor": np.array([r[1] for r in rows])}
    for limit in (bend, np.full(k, np.inf)):
        products, signed, count, beyond = RB._sums(df, folds, ["f"], beta, limit)
        for i, (kind, g) in enumerate(folds.names):
            train = np.ones(n, bool) if g is None else kinds[kind] != g
            ones = np.column_stack([np.ones(n), x])
            r = y - ones @ beta[i]
            out = train & (np.abs(r) > limit[i])
            z = np.column_stack([ones, y])[train & ~out]
            assert np.allclose(products[i], z.T @ z, rtol=1e-9, atol=1e-8)
            assert np.allclose(signed[i], (np.sign(r[out])[:, None] * ones[out]).sum(0), rtol=1e-9, atol=1e-8)
            assert count[i] == train.sum() and beyond[i] == out.sum()


def test_most_rows_do_not_meet_the_folds(spark):
    rng = np.random.default_rng(6)
    k, n = 500, 1000
    beta = np.column_stack([rng.normal(scale=0.001, size=k), 2 + rng.normal(scale=0.001, size=k)])
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n)])
    within, beyond = RB.sides(x, beta, np.full(k, 0.5))
    r = x[:, -1:] - x[:, :-1] @ beta.T
    assert (np.abs(r[within]) <= 0.5).all() and (np.abs(r[beyond]) > 0.5).all()
    assert (within | beyond).mean() > 0.95
