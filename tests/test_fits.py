"""Fits of all folds and penalties together against numpy on the collected rows."""
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import metrics

PENALTIES = (0.1, 1.0, 8.0)


def alone(x, y, penalty, signs):
    """The best of all fits on subsets of the features whose weights have the wanted signs."""
    best = None
    for n in range(x.shape[1] + 1):
        for keep in combinations(range(x.shape[1]), n):
            beta = np.zeros(x.shape[1])
            own = x[:, keep]
            for _ in range(60):
                p = 1 / (1 + np.exp(-own @ beta[list(keep)]))
                curve = own.T @ (own * (p * (1 - p))[:, None]) + penalty * np.eye(n)
                beta[list(keep)] += np.linalg.solve(curve, own.T @ (y - p) - penalty * beta[list(keep)]) if n else 0
            z = x @ beta
            value = np.logaddexp(0, np.where(y > 0.5, -z, z)).sum() + penalty * (beta**2).sum() / 2
            if (signs is None or (beta * signs >= -1e-12).all()) and (best is None or value < best[0] - 1e-12):
                best = value, beta
    return best[1]


def test_all_folds_equal_fits_of_their_own(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3))
    y = (rng.random(900) < 1 / (1 + np.exp(-x @ [1.2, -0.7, 0.05]))).astype(int)
    fold, dev = rng.integers(0, 5, 900), rng.random(900) < 0.3
    rows = spark.createDataFrame([(*map(float, v), int(label), f"f{f}", bool(d)) for v, label, f, d in zip(x, y, fold, dev, strict=True)] + [(None, 1.0, 1.0, 1, "f0", False), (1.0, 1.0, 1.0, None, "f1", True), (9.0, 9.0, 9.0, 0, None, False)], "a double, b double, c double, label int, fold string, held boolean")
    for signs in (None, [1, 1, 1]):
        spark.sparkContext.setJobGroup(f"fits {signs}", "")
        found = {b["left_out"]: b for b in metrics.fold_fits(rows, ["a", "b", "c"], "fold", F.col("held"), PENALTIES, signs)}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits {signs}")) <= 2 * 25  # a pass is one query: its shuffle and its result
        assert sorted(found) == [f"f{i}" for i in range(5)]
        for i in range(5):
            train, test = (fold != i) & ~dev, (fold != i) & dev
            losses = {}
            for p in PENALTIES:
                beta = alone(x[train], y[train], p, signs)
                z = x[test] @ beta
                losses[p] = np.logaddexp(0, np.where(y[test] > 0.5, -z, z)).mean(), beta
            penalty = min(PENALTIES, key=lambda p: losses[p][0])
            assert found[f"f{i}"]["penalty"] == penalty and np.allclose(found[f"f{i}"]["weights"], losses[penalty][1], atol=1e-6) and abs(found[f"f{i}"]["loss"] - losses[penalty][0]) < 1e-6


def test_fits_of_nothing(spark):
    none = spark.createDataFrame([], "a double, label int, fold string")
    assert metrics.fold_fits(none, ["a"], "fold") == [] and metrics.fold_fits(none, ["a"]) == []
