"""Utilities from paired results: tasks of many queries and Spark's own steps against Newton's on the collected rows."""
import numpy as np
import pytest

from factloom.operators import metrics


def alone(results):
    ids = sorted({c for _, a, b, *_ in results for c in (a, b)})
    u = np.zeros(len(ids))
    for _ in range(60):
        slope, curve = -metrics.RIDGE * u, metrics.RIDGE * np.eye(len(ids))
        for _, a, b, p, tie, w in results:
            i, j = ids.index(a), ids.index(b)
            s = 1 / (1 + np.exp(u[j] - u[i]))
            for x, y, sign in ((i, j, 1), (j, i, -1)):
                slope[x] += sign * w * (p + tie / 2 - s)
                curve[x, x] += w * s * (1 - s)
                curve[x, y] -= w * s * (1 - s)
        u += np.linalg.solve(curve, slope)
    return dict(zip(ids, u, strict=True))


def results_of(rng, query, n, more):
    rows = [(query, i + 1, i, float(rng.random()), 0.0, 1.0) for i in range(n - 1)]  # a chain, turned round
    for _ in range(more):
        a, b = rng.choice(n, 2, replace=False)
        tie = float(rng.random() < 0.3)
        rows.append((query, int(a), int(b), (1 - tie) * float(rng.random() < 0.6), tie, float(rng.integers(1, 4))))
    return rows


COLUMNS = "query_id long, a_id long, b_id long, p_a double, p_tie double, weight double"


def test_fits_of_many_queries_equal_newtons(spark):
    rng = np.random.default_rng(4)
    rows = [r for q, (n, more) in enumerate([(2, 0), (5, 9), (12, 0), (8, 60), (3, 2)]) for r in results_of(rng, q, n, more)]
    useless = [(0, 0, 9, 1.0, 0.0, 0.0), (0, 9, 9, 1.0, 0.0, 1.0), (None, 1, 2, 1.0, 0.0, 1.0), (0, 0, 9, None, 0.0, 1.0), (0, 0, 9, 1.0, 0.0, None)]
    frame = spark.createDataFrame(rows + useless, COLUMNS)
    wanted = {(q, c): u for q in range(5) for c, u in alone([r for r in rows if r[0] == q]).items()}
    found = metrics.bradley_terry(frame).collect()
    assert {(r["query_id"], r["candidate_id"]) for r in found} == set(wanted)
    assert max(abs(r["utility"] - wanted[r["query_id"], r["candidate_id"]]) for r in found) < 1e-6
    for q in range(5):
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and all(x["utility"] >= y["utility"] - 1e-9 for x, y in zip(own, own[1:], strict=False))
        assert sum(r["comparisons"] for r in own) == 2 * sum(r[0] == q for r in rows)


def test_large_queries_take_the_same_steps_as_jobs(spark):
    rng = np.random.default_rng(8)
    rows = results_of(rng, 1, 4, 0) + results_of(rng, 2, 2, 0)
    found = {(r["query_id"], r["candidate_id"]): r["utility"] for r in metrics.bradley_terry(spark.createDataFrame(rows, COLUMNS), fitted=2, settled=2e-3).collect()}
    wanted = {(q, c): u for q in (1, 2) for c, u in alone([r for r in rows if r[0] == q]).items()}
    assert set(found) == set(wanted) and max(abs(found[k] - wanted[k]) for k in wanted) < 2e-2


def test_candidates_apart_are_an_error(spark):
    frame = spark.createDataFrame([(1, 1, 2, 1.0, 0.0, 1.0), (1, 3, 4, 1.0, 0.0, 1.0), (2, 1, 2, 0.5, 0.0, 1.0)], COLUMNS)
    for fitted in (metrics.FITTED, 1):
        with pytest.raises(Exception, match="connect every candidate"):
            metrics.bradley_terry(frame, fitted).collect()


def test_of_nothing(spark):
    assert metrics.bradley_terry(spark.createDataFrame([], COLUMNS)).collect() == []
