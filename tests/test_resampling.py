"""Resampling with replacement: blocks against one block, plain resampling and counts dealt down the tree."""
import hashlib

import numpy as np

from factloom.operators import metrics


def plain(strata, rounds=4000, seed=3):
    rng = np.random.default_rng(seed)
    means = np.sort(np.mean([[rng.choice(v, len(v)).mean() for v in strata] for _ in range(rounds)], axis=1))
    return means[int(rounds * 0.025)], means[int(rounds * 0.975)], means[int(rounds * 0.05)], (means > 0).mean()


def test_blocks_and_strata_equal_plain_resampling(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(0.05, 1, 700), "b": rng.exponential(1, 90) - 0.9, "c": np.array([0.25])}
    rows = [(i, float(x), s) for i, (s, x) in enumerate((s, x) for s, v in values.items() for x in v)] + [(99999, None, "a")]
    pairs = spark.createDataFrame(rows, "task long, difference double, s string")
    for stratum, strata in ((None, [np.concatenate(list(values.values()))]), ("s", list(values.values()))):
        low, high, side, share = plain(strata)
        wide = high - low
        for block in (metrics.BLOCK, 40):
            found = metrics.resampled(pairs, "task", stratum, 5, block=block).first()
            again = metrics.resampled(pairs.repartition(3), "task", stratum, 5, block=block).first()
            assert abs(found["difference"] - np.mean([v.mean() for v in strata])) < 1e-9 and abs(found["low"] - again["low"]) < 1e-9
            assert abs(found["low"] - low) < 0.08 * wide and abs(found["high"] - high) < 0.08 * wide and abs(found["one_sided_low"] - side) < 0.08 * wide and abs(found["improvement"] - share) < 0.04


def test_counts_of_blocks_are_those_of_drawing_from_all():
    sizes = [50, 30, 0, 20]
    paths = [[100, 80, 50], [100, 80, 30], None, [100, 20, 20]]
    counts = np.array([metrics._splits(p, "s", 4000, 9, i) if p else np.zeros(4000, int) for i, p in enumerate(paths)])
    assert (counts.sum(axis=0) == 100).all() and np.allclose(counts.mean(axis=1), sizes, atol=0.5)
    assert abs(np.cov(counts)[0, 1] + 100 * 0.5 * 0.3) < 2 and abs(counts[0].var() - 25) < 2


def test_of_nothing(spark):
    found = metrics.resampled(spark.createDataFrame([], "task long, difference double"), "task", None, 1).first()
    assert found["difference"] is None and found["low"] is None and found["improvement"] is None


def test_draws_are_those_of_the_sql_for_any_number_of_slices_and_tables(spark):
    """beyond one block the draws were others than the SQL's."""
    rng = np.random.default_rng(2)
    values, rounds, (a, b, c, _) = rng.normal(0.1, 1, 500), 200, metrics.FACTORS
    salt = int(hashlib.md5(b"").hexdigest()[:7], 16)
    fifth = lambda x: pow(x, 5, metrics.PRIME)
    keys = [fifth((i * a + salt * c + 7) % metrics.PRIME) for i in range(500)]
    means = sorted(np.mean([values[fifth((k + number * b) % metrics.PRIME) % 500] for k in keys]) for number in range(1, rounds + 1))
    pairs = spark.createDataFrame([(1000 - i, float(x)) for i, x in enumerate(values[::-1])], "task long, difference double")
    for block, held in ((metrics.BLOCK, metrics.HELD), (40, metrics.HELD), (40, 64), (metrics.BLOCK, 7)):
        found = metrics.resampled(pairs, "task", None, 7, rounds, block, held).first()
        assert np.allclose([found["low"], found["high"], found["one_sided_low"]], [means[5], means[195], means[10]], rtol=0, atol=1e-12)
        assert found["improvement"] == np.mean([m > 0 for m in means]) and abs(found["difference"] - values.mean()) < 1e-12
