"""Joins without equal keys against brute force."""
import datetime as dt
import difflib
import random

import pytest

from factloom.operators import joins

NTZ = "id long, slot string, valid_from timestamp_ntz, valid_to timestamp_ntz"
ZERO = dt.datetime(2020, 1, 1)


def spans(seed, n, slots, length, total, gaps=True):
    rng, out = random.Random(seed), []
    for i in range(n):
        start = ZERO + dt.timedelta(seconds=rng.randrange(total))
        end = start + dt.timedelta(seconds=rng.randrange(length) if i % 9 else rng.randrange(total))
        out.append((i, rng.choice(slots), None if gaps and i % 31 == 0 else start, None if gaps and i % 17 == 0 else end))
    return out


def meets(a, b):
    low = max((x for x in (a[2], b[2]) if x), default=None)
    high = min((x for x in (a[3], b[3]) if x), default=None)
    empty = lambda r: r[2] is not None and r[3] is not None and r[2] >= r[3]
    return not empty(a) and not empty(b) and (low is None or high is None or low < high)


@pytest.mark.parametrize(("block", "small"), [(50_000, 64), (20, 0)])
def test_overlaps_equal_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(joins, "SLOT_POINTS", block)
    monkeypatch.setattr(joins, "SMALL_SLOT", small)
    a, b = spans(1, 160, "xyz", 500, 40_000), spans(2, 120, "xyw", 3000, 40_000)
    left, right = spark.createDataFrame(a, NTZ), spark.createDataFrame(b, NTZ)
    found = sorted((r["left"]["id"], r["right"]["id"]) for r in joins.overlapping(left, right, ["slot"]).collect())
    assert found == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and meets(x, y))
    found = sorted((r["left"]["id"], r["right"]["id"]) for r in joins.overlapping_within(left, ["slot"], "id").collect())
    assert found == sorted((x[0], y[0]) for x in a for y in a if x[0] < y[0] and x[1] == y[1] and meets(x, y))


def test_overlaps_of_few_rows(spark):
    none = spark.createDataFrame([], NTZ)
    assert joins.overlapping(none, none, ["slot"]).count() == 0 and joins.overlapping_within(none, ["slot"], "id").count() == 0
    open_ = spark.createDataFrame([(1, "s", None, None), (2, "s", None, None), (3, "s", None, None), (4, None, None, None)], NTZ)
    assert joins.overlapping_within(open_, ["slot"], "id").count() == 3


def test_a_hot_slot_makes_no_more_pairs_than_it_returns(spark):
    rows = spark.createDataFrame(spans(3, 6000, ["hot"], 60, 2_000_000, gaps=False), NTZ)
    timed = joins._timed(rows, ["slot"], "valid_from", "valid_to")
    met = joins.met(timed, timed, ["slot"], joins.Tree(timed)).count()
    returned = joins.overlapping_within(rows, ["slot"], "id").count()
    assert returned > 100_000 and met < 1.1 * returned + 5 * 6000 and returned < 0.2 * 6000 * 5999 / 2  # of 18 million


def test_contained_terms_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    pieces = ["red", "widget", "_", ".", "py", " ", "é", "中", "文", "a", "b", "🙂", "\n", "%"]
    make = lambda n: "".join(rng.choice(pieces) for _ in range(rng.randrange(n)))
    texts = [(i, make(40)) for i in range(300)] + [(300, None), (301, "")]
    terms = sorted({make(6) for _ in range(150)} | {"", "a", "é", "ab", "red", "nowhere at all", "zz", "🙂", "red widget red", "x" * 300})
    table, wanted = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(t,) for t in [*terms, *terms, None]], "term string")
    expected = sorted((i, t) for i, x in texts for t in terms if x and t and t in x)
    plan = joins.containing(table, wanted)
    assert sorted(map(tuple, plan.collect())) == expected and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "TERMS", 0)
    assert sorted(map(tuple, joins.containing(table, wanted).collect())) == expected
    assert joins.containing(table, wanted.limit(0)).count() == 0 and joins.containing(table.limit(0), wanted).count() == 0


@pytest.mark.parametrize("block", [500, 3])
def test_alike_names_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(joins, "BLOCK", block)
    rng = random.Random(5)
    words = ["red", "blue", "pale", "dark", "steel", "widget", "gear", "economy", "aab", "é"]
    names = [(g, "_".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "s", "1"])) for g in "xy" for _ in range(70)] + [("x", None), ("x", ""), ("x", "a"), ("x", "b")]
    table = spark.createDataFrame(names * 2, "kind string, name string")
    found = sorted((r["kind"], r["a"], r["b"], round(r["similarity"], 9)) for r in joins.alike(table, ["kind"]).collect())
    by = {g: sorted({n for k, n in names if k == g and n is not None}) for g in "xy"}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert found == sorted((g, a, b, round(ratio(a, b), 9)) for g, own in by.items() for a in own for b in own if a < b and 0.65 <= ratio(a, b) < 1)
