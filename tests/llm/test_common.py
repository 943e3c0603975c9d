import re
import time

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import common
from factloom.llm.components import components


def test_stored_tables_can_be_removed(spark):
    common.clear(spark)
    kept = common.stored(spark.range(10), "numbers")
    assert kept.count() == 10 and common.clear(spark) == 1
    assert common.clear(spark) == 0


def test_hashed_keys_find_all_and_nothing_else():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000, dtype=np.uint64))
    table = common.HashedKeys(keys)
    assert (keys[table.order][table.find(keys)] == keys).all()
    assert (table.find(keys + np.uint64(1 << 41)) == -1).all()
    assert (common.HashedKeys(np.zeros(0, np.uint64)).find(keys) == -1).all()


def test_equal_ranges_have_equal_hashes():
    values = np.array([1, 2, 3, 9, 1, 2, 3, 2, 1], np.uint32)
    h = common.range_hashes(values, np.array([0, 4, 6, 0]), np.array([3, 7, 9, 9]))
    assert h[0] == h[1] and len({*h.tolist()}) == 3


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 440)]
    root = list(range(441))
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {x: root[x] for x in touched}


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffles():
        return set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    def written():
        with common.Scratch(spark) as held:
            once = held.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
            yield once
            yield common.stored(once.join(once.groupBy("k").agg(F.sum("count").alias("s")).hint("merge"), "k"), "joined")

    before, setting = shuffles(), spark.conf.get(common.CLEANUP)
    for table in written():
        # Nothing collects garbage here: the files go when the write ends, some moments later.
        for _ in range(100):
            if not (left := shuffles() - before):
                break
            time.sleep(0.1)
        assert not left and table.count() == 7 and spark.conf.get(common.CLEANUP) == setting
        before = shuffles()
