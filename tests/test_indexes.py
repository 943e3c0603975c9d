"""Kept indexes against full rebuilds and exact search, and expiry by timers against the batch filter."""
import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import intervals
from factloom.operators import retrieval
from factloom.plans import registry
from factloom.sources import postings, vectors
from factloom.streaming import streams

MEMORIES = "memory_id long, title string, content string, subject string, memory_key string, category string, deleted boolean, changed int"
WORDS = "red blue pale dark steel gear widget bolt ring economy".split()


def memory(i, rng, deleted=False, changed=0):
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return (i, say(4), say(30) if i % 9 else None, "s", None, "note", deleted, changed)


def ranked(index, asked):
    rows, df, whole = index.asked(asked.select("term"))
    return sorted((r["query_id"], r["memory_id"], round(r["score"], 9), r["matched"]) for r in retrieval.bm25(rows, whole, asked, df=df).collect())


def test_changes_deletes_and_compaction_rank_as_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    frame = lambda rows: spark.createDataFrame(rows, MEMORIES)
    asked = spark.createDataFrame([(1, "red"), (1, "gear"), (2, "economy"), (2, "nowhere"), (3, "bolt")], "query_id long, term string")
    index = postings.PostingIndex(spark, str(tmp_path / "index"))
    now = {i: memory(i, rng) for i in range(120)}
    index.change(frame(list(now.values())), "first")
    changes = [
        [memory(i, rng, changed=1) for i in range(0, 40, 3)] + [memory(i, rng, True, 1) for i in range(1, 40, 3)] + [memory(500, rng, changed=1)],
        [memory(3, rng, changed=2), memory(3, rng, changed=3), memory(4, rng, changed=2), memory(500, rng, True, 2), memory(999, rng, True, 2)],
        [memory(500, rng, changed=4), memory(0, rng, True, 4)],
    ]
    for k, rows in enumerate(changes):
        index.change(frame(rows), f"change{k}", "deleted", "changed")
        for r in sorted(rows, key=lambda r: r[-1]):
            now.pop(r[0], None)
            if not r[-2]:
                now[r[0]] = r
        again = postings.PostingIndex(spark, str(tmp_path / f"again{k}"))
        again.rebuild(frame(list(now.values())), "all")
        assert index.count() == len(now) and ranked(index, asked) == ranked(again, asked)
        whole = retrieval.bm25(retrieval.postings(frame(list(now.values()))), retrieval.collection(frame(list(now.values()))), asked)
        assert ranked(index, asked) == sorted((r["query_id"], r["memory_id"], round(r["score"], 9), r["matched"]) for r in whole.collect())
        index.change(frame(rows), f"change{k}", "deleted", "changed")  # repeated under its name: nothing changes
        assert index.count() == len(now)
    before = ranked(index, asked)
    index.compact("compact")
    assert list(index.lines()) == ["compact"] and ranked(index, asked) == before and index.count() == len(now)
    assert [r["memory_id"] for r in index.missing(frame([memory(5, rng), memory(777, rng)])).collect()] == [777]
    index.change(frame([memory(6, rng, True)]), "after", "deleted")
    assert index.count() == len(now) - 1


def test_an_index_follows_a_stream(spark, tmp_path):
    rng = random.Random(2)
    now = {}
    for k in range(4):
        rows = [memory(i, rng, k > 0 and i % 5 == 0, k) for i in range(k * 10, k * 10 + 30)]
        spark.createDataFrame(rows, MEMORIES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for r in rows:
            now.pop(r[0], None)
            if not r[-2]:
                now[r[0]] = r
        time.sleep(1.1)  # files are taken in order of their time
    index = postings.PostingIndex(spark, str(tmp_path / "index"))
    stream = spark.readStream.schema(MEMORIES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index.keep(stream, str(tmp_path / "checkpoint"), "deleted", "changed", compact_after=2).awaitTermination()
    asked = spark.createDataFrame([(1, "red"), (2, "steel")], "query_id long, term string")
    again = postings.PostingIndex(spark, str(tmp_path / "again"))
    again.rebuild(spark.createDataFrame(list(now.values()), MEMORIES), "all")
    assert index.count() == len(now) and len(index.lines()) <= 3 and ranked(index, asked) == ranked(again, asked)


def test_a_second_search_takes_half_the_time(spark):
    run = registry.queries()["R3_bm25"]
    took = []
    for _ in range(2):
        began = time.time()
        run(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] <= 0.5 * took[0]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 12)) * 3
    rows = (centers[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 12))).tolist()
    return [(i, v) for i, v in enumerate(rows)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [1.0, 2.0]), (2004, [None, 1.0])]


def test_the_vector_index_finds_what_exact_search_finds(spark, tmp_path, clustered):
    table = spark.createDataFrame(clustered, "memory_id long, embedding array<double>")
    index = vectors.kept(table, str(tmp_path / "v"), "a")
    made = index.status()["a"]
    assert made["items"] == 1501 and made["probes"] < len(made["centroids"])
    assert vectors.kept(table, str(tmp_path / "v"), "a").status()["a"]["seg"] == made["seg"]  # used again
    asked = table.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(7000, [2.0, 4.0]), (7001, None)], "query_id long, embedding array<double>"))
    found, by_index = index.search("a", asked, 5, table)
    exact = retrieval.cosine_top(table, vectors.searchable(asked, "query_id"), 5)
    have, want = ({(r["query_id"], r["memory_id"]): round(r["score"], 9) for r in rows.collect()} for rows in (found, exact))
    assert by_index and len(set(have) & set(want)) >= 0.9 * len(want) and all(have[p] == want[p] for p in set(have) & set(want)) and (7000, 2003) in have
    # A table that has changed is searched exactly until the index is made to fit.
    changed = table.where("memory_id <> 40").unionByName(spark.createDataFrame([(9000, [1.0] * 12)], table.schema))
    found, by_index = index.search("a", asked, 5, changed)
    assert not by_index and (40, 40) not in {(r["query_id"], r["memory_id"]) for r in found.collect()}
    index.upsert("a", spark.createDataFrame([(9000, [1.0] * 12), (41, [2.0] * 12)], table.schema))
    index.rebuild("b", table.limit(10))
    upserted = table.where("memory_id <> 41").unionByName(spark.createDataFrame([(9000, [1.0] * 12), (41, [2.0] * 12)], table.schema))
    assert index.fits("a", upserted) and not index.fits("a", table) and index.rows("b").count() == 10
    index.clear("a")
    assert index.rows("a").count() == 0 and index.rows("b").count() == 10 and not index.fits("a", upserted)
    assert vectors.kept(table.limit(0), str(tmp_path / "none"), "a").search("a", asked, 5, table.limit(0))[0].count() == 0


def test_expiry_by_timers_equals_the_filter(spark, tmp_path):
    zero = dt.datetime(2024, 1, 1)
    hours = lambda n: zero + dt.timedelta(hours=n)
    schema = "memory_id long, created_at timestamp, ttl_seconds int, changed_at timestamp"
    rng = random.Random(4)
    first = [(i, hours(i), None if i % 5 == 0 else 3600 * rng.randrange(1, 200), hours(i)) for i in range(60)]
    later = [(i, hours(i), None if i % 2 else 3600 * 400, hours(61 + i / 100)) for i in range(0, 20, 3)]  # lives changed before their end or after
    stale = [(30, hours(30), 3600, hours(58))]  # comes late, but within the watermark; it was changed last
    mark = [(10_000, hours(250), None, hours(250))]
    lost = [(50, hours(50), None, hours(51))]  # far behind the watermark: dropped
    end = [(10_001, hours(251), None, hours(251))]
    for rows in (first, later + stale, mark, lost, end):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = streams.expiring(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("changed_at", "4 hours"))
    told = sorted((r["memory_id"], r["expired_at"]) for r in streams.drained(stream, "expired_by_timer", "append").collect())
    records = {}
    for r in sorted(first + later + stale, key=lambda r: r[3]):
        records[r[0]] = r
    table = spark.createDataFrame(list(records.values()), schema)
    at = F.lit(hours(247)).cast("timestamp")  # the last watermark
    want = table.where("ttl_seconds is not null").where(~intervals.lives(F.col("created_at"), F.col("ttl_seconds"), at)).collect()
    ends = sorted((r["memory_id"], r["created_at"] + dt.timedelta(seconds=r["ttl_seconds"])) for r in want)
    changed = {r[0] for r in later}
    # What had ended before its life was changed has been told already.
    assert [e for e in told if e[0] not in changed] == [e for e in ends if e[0] not in changed] and set(told) >= set(ends)
    assert 50 not in {i for i, _ in told} and 30 in {i for i, _ in told}
