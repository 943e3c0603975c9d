"""Boundary cases of the memory engine, streams against batches, and files that come back as they went."""
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import intervals, plain, providers, text
from factloom.operators import claims, context, metrics, retrieval
from factloom.sources import tables
from factloom.sources.model import Store
from factloom.streaming import streams

FOLDER = "/root/testdata/sf0.001"
at = intervals.moment


def test_intervals_are_half_open(spark):
    rows = spark.sql("select timestamp_ntz'2024-01-01' as a, timestamp_ntz'2024-02-01' as b")
    hold = lambda m: rows.select(intervals.holds_at(F.col("a"), F.col("b"), at(m))).first()[0]
    assert hold("2024-01-01 00:00:00") and not hold("2024-02-01 00:00:00") and hold("2024-01-31 23:59:59")
    meets = rows.select(intervals.overlaps(F.col("a"), F.col("b"), F.col("b"), F.lit(None).cast("timestamp_ntz"))).first()[0]
    assert not meets


def test_versions_that_meet_are_not_both_visible(spark):
    rows = spark.sql("""select 1L as claim_id, 5L as identity_id, 1 as version_number, 'accepted' as status, timestamp_ntz'2024-01-01' as transaction_from, timestamp_ntz'2024-02-01' as transaction_to, timestamp_ntz'2024-01-01' as valid_from, timestamp_ntz'2024-03-01' as valid_to
        union all select 1L, 5L, 2, 'stale', timestamp_ntz'2024-02-01', null, timestamp_ntz'2024-03-01', null""")
    seen = lambda valid, known: [r["version_number"] for r in claims.visible_versions(rows, at(valid), at(known)).collect()]
    assert seen("2024-02-15 00:00:00", "2024-01-15 00:00:00") == [1]
    assert seen("2024-02-15 00:00:00", "2024-02-01 00:00:00") == []
    assert seen("2024-03-01 00:00:00", "2024-02-01 00:00:00") == [2]


def test_containment_comes_before_contradiction(spark):
    row = "select {0}L as claim_id, 'user' as scope_type, 'k' as scope_key, 1L as subject_entity_id, 'prefers' as predicate, 'current database' as subject, '{1}' as object_value, '{2}' as polarity, timestamp_ntz'2024-01-01' as valid_from, cast(null as timestamp_ntz) as valid_to"
    rows = spark.sql(" union all ".join(row.format(i, *v) for i, v in enumerate([("postgresql", "positive"), ("postgresql version 17", "positive"), ("mysql", "positive"), ("postgresql", "negative")])))
    found = {(r[0], r[1]): r[2] for r in claims.classified_pairs(rows).collect()}
    assert found == {(0, 1): "supports", (0, 2): "contradicts", (0, 3): "contradicts", (1, 2): "contradicts", (1, 3): "contradicts", (2, 3): "contradicts"}


def test_target_is_found_among_decoys(spark):
    memories = spark.range(3000).select(F.col("id").alias("memory_id"), F.when(F.col("id") == 1234, "rare pangolin note").otherwise("common note").alias("title"), F.lit("common text").alias("content"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("memory_key"), F.lit("note").alias("category"))
    asked = retrieval.query_terms(spark.createDataFrame([(1, "pangolin note")], "query_id long, query string"))
    assert retrieval.best(retrieval.bm25(retrieval.postings(memories), retrieval.collection(memories), asked), 1).first()["memory_id"] == 1234


def test_fusion_and_its_ceiling(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, memory_id long, rank int")
    two = spark.createDataFrame([(1, 11, 1)], "query_id long, memory_id long, rank int")
    fused = retrieval.normalised(retrieval.fuse({"fts": one, "vector": two}), ["fts", "vector"])
    out = {r["memory_id"]: r for r in fused.collect()}
    assert out[10]["score"] == pytest.approx(1 / 61) and out[11]["score"] == pytest.approx(1 / 62 + 1 / 61)
    assert out[11]["normalised"] == pytest.approx((1 / 62 + 1 / 61) / (2 / 61)) and out[10]["vector_rank"] is None


def test_diversity_equals_brute_force(spark):
    rows = [(1, i, 1 - i / 20, [f"w{i % 3}", f"w{i % 5}", "x"]) for i in range(12)]
    frame = spark.createDataFrame(rows, "query_id long, memory_id long, final_score double, tokens array<string>")
    got = [r["memory_id"] for r in retrieval.diversified(frame, 5).orderBy("position").collect()]
    left, chosen = list(rows), []
    while len(chosen) < 5:
        near = lambda r: max((len(set(r[3]) & set(c[3])) / len(set(r[3]) | set(c[3])) for c in chosen), default=0.0)
        best = max(left, key=lambda r: 0.78 * r[2] - 0.22 * near(r))
        left.remove(best)
        chosen.append(best)
    assert got == [c[1] for c in chosen]


def test_bundles_are_packed_whole(spark):
    rows = [(1, 1, 9.0, 50, "decision", "resolved", "own 1"), (1, 2, 8.0, 40, "note", "contested", "group 7"), (1, 3, 0.1, 60, "note", "contested", "group 7"), (1, 4, 1.0, 30, "note", "resolved", "own 4")]
    frame = spark.createDataFrame(rows, "query_id long, memory_id long, utility double, cost long, category string, truth_state string, bundle string")
    bundles = context.bundled(frame, ["decision"])
    assert {r["bundle"]: (r["safety"], r["required"], r["place"]) for r in bundles.collect()} == {"own 1": (False, True, 1), "group 7": (True, True, 2), "own 4": (False, False, 3)}
    picked = lambda budget: {r["bundle"] for r in context.filled(bundles, spark.createDataFrame([(1, budget)], "query_id long, budget long")).collect()}
    assert picked(1000) == {"own 1", "group 7", "own 4"} and picked(6 + 50 + 99) == {"own 1", "own 4"} and picked(6 + 40) == {"own 4"}


def test_hard_budgets_below_the_floor_fail(spark):
    request = lambda hard: spark.createDataFrame([(1, "broad_search", 1, False, 900, 500, hard)], "query_id long, intent string, coverage long, contested boolean, safe_cost long, asked int, hard boolean")
    limits = {"tiny": 1, "small": 2, "medium": 3, "large": 4}
    row = context.budget_plan(request(False), limits).first()
    assert row["profile"] == "custom" and row["budget"] == 900 and row["floor_raised"]
    with pytest.raises(Exception, match="below what safety needs"):
        context.budget_plan(request(True), limits, counts_exactly=True).collect()


def test_missing_values_poison_a_sum(spark):
    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "k string, cache_hit_tokens long")
    assert {r[0]: r[1] for r in rows.groupBy("k").agg(metrics.whole_sum("cache_hit_tokens")).collect()} == {"a": None, "b": 2}


def test_redaction_in_order(spark):
    line = "key sk-abcdefghijklmnopqrst and password=hunter22 then Bearer abcdefghijklmnop"
    got = spark.createDataFrame([(line,)], "t string").select(text.redact(F.col("t")).alias("r")).first()["r"]
    assert "hunter22" not in got["text"] and got["detected"] == ["openai_key", "bearer", "password_assignment"]


def test_claims_are_extracted_with_spans(spark):
    rows = spark.createDataFrame([("We use Redis. Never use MySQL!",)], "t string").createOrReplaceTempView("notes") or spark
    rows.udtf.register("extract_claims", providers.ExtractClaims)
    got = spark.sql("select c.* from notes, lateral extract_claims(t) c").collect()
    assert {(r["predicate"], r["object"]) for r in got} == {("uses", "redis"), ("forbidden", "mysql")}


def test_transitions_are_strictly_later(spark):
    one = spark.sql("select 1L as claim_id, 1 as version_number, 'accepted' as status, timestamp_ntz'2024-01-01' as transaction_from, cast(null as timestamp_ntz) as transaction_to")
    change = spark.sql("select 1L as claim_id, 'rejected' as status, timestamp_ntz'2023-01-01' as at")
    got = sorted(claims.append_transition(one, change).collect(), key=lambda r: r["version_number"])
    assert got[0]["transaction_to"] == got[1]["transaction_from"] > got[0]["transaction_from"] and got[1]["status"] == "rejected"


def test_redirect_cycles_are_errors(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    with pytest.raises(ValueError):
        claims.resolved_redirects(spark.createDataFrame([(1, 2), (2, 1)], "entity_id long, target_id long"), 5).count()


def test_fits_and_juries(spark):
    rows = spark.createDataFrame([(float(x), int(x > 0)) for x in (-3, -2, -1, 1, 2, 3)], "f double, label int")
    fit = lambda **more: metrics.fold_fits(rows, ["f"], **more)[0]["weights"][0]
    assert fit() > 0.5 and fit(signs=[-1]) == 0
    results = spark.createDataFrame([(1, 1, 2, 0.9, 1.0), (1, 2, 3, 0.8, 1.0)], "query_id long, a_id long, b_id long, p_a double, weight double")
    order = [r["candidate_id"] for r in metrics.bradley_terry(results).orderBy(F.desc("utility")).collect()]
    assert order == [1, 2, 3]


def test_json_lines_come_back(spark, tmp_path):
    t = Store(spark, FOLDER)
    rows = t.memories.limit(30).select("memory_id", "title", "created_at", "ttl_seconds")
    manifest = tables.write_json_lines({"memory": rows}, str(tmp_path / "out"))
    assert manifest.first()["rows"] == 30
    lines = spark.read.text(str(tmp_path / "out/memory"))
    back = tables.from_json_lines(lines, {"memory": rows.schema})["memory"]
    assert sorted(back.collect()) == sorted(rows.collect())
    bad = spark.createDataFrame([("{",), (json.dumps({"type": "alien"}),), (json.dumps({"type": "memory"}),)], "value string")
    assert {r[0]: r[1] for r in tables.rejected_lines(bad, ["memory"]).collect()} == {"malformed": 1, "unknown_kind": 1}


def test_backups_keep_their_schema(spark, tmp_path):
    rows = Store(spark, FOLDER).sources
    tables.backup({"sources": rows}, str(tmp_path / "b"))
    assert tables.restore(spark, str(tmp_path / "b"), {"sources": rows.schema})["sources"].count() == rows.count()
    with pytest.raises(ValueError):
        tables.restore(spark, str(tmp_path / "b"), {"sources": rows.select("source_id").schema})


def test_upsert_takes_the_new_row(spark):
    old, new = (spark.createDataFrame(r, "k long, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (2, "d"), (3, "e")]))
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_streams_end_like_batches(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("event_id", "user_id as memory_id", "event_type as action", "cast(ts as timestamp) as ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read(spark, str(tmp_path / "in"), events.schema, "ts", "40 days")
    batch = sorted(streams.windowed(events, "ts", "1 day").collect())
    assert sorted(streams.drained(streams.windowed(stream, "ts", "1 day"), "windows").collect()) == batch
    assert sorted(streams.drained(streams.last_state(stream), "states").collect()) == sorted(streams.last_state(events).collect())


def test_entity_names_and_json(spark):
    names = {" Fast API ": "fastapi", "Ｐostgres": "postgresql", "./src//app.py": "src/app.py", "/etc/./x": "/etc/x", "https://a.b//c": "https://a.b//c", "Café, (au) Lait.": "café au lait", "C++ & C#": "c++ c#", "...": "", None: None}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", plain.normalized_entity("n").alias("e")).collect()
    assert {r["n"]: r["e"] for r in got} == names
    settled = plain.settled_payload("abc", 5)
    assert settled["used"] == len(settled["text"])


def test_the_first_row_counts_among_evidence_of_one_time_and_id(spark, tmp_path):
    """the last row counted, or any."""
    from factloom.plans import registry
    from tests import oracle

    db = oracle.connect(FOLDER)
    for name in ("documents", "orders"):
        db.execute(f"copy (from {name}) to '{tmp_path}/{name}.parquet'")
    db.execute(f"copy (select range as s_suppkey, 'Supplier ' || range as s_name, 1 as s_nationkey from range(1000)) to '{tmp_path}/supplier.parquet'")
    lines = "select l.* replace (timestamp '2001-01-01' as l_shipdate, 1 as l_linenumber, (l_orderkey * 7 + i * 13) % 1000 as l_suppkey) from (select distinct on (l_orderkey) * from lineitem) l, (select unnest(range(4)) as i) order by l_orderkey // 100 desc, i, l_orderkey"
    db.execute(f"copy ({lines}) to '{tmp_path}/lineitem.parquet'")
    own = oracle.connect(str(tmp_path))
    own.execute("set threads = 1")
    expected = oracle.of_sql(own, registry.oracle_sql()["J7_newest_source"])
    assert len(expected[1]) > 100 and oracle.of_frame(registry.queries()["J7_newest_source"](spark, str(tmp_path))) == expected
