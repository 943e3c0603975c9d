"""Channels of a batch of queries: what many queries ask alike is looked up once, and cuts lose nothing."""
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import claims
from factloom.operators.graph import with_checkpoints
from factloom.sources.model import Store

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark):
    draw = random.Random(4)
    tables = {
        "claims": spark.createDataFrame([(i, draw.randrange(150), draw.randrange(40), draw.randrange(10**6)) for i in range(3000)], "claim_id long, memory_id long, subject_entity_id long, moment long").selectExpr("*", "timestamp_micros(moment) as recorded_at"),
        "evidence": spark.createDataFrame([(draw.randrange(60), draw.randrange(3000)) for _ in range(6000)], "anchor_id long, claim_id long"),
        "anchors": spark.createDataFrame([(i, f"src/{draw.choice('abc')}/w{i % 7}.py", draw.choice(["x.economy", "economy.plate", "w3", None])) for i in range(60)], "anchor_id long, path string, symbol_fqn string"),
        "entities": spark.createDataFrame([(i, f"name {i}" if i % 5 else "machinery", "machinery" if i % 2 else "other") for i in range(40)], "entity_id long, normalized_name string, entity_type string"),
    }
    with_checkpoints(spark)
    return {name: frame.checkpoint() for name, frame in tables.items()}


def written(spark, rows):
    """Bytes of the shuffle and spill files that a query writes."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def sizes():
        files = manager.getAllFiles()
        return {(f := files.apply(i)).getName(): f.length() for i in range(files.size())}

    before = sizes()
    rows().write.format("noop").mode("overwrite").save()
    return sum(size for name, size in sizes().items() if name not in before)


def test_equal_terms_and_words_move_evidence_and_claims_once(spark, store):
    """F4 to F15: evidence, claims and entities were copied for each query that named the same."""
    wanted = lambda n: spark.range(n).select(F.col("id").alias("query_id"), F.lit("economy").alias("term"))
    words = lambda n: spark.range(n).select(F.col("id").alias("query_id"), F.lit("machinery").alias("word"))
    anchored = lambda n: lambda: claims.anchor_matches(store["claims"], store["evidence"], store["anchors"], wanted(n), 5)
    seeds = lambda n: lambda: claims.graph_seeds(store["claims"], store["entities"], words(n), 5)
    for found in (anchored, seeds):
        assert written(spark, found(100)) < 3 * written(spark, found(1))


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_cuts_by_term_and_word_lose_nothing(spark, store, limit):
    wanted = spark.createDataFrame([(1, "economy"), (1, "w3.py"), (2, "w3"), (3, "economy"), (3, "src/a/w1.py"), (4, "none")], "query_id long, term string")
    rows = lambda most: sorted(map(tuple, claims.anchor_matches(store["claims"], store["evidence"], store["anchors"], wanted, most).where(F.col("rank") <= limit).collect()))
    assert rows(limit) == rows(None) and len(rows(limit)) >= 3
    words = spark.createDataFrame([(1, "machinery"), (1, "name 3"), (2, "other"), (2, "name 3"), (2, "name 4")], "query_id long, word string")
    seeds = {most: [tuple(r) for r in claims.graph_seeds(store["claims"], store["entities"], words, most).collect()] for most in (limit, None)}
    best = lambda most: {q: sorted((r for r in seeds[most] if r[0] == q), key=lambda r: (-r[3], -r[4].timestamp(), r[2]))[:limit] for q in (1, 2)}
    assert best(limit) == best(None) and best(None)[1]


@pytest.mark.parametrize("few", [0, 500_000])
def test_relations_of_claims_are_those_of_the_table(spark, monkeypatch, few):
    from factloom.sources import model

    monkeypatch.setattr(model, "_FEW", few)
    t = Store(spark, FOLDER)
    asked = t.claims.select("claim_id").where("claim_id % 41 = 0")
    ids = {r[0] for r in asked.collect()}
    expected = sorted(tuple(r) for r in t.claim_relations.collect() if r[0] in ids or r[1] in ids)
    assert len(expected) > 10 and sorted(map(tuple, t.relations_of(asked).collect())) == expected
