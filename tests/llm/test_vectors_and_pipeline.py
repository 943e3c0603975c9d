import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import op7_topk
from tests.llm import cases


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    vectors[100:400] = vectors[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (850, vectors[850].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    out = sorted(tuple(r) for r in op7_topk.top_k(table, F.col("vec_id") % 50 == 0, shard=200, block=7).collect())
    ids = np.array([*range(900), 850])
    whole = np.floor(256 * np.concatenate((vectors, vectors[850:851])).astype(float)).astype(int)
    wanted = []
    for q in range(0, 900, 50):
        scores = whole @ whole[q]
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:5]
        wanted += [(q, n + 1, int(ids[j]), int(scores[j])) for n, j in enumerate(best)] * (1 + (q == 850))
    assert sorted({*out}) == sorted({*wanted})
    assert op7_topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_the_tree_leaves_pages_closed():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 6)) * 50
    vectors = np.floor(np.repeat(centers, 150, axis=0) + rng.normal(size=(6000, 6))).astype(np.int64)
    tree = op7_topk.MTree(np.arange(6000), vectors)
    asked = np.arange(0, 6000, 50)
    best, ids = tree.search(vectors[asked], asked, 5)
    scores = vectors @ vectors[asked].T
    for j, q in enumerate(asked.tolist()):
        wanted = [i for i in np.lexsort((np.arange(6000), -scores[:, j])).tolist() if i != q][:5]
        assert ids[j].tolist() == wanted and best[j].tolist() == scores[wanted, j].tolist()
    assert tree.computed < 0.5 * 6000 * len(asked)


def test_scores_beyond_doubles_are_exact():
    vectors = np.array([[3_000_000_001, 7], [3_000_000_001, 8], [2, 1], [3_000_000_000, 9]], np.int64)
    best, ids = op7_topk.MTree(np.array([4, 3, 2, 1]), vectors).search(vectors[:1], np.array([4]), 5)
    assert ids[0].tolist()[:3] == [3, 1, 2] and best[0].tolist()[0] == 3_000_000_001**2 + 56 and ids[0][3] == op7_topk.NO_ID


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's result over the awkward rows, as the next one's input."""
    docs, out = cases.frame(spark, [r for r in cases.rows() if r[0] is not None]), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out[name] = docs
    return out


def test_stages_keep_columns_and_clean_rows(stages):
    columns = stages["input"].columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == columns
    ids = lambda name: sorted(r["doc_id"] for r in stages[name].select("doc_id").collect())
    assert {10, 13, 22}.isdisjoint(ids("language_id"))
    near = ids("near_dedup")
    assert 1 in near and 4 not in near and 7 not in near and near.count(1) == 1
    assert ids("substring_dedup") == near == ids("pii")
    text = {r["doc_id"]: r["text"] for r in stages["pii"].collect()}
    assert all("me@site.com" not in t and "555-8389" not in t for t in text.values())
    assert sorted({r["doc_id"] for r in stages["packing"].collect()}) == near


def test_near_dedup_leaves_a_text_of_each_group(spark):
    a, b, c = (" ".join(cases.words(k, 80)) for k in (61, 62, 63))
    rows = [(3, a), (5, a), (5, b), (9, b), (11, c), (11, f"{c} more"), (11, None), (12, c), (13, ""), (13, "")]
    out = corpus_pipeline.near_dedup(spark, cases.texts(spark, rows), "").collect()
    found = sorted((r["doc_id"], r["text"] or "") for r in out)
    assert [f for f in found if f[0] < 11] == [(3, a), (5, b)] and found.count((13, "")) == 1 and (11, "") in found
    assert len([f for f in found if f[0] in (11, 12) and f[1]]) == 1 and len(found) == 5


def test_pipeline_over_empty_documents(spark):
    docs = cases.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
