"""Features of a shadow profile and what they refuse; routed reranking and its fallback."""
import pytest
from pyspark.sql import functions as F

from factloom.operators import retrieval

COLUMNS = "memory_id long, fts_rank int, vector_rank int, graph_rank int, temporal_rank int, freshness string, truth_state string, scope_type string, evidence_count long, helpful long, unhelpful long, confidence double, importance double, reranker_score double"
GOOD = (1, 2, None, 1, 4, "suspect", "contested", "branch", 3, None, 1, 0.5, 1.0, None)


def test_nineteen_features(spark):
    row = retrieval.shadow_features(spark.createDataFrame([GOOD], COLUMNS)).select(*retrieval.FEATURES).first().asDict()
    told = {k: round(v, 6) for k, v in row.items() if v}
    assert len(row) == 19 and told == {"fts_reciprocal_rank": 0.5, "graph_reciprocal_rank": 1.0, "temporal_reciprocal_rank": 0.25, "freshness_suspect": 1.0, "scope_branch": 1.0, "truth_contested": 1.0, "evidence_log1p": 1.386294, "unhelpful_feedback_log1p": 0.693147, "memory_confidence": 0.5, "memory_importance": 1.0}


@pytest.mark.parametrize("place, value", [(5, "stale"), (5, "rotten"), (5, None), (1, 0), (8, -1), (11, 1.5), (12, None), (13, float("inf")), (13, float("nan"))])
def test_wrong_rows_are_errors(spark, place, value):
    frame = spark.createDataFrame([GOOD[:place] + (value,) + GOOD[place + 1 :]], COLUMNS)
    with pytest.raises(Exception, match="stale rows|must"):
        retrieval.shadow_features(frame).select(*retrieval.FEATURES).collect()


def test_routed_scores_replace_and_fall_back(spark):
    rows = [(q, m, 1.0 - m / 10, 0.5, s) for q, scores in ((1, [0.1, 0.9, 0.4, 0.99]), (2, [0.1, None, 0.4, 0.9]), (3, [0.1, 1.2, 0.4, 0.9]), (4, [0.1, float("nan"), 0.4, 0.9])) for m, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "query_id long, memory_id long, final_score double, factor double, share double")
    found = retrieval.rerouted(frame, F.col("share"), 3).orderBy("query_id", "rank").collect()
    order = {q: [r["memory_id"] for r in found if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert order == {1: [1, 2, 0, 3], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: [0, 1, 2, 3]}
    assert [round(r["final_score"], 6) for r in found if r["query_id"] == 1] == [0.45, 0.2, 0.05, 0.7]
