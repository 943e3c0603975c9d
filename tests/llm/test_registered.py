"""The registered queries themselves, on the smallest tables, and the whole pipeline."""
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import queries
from tests import oracle
from tests.llm.test_documents import components_of, plain_spans, shingles

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    2: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 3: "doc_id n_shingles component_id kept", 4: "doc_id piece start length ids_crc32 sequence_id offset", 5: "doc_id n_tokens ids_sha256 decoded_sha256",
    7: "query_id rank vec_id score", 8: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 9: "doc_id held_out score predicted", 10: "doc_id held_out lang_pred score",
    11: "vec_id component n deviation whitened explained identity_error", 12: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley", 13: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_returns_its_whole_table(spark, texts, name):
    out = entry.queries()[name](spark, FOLDER)
    number = int(name[2:].split("_")[0])
    assert set(COLUMNS.get(number, "doc_id").split()) <= set(out.columns)
    rows = out.collect()
    if number in (2, 3, 5, 6, 8, 9, 10):
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    elif number == 4:
        assert {r["doc_id"] for r in rows} == set(texts)
    if number == 2:
        assert all([r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [len(v) for v in plain_spans(texts[r["doc_id"]] or "").values()] for r in rows)
    if number == 3:
        wanted = components_of({i: shingles(t, 2) for i, t in texts.items()})
        assert {r["doc_id"]: r["component_id"] for r in rows} == wanted
    if number == 8:
        assert {r["doc_id"]: r["near_class"] for r in rows} == components_of({i: shingles(t or "", 5) for i, t in texts.items()})
    if number in (3, 7, 12, 13):
        assert oracle.of_frame(out) == oracle.of_sql(oracle.connect(FOLDER), queries.oracle_sql()[name])


def test_the_pipeline_as_registered(spark, texts):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r["doc_id"] for r in out}
    assert kept <= set(texts) and len(kept) > 0.7 * len(texts)
    groups = components_of({i: shingles(texts[i], 5) for i in texts})
    assert all(groups[i] == i for i in kept)
