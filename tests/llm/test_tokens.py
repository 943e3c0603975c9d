import base64
import random
import time
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import bpe, op4_packing, op5_bpe
from factloom.llm.queries import vocabulary
from tests.llm import cases

RANKS, WORDS = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n):
    rng = random.Random(5)
    alphabet = " \n\t'sStmdrevleabcÉéß ,.!?0123456789 　中文字йΣσςİ²½́e\x85\x1c\x0b🙂_-"
    return ["", "'s", "don't", "l''s 're", "a  b", "a \n b ", "x" * 1000 + " y", "ab" * 700, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(n))]


def test_ids_equal_those_of_the_libraries(library):
    texts = noise(600)
    ids, at = bpe.encode(texts, bpe.rank_vocabulary(RANKS))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    ids, at = op4_packing.token_ids([*texts, "a <|endoftext|> b"], WORDS)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts, "a <|endoftext|> b"]]


def test_wide_words_equal_the_libraries(library):
    rng = random.Random(7)
    alphabets = ["ab", "the", "aeinorst", "abcdefghijklmnopqrstuvwxyz", "éßaü"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (257, 300, 999, 2500)] + ["a" * 5000, "=" * 3001, "the" * 900]
    ids, at = bpe.encode(texts, bpe.rank_vocabulary(RANKS))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode_ordinary(t) for t in texts]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    ids, at = op4_packing.token_ids(texts, WORDS)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_documents_equal_the_library(library):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    ids, at = bpe.encode(texts, bpe.rank_vocabulary(RANKS))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library.encode_ordinary_batch(texts)


def test_encoding_and_decoding_of_awkward_rows(spark, library):
    out = {r["doc_id"]: r for r in op5_bpe.digests(cases.frame(spark), RANKS).collect()}
    for doc_id, text, *_ in cases.rows():
        ids = library.encode_ordinary(text or "")
        assert (out[doc_id]["n_tokens"], out[doc_id]["ids_sha256"], out[doc_id]["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest())
    assert op5_bpe.digests(cases.frame(spark, []), RANKS).count() == 0
    back = {r["doc_id"]: r["text"] for r in op5_bpe.decoded(op5_bpe.encoded(cases.frame(spark), RANKS), RANKS).collect()}
    assert back == {i: t or "" for i, t, *_ in cases.rows()}


def test_packing_places_every_piece(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORDS))
    out = op4_packing.pack(cases.frame(spark), WORDS).collect()
    wanted = Counter()
    for doc_id, text, *_ in cases.rows():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.update((doc_id, k, s, len(p := ids[s : s + 4096]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096)))
    assert wanted == Counter(tuple(r)[:5] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in out) // 4096)
    assert op4_packing.pack(cases.frame(spark, []), WORDS).count() == 0


def fewest(items, capacity):
    """Brute force over bins of sorted items."""
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, b in enumerate(bins):
            if b + items[i] <= capacity and b not in bins[:j]:
                place(i + 1, [*bins[:j], b + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize(("counts", "bins"), [({3: 6825000}, 5000), ({3: 6825000, 2000: 2}, 5001), ({2: 5000, 1367: 300, 5: 1000}, 150), ({2: 100000, 1367: 3000, 5: 20000}, 1500), ({1: 10**9}, 244141), ({1: 3}, 1), ({}, 0)])
def test_short_pieces_in_plenty_are_packed_at_once(counts, bins):
    began = time.process_time()
    runs = op4_packing.pack_counts(counts)
    assert time.process_time() - began < 5 and sum(n for _, n in runs) == bins
    packed = Counter()
    for items, n in runs:
        assert sum(items) <= 4096
        packed.update({x: k * n for x, k in Counter(items).items()})
    assert packed == Counter(counts)


def test_a_search_ends_with_its_steps():
    rng = random.Random(3)
    counts = {1000 + 7 * i: rng.randrange(1, 500) for i in range(200)}
    began = time.process_time()
    runs = op4_packing.pack_counts(counts, steps=50_000)
    assert time.process_time() - began < 5 and op4_packing.least_bins(counts, 4096) <= sum(n for _, n in runs) <= sum(n for _, n in op4_packing.best_fit(counts, 4096))


def test_a_table_of_one_word_documents_is_packed(spark):
    docs = spark.range(100_000).selectExpr("id as doc_id", "'word' as text")
    out = op4_packing.pack(docs, WORDS)
    found = out.agg(F.count("*").alias("n"), F.max("length").alias("each"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("sequence_id").alias("bins")).first()
    assert found["n"] == 100_000 and found["end"] <= 4096 and found["bins"] == -(-100_000 // (4096 // found["each"]))


def test_bin_completion_is_as_good_as_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
        runs = op4_packing.pack_counts(dict(Counter(items)), 20)
        assert Counter(x for bin_, n in runs for x in bin_ * n) == Counter(items)
        assert all(sum(b) <= 20 for b, _ in runs)
        assert sum(n for _, n in runs) == fewest(items, 20)
