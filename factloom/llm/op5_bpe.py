"""Byte-level BPE encoding and decoding of whole texts with a table of ranks (see bpe.py for the method).

Defined results: a null text counts as empty and has no ids; repeated rows and null ids are encoded each; an empty table
gives an empty result; other columns are ignored. Every text decodes to its own bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from factloom.llm import bpe
from factloom.llm.common import documents, parts, ragged, tune


@lru_cache(maxsize=1)
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id in decimal with a space after it: all bytes, starts, lengths."""
    words = [b"%d " % i for i in range(size)]
    lengths = np.array([len(w) for w in words])
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its ids."""

    def run(frames):
        vocabulary = bpe.rank_vocabulary(path)
        for frame in parts(frames):
            ids, at = bpe.encode(frame.text.tolist(), vocabulary)
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "ids": np.split(ids, at[1:-1])})

    tune(docs.sparkSession)
    return documents(docs).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(frames):
        vocabulary = bpe.rank_vocabulary(path)
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "text": [vocabulary.decode(np.asarray(i, np.int64)).decode("utf-8", "replace") for i in frame.ids]})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_tokens, digests of the ids and of the decoded bytes."""

    def run(frames):
        vocabulary = bpe.rank_vocabulary(path)
        digits, begin, width = _decimals(len(vocabulary.lengths))
        for frame in parts(frames):
            ids, at = bpe.encode(frame.text.tolist(), vocabulary)
            spelled = digits[ragged(begin[ids], width[ids])].tobytes()
            text = vocabulary.decode(ids)
            cut = np.concatenate(([0], np.cumsum(width[ids])))[at]
            ends = np.concatenate(([0], np.cumsum(vocabulary.lengths[ids])))[at]
            pairs = lambda x: zip(x[:-1].tolist(), x[1:].tolist(), strict=True)
            yield pd.DataFrame({
                "doc_id": frame.doc_id.astype("Int64"),
                "n_tokens": np.diff(at),
                "ids_sha256": [hashlib.sha256(spelled[a : max(a, b - 1)]).hexdigest() for a, b in pairs(cut)],
                "decoded_sha256": [hashlib.sha256(text[a:b]).hexdigest() for a, b in pairs(ends)],
            })

    tune(docs.sparkSession)
    return documents(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
