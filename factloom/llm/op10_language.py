"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is a row of symbols: lower-case letters, and one boundary for each run of anything else. Models of `ORDER` symbols
are kept for all languages together: for every order one sorted hash array of the n-grams that any language has, with each
language's interpolated log probability, and one of contexts with each language's back-off weight. A text goes to the
language of lowest cross-entropy for a symbol. It is rejected where that cross-entropy lies beyond what held-back rows of
that language show at such a length.

Learning uses a sample of labelled rows bounded by ROWS and CHARS for each language; everything else covers all rows. A symbol
has 16 bits: of the letters in that sample the 60,000 most frequent are symbols of their own, all others are one. Texts are read
whole, however long, BATCH_CHARS code points at a time (a longer text by itself).

Defined results: `und`, score 0 and rejection for null texts and texts without a letter, and for all texts if nothing can be
learned; rows are judged one by one, so repeated rows, ties of ids and null ids make no difference; equal cross-entropies go
to the first language in order; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BATCH_CHARS, HashedKeys, code_points, documents, tune
from factloom.llm.pretokens import LETTER, classes

ORDER = 4
#: Bounds of the sample that each language is learned from.
ROWS, CHARS = 600, 2_000_000
UNKNOWN = "und"
#: Held-back rows may be rejected so often; their bound is then widened by so much.
MISS, WIDER = 0.002, 2.5
#: Cross-entropy that any length may have above its language's mean.
SLACK = 0.5
MASKS = [np.uint64((1 << 16 * k) - 1) for k in range(5)]
SHIFT = np.uint64(16)


@dataclass
class Level:
    grams: HashedKeys
    log_p: np.ndarray
    contexts: HashedKeys
    log_weight: np.ndarray


@dataclass
class Models:
    languages: list[str]
    symbols: np.ndarray  # of each code point
    unigram: np.ndarray
    levels: list[Level]  # of order 2 on
    mean: np.ndarray
    bound: np.ndarray


def _lower() -> np.ndarray:
    """The lower case of each code point that has one of a single character."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(classes() == LETTER).tolist():
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of each code point: 0 for a boundary, 1 for letters unseen in these texts, then the letters seen."""
    low = _lower()
    codes, _ = code_points(texts)
    count = np.bincount(low[codes], minlength=0x110000)
    count[classes() != LETTER] = 0
    seen = np.argsort(-count, kind="stable")[: min(60_000, int((count > 0).sum()))]
    out = np.where(classes() == LETTER, 1, 0).astype(np.uint16)
    out[seen] = np.arange(2, 2 + len(seen))
    return np.where(classes() == LETTER, out[low], 0).astype(np.uint16)


def grams(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram of ORDER symbols that ends at each symbol, 16 bits each and the last lowest; and where each text's begin.

    A boundary stands before and after each text.
    """
    codes, starts = code_points(texts)
    s = symbols[codes]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[starts[:-1][starts[:-1] < len(s)]] = True
    number = np.concatenate(([0], np.cumsum(keep)))[starts]
    pad = ORDER - 1
    rows = np.arange(len(texts))
    padded = np.zeros(int(number[-1]) + len(texts) * (pad + 1), np.uint64)
    padded[np.arange(number[-1]) + np.repeat(rows * (pad + 1) + pad, np.diff(number))] = s[keep]
    out = padded[pad:].copy()
    for k in range(1, ORDER):
        out |= padded[pad - k : len(padded) - k] << np.uint64(16 * k)
    own = np.ones(len(padded), bool)
    begin = number[:-1] + rows * (pad + 1)
    for k in range(pad):
        own[begin + k] = False
    return out[own[pad:]], np.append(number[:-1] + rows, number[-1] + len(texts))


def _sorted_counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(values, return_inverse=True)
    return found, np.bincount(which, weights, len(found))


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted in the sorted keys, or -1."""
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return np.where(keys[place] == wanted, place, -1) if len(keys) else np.full(len(wanted), -1)


def kneser_ney(rows: list[np.ndarray], size: int) -> tuple[np.ndarray, list[tuple]]:
    """Unigram probabilities, and for orders 2..ORDER the grams with log probabilities and contexts with back-off weights.

    rows: each language's grams. size: symbols there are.
    """
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER + 1)]
    for row in rows:
        found, count = _sorted_counts(row)
        for k in range(ORDER, 0, -1):
            by_order[k].append((found, count.astype(float)))
            found, count = _sorted_counts(found & MASKS[k - 1])  # of how many longer grams each is the end
    below = np.zeros((size, len(rows)))
    levels: list[tuple] = []
    known = np.arange(size, dtype=np.uint64)
    for k in range(1, ORDER + 1):
        union = np.unique(np.concatenate([g for g, _ in by_order[k]])) if k > 1 else known
        contexts = np.unique(union >> SHIFT) if k > 1 else np.zeros(1, np.uint64)
        p, weight = np.zeros((len(union), len(rows))), np.ones((len(contexts), len(rows)))
        lower = below[_at(known, union & MASKS[k - 1])] if k > 1 else np.full((size, len(rows)), 1 / size)
        context = _at(contexts, union >> SHIFT)
        for i, (found, count) in enumerate(by_order[k]):
            once, twice = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            own = _at(contexts, found >> SHIFT)
            total, kinds = np.bincount(own, count, len(contexts)), np.bincount(own, minlength=len(contexts))
            has = total > 0
            weight[has, i] = discount * kinds[has] / total[has]
            p[_at(union, found), i] = np.maximum(count - discount, 0) / total[own]
        p += weight[context] * lower
        levels.append((union, p, contexts, weight))
        below, known = p, union
    return levels[0][1], levels[1:]


def learn(sample: pd.DataFrame) -> Models | None:
    """Models from rows of text and lang; a fifth of them is held back to set the bounds of rejection."""
    sample = sample[sample.text.str.len() > 0].sort_values(["doc_id", "text"], kind="stable")
    languages = sorted(sample.lang.unique())
    if not languages:
        return None
    symbols = alphabet(sample.text.tolist())
    texts, held = [], []
    for language in languages:
        own = sample.text[sample.lang == language].tolist()
        back = own[4::5]
        texts.append([t for i, t in enumerate(own) if i % 5 != 4])
        held.append(back or own)
    size = int(symbols.max()) + 1
    unigram, levels = kneser_ney([grams(t, symbols)[0] for t in texts], max(size, 2))
    pack = lambda keys, values: (k := HashedKeys(keys), np.vstack((np.log(values)[k.order], np.zeros(values.shape[1]))).astype(np.float32))
    models = Models(languages, symbols, np.log(unigram).astype(np.float32), [Level(*pack(g, p), *pack(c, w)) for g, p, c, w in levels], np.zeros(len(languages)), np.zeros(len(languages)))
    for i, back in enumerate(held):
        total, n = losses(back, models)
        entropy = total[:, i] / n
        models.mean[i] = np.average(entropy, weights=n)
        models.bound[i] = max(0.0, np.quantile((entropy - models.mean[i]) * np.sqrt(n), 1 - MISS)) * WIDER
    return models


def losses(texts: list[str], models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Each text's loss in each language, and its symbols."""
    found, starts = grams(texts, models.symbols)

    def log_p(keys: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            return models.unigram[(keys & MASKS[1]).astype(np.int64)]
        level = models.levels[k - 2]
        at = level.grams.find(keys)
        out = level.log_p[at]
        rest = np.flatnonzero(at < 0)
        if len(rest):
            out[rest] = level.log_weight[level.contexts.find(keys[rest] >> SHIFT)] + log_p(keys[rest] & MASKS[k - 1], k - 1)
        return out

    return -np.add.reduceat(log_p(found, ORDER), starts[:-1], axis=0, dtype=np.float64), np.diff(starts)


def judge(texts: list[str], models: Models | None) -> pd.DataFrame:
    """lang_pred, score, cross_entropy and accepted of each text."""
    out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": np.nan, "accepted": False}, index=range(len(texts)))
    if not texts or models is None:
        return out
    total, n = losses(texts, models)
    codes, starts = code_points(texts)
    letters = np.concatenate(([0], np.cumsum(classes()[codes] == LETTER)))
    known = letters[starts[1:]] > letters[starts[:-1]]
    best = total.argmin(axis=1)
    each = np.arange(len(texts))
    tempered = np.exp(-(total - total[each, best][:, None]) / 4)
    entropy = total[each, best] / n
    within = entropy - models.mean[best] <= SLACK + models.bound[best] / np.sqrt(n)
    out["lang_pred"] = np.where(known, np.array(models.languages, dtype=object)[best], UNKNOWN)
    out["score"] = np.where(known, 1 / tempered.sum(axis=1), 0.0)
    out["cross_entropy"] = np.where(known, entropy, np.nan)
    out["accepted"] = known & within
    return out


def fit(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Models | None:
    """Models learned from the labelled rows of docs (columns doc_id, text, lang): a sample of so many rows and characters."""
    spark = docs.sparkSession
    labelled = documents(docs, F.col("lang").cast("string").alias("lang")).where("lang is not null and text <> ''")
    stats = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).collect()  # a row for each language
    if not stats:
        return None
    share = spark.createDataFrame([(s["lang"], float(min(1.0, rows / s["rows"], chars / s["chars"]))) for s in stats], "of string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return learn(labelled.join(F.broadcast(share), F.col("lang") == F.col("of")).where(place < F.col("share")).select("doc_id", "text", "lang").toPandas())


def language(models: Models | None, spark) -> Column:
    """A column over text: struct of lang_pred, score, cross_entropy, accepted."""
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, accepted boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            done, begin, held = [], 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held > BATCH_CHARS:
                    done.append(judge(texts[begin : i + 1], shared.value))
                    begin, held = i + 1, 0
            done.append(judge(texts[begin:], shared.value))
            yield pd.concat(done, ignore_index=True)

    return run(F.col("text").cast("string"))


def identify(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """docs with a column `language` (replaced if there): learned from the rows that learn_from selects."""
    tune(docs.sparkSession)
    models = fit(docs if learn_from is None else docs.where(learn_from))
    return docs.withColumn("language", language(models, docs.sparkSession))
