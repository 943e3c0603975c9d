"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of its neighbours; forward-backward gives each line's
marginal, and the marginals weighted by length give the document's quality, which a logistic curve calibrates.

A score is a function of its text alone. Only documents are labelled. Lines first take their document's label; the field is trained, lines of bad documents that it
finds good become good (the worst line stays bad), and it is trained again. Learning uses at most ROWS labelled rows of each
label; scoring covers all rows.

Defined results: a null text counts as empty; a text without a line scores the calibrated value of having none (the share of
good rows); repeated rows and null ids are scored each; without labelled rows of both kinds every score is the share of good
rows, or 0.5 without any; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BATCH_CHARS, code_points, documents, parts, sums, tune
from factloom.llm.pretokens import LETTER, NUMBER, SPACE, classes

#: Bound of the sample that the field is learned from: rows of each label. Their texts are used whole.
ROWS = 1500
#: Features of a line itself; lines of a chain that are worked off one after another.
OWN, SEGMENT = 13, 64
#: Steps of training in each round, between which lines are labelled anew, and the penalty on weights.
STEPS, PENALTY = (150, 150, 150), 1e-3
GOOD = 1
#: Code points' worth of belief in the share of good rows that every document starts with, so that a few characters decide nothing.
PRIOR = 12


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of features for good minus bad
    moves: np.ndarray  # [from, to], log
    curve: tuple[float, float]
    share: float


_upper: list[np.ndarray] = []


def _capitals() -> np.ndarray:
    if not _upper:
        letters = np.flatnonzero(classes() == LETTER)
        out = np.zeros(0x110000, bool)
        out[letters] = [chr(c).isupper() for c in letters.tolist()]
        _upper.append(out)
    return _upper[0]


def lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """OWN features of all non-empty lines, their lengths, and where each text's lines begin (with the end as last entry).

    A text's features don't depend on the texts beside it.
    """
    codes, starts = code_points(texts)
    n = len(codes)
    cut = codes == 10
    first = np.zeros(n, bool)
    first[1:] = cut[:-1]
    first[starts[:-1][np.diff(starts) > 0]] = True
    begin = np.flatnonzero(first & ~cut)
    if not len(begin):
        return np.zeros((0, OWN)), np.zeros(0), np.zeros(len(texts) + 1, np.int64)
    stops = np.flatnonzero(cut)
    following = np.concatenate((stops, [n]))[np.searchsorted(stops, begin)]
    end = np.minimum(following, starts[np.searchsorted(starts, begin, side="right")])
    kind = classes()[codes]
    count = lambda mask: (total := np.concatenate(([0], np.cumsum(mask))))[end] - total[begin]
    inner = kind != SPACE
    word = inner.copy()
    word[1:] &= ~inner[:-1] | first[1:]
    length = (end - begin).astype(float)
    chars, words = np.maximum(count(inner), 1), np.maximum(count(word), 1)
    letters = count(kind == LETTER)
    marks = (kind != LETTER) & (kind != NUMBER) & inner
    plain = np.isin(codes, [ord(c) for c in ".,;:?'\"-()"])
    odd = marks & ~plain
    pair = odd.copy()
    pair[1:] &= (codes[1:] == codes[:-1]) & odd[:-1]
    pair[starts[:-1][np.diff(starts) > 0]] = False
    # words that come right after an equal-length word with equal first letters, as in text that repeats itself
    at = np.flatnonzero(word)
    text = np.searchsorted(starts, at, side="right") - 1
    close = starts[text + 1]
    size = np.minimum(np.append(at[1:], n), close) - at
    short = np.zeros(n, bool)
    short[at[size <= 4]] = True
    second = np.where(at + 1 < close, codes[np.minimum(at + 1, n - 1)], 0).astype(np.int64)
    code = codes[at].astype(np.int64) * 1_000_003 + second * 1009 + size
    again = np.zeros(n, bool)
    for back in (1, 2, 4, 8):
        again[at[back:][(code[back:] == code[:-back]) & (text[back:] == text[:-back])]] = True
    bare = odd & word  # marks that stand alone between spaces
    later = np.append(inner[1:], False)
    later[starts[1:][np.diff(starts) > 0] - 1] = False
    bare &= ~later
    own = np.stack([
        np.log1p(length),
        count(_capitals()[codes]) / np.maximum(letters, 1),
        count(marks) / chars,
        count(odd) / chars,
        count(pair) / chars,
        count(kind == NUMBER) / chars,
        letters / chars,
        np.log(chars / words),
        count(short) / words,
        count(again) / words,
        count(bare) / words,
        np.isin(codes[np.maximum(end - 1, 0)], [ord(c) for c in ".!?"]).astype(float),
        count(plain) / chars,
    ], axis=1)
    own[:, 1:] = np.minimum(own[:, 1:], 4)
    return own, length, np.searchsorted(begin, starts)


def with_neighbours(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before it and those of the line after it (zero beyond the text)."""
    document = np.repeat(np.arange(len(at) - 1), np.diff(at))
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = document[1:] == document[:-1]
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    return np.concatenate((own, before, after), axis=1)


def _run(unary: np.ndarray, moves: np.ndarray, begin: np.ndarray, size: np.ndarray, first: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    """Forward messages of segments side by side from the messages of their first lines; those of their last lines are returned.

    With out, messages are scaled to a maximum of zero and kept there.
    """
    order = np.argsort(-size, kind="stable")
    begin, size, now = begin[order], size[order], first[order]
    last = np.zeros_like(now)
    alive = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 2), side="right")
    for t in range(len(alive) - 1):
        if t:
            now = now[: alive[t]]
            now = np.logaddexp(now[:, :1] + moves[0], now[:, 1:] + moves[1]) + unary[begin[: alive[t]] + t]
        if out is not None:
            now = now - now.max(axis=1, keepdims=True)
            out[begin[: alive[t]] + t] = now
        last[alive[t + 1] : alive[t]] = now[alive[t + 1] :]
    back = np.empty_like(last)
    back[order] = last
    return back


def _forward(unary: np.ndarray, moves: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scaled forward messages of all lines, of chains of any length.

    Chains are dealt in segments of SEGMENT lines: what each segment does to either state is worked out side by side, then the
    segments of a chain are put together, then all messages follow side by side.
    """
    n = np.diff(at)
    count = -(-n // SEGMENT)
    chain = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    begin = at[:-1][chain] + number * SEGMENT
    size = np.minimum(SEGMENT, at[1:][chain] - begin)
    start = unary[begin]
    if len(count) and count.max() > 1:
        inner = np.flatnonzero(number < count[chain] - 1)  # segments with another after them
        through = np.zeros((len(chain), 2, 2))
        for state in (0, 1):
            through[inner, state] = _run(unary, moves, begin[inner], size[inner], np.where(number[inner, None] == 0, start[inner], moves[state] + start[inner]), None)
        heads = np.cumsum(count) - count
        message = np.zeros((len(n), 2))
        for k in range(1, int(count.max())):
            own = np.flatnonzero(count > k)
            step = through[heads[own] + k - 1]
            message[own] = step[:, 0] if k == 1 else np.logaddexp(message[own, :1] + step[:, 0], message[own, 1:] + step[:, 1])
            message[own] -= message[own].max(axis=1, keepdims=True)
            start[heads[own] + k] += np.logaddexp(message[own, :1] + moves[0], message[own, 1:] + moves[1])
    out = np.zeros_like(unary)
    _run(unary, moves, begin, size, start, out)
    return out


def marginals(score: np.ndarray, moves: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's log odds of being good under the chain, and for all documents the expected moves [from, to].

    score: log potential of good against bad.
    """
    n = np.diff(at)
    unary = np.stack((np.zeros(len(score)), score), axis=1)
    forward = _forward(unary, moves, at)
    behind = _forward(np.ascontiguousarray(unary[::-1]), np.ascontiguousarray(moves.T), len(score) - at[::-1])[::-1]  # with the line's own potential
    both = forward + behind - unary
    expected = np.zeros((2, 2))
    inner = np.ones(len(score), bool)
    inner[at[1:][n > 0] - 1] = False
    here = np.flatnonzero(inner)
    if len(here):
        joint = forward[here][:, :, None] + moves + behind[here + 1][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return both[:, 1] - both[:, 0], expected


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _train(x: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, start: tuple | None, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of greatest conditional likelihood of these line labels (Adam over the whole sample)."""
    theta = np.zeros(x.shape[1] + 4) if start is None else np.concatenate((start[0], start[1].ravel()))
    inner = np.ones(len(label), bool)
    inner[at[1:][np.diff(at) > 0] - 1] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(label[here] * 2 + label[here + 1], minlength=4).astype(float)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight.sum()
    for step in range(1, steps + 1):
        odds, expected = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), at)
        slope = np.concatenate((x.T @ (weight * (label - _sigmoid(odds))) / scale, (seen - expected.ravel()) / max(1, len(here)))) - PENALTY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _quality(odds: np.ndarray, length: np.ndarray, at: np.ndarray, share: float) -> np.ndarray:
    """Length-weighted share of good lines, from the prior share on; NaN for documents without a line."""
    weight = sums(length, at)
    return np.where(weight > 0, (sums(_sigmoid(odds) * length, at) + PRIOR * share) / (weight + PRIOR), np.nan)


def learn(own: np.ndarray, length: np.ndarray, at: np.ndarray, y: np.ndarray, share: float | None = None) -> Field:
    """The field from the lines of labelled texts (as `lines` gives them) and the texts' labels; share: that of good rows among
    all labelled ones, if the sample's is another."""
    if not len(y) or y.min() == y.max():
        share = share if share is not None else float(y.mean()) if len(y) else 0.5
        return Field(np.zeros(3 * OWN), np.ones(3 * OWN), np.zeros(3 * OWN + 1), np.zeros((2, 2)), (0.0, 0.0), share)
    x = with_neighbours(own, at)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), axis=1)
    document = np.repeat(np.arange(len(y)), np.diff(at))
    label, found = y[document], None
    weight = np.sqrt(length / length.mean())
    for steps in STEPS:
        balance = np.where(label == GOOD, 0.5 / max(1, (weight * label).sum()), 0.5 / max(1, (weight * (1 - label)).sum())) * weight
        found = _train(x, at, label, balance * len(label), found, steps)
        odds, _ = marginals(x @ found[0], found[1], at)
        label = np.where(y[document] == GOOD, GOOD, (odds > 0).astype(int))
        bad = np.flatnonzero(y[document] != GOOD)
        for rows in np.split(bad, np.flatnonzero(np.diff(document[bad])) + 1):  # a bad document has a bad line
            if len(rows):
                label[rows[odds[rows].argmin()]] = 1 - GOOD
    share = float(y.mean()) if share is None else share
    value = _quality(odds, length, at, share)
    full = ~np.isnan(value)
    return Field(mean, scale, found[0], found[1], _calibrate(value[full], y[full]), share)


def _calibrate(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's steps."""
    x = np.stack((value, np.ones(len(value))), axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(2), x.T @ (y - p) - 0.05 * beta)
    return float(beta[0]), float(beta[1])


def score(texts: list[str], field: Field) -> np.ndarray:
    if field.curve == (0.0, 0.0) or not texts:
        return np.full(len(texts), field.share)
    own, length, at = lines(texts)
    # Summed row by row: a matrix product may round a row by where it lies.
    potential = ((with_neighbours(own, at) - field.mean) / field.scale * field.weights[:-1]).sum(axis=1) + field.weights[-1]
    odds, _ = marginals(potential, field.moves, at)
    value = _quality(odds, length, at, field.share)
    return np.where(np.isnan(value), field.share, _sigmoid(field.curve[0] * np.nan_to_num(value) + field.curve[1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Field:
    """The field learned from at most about so many rows of each label, one text of an id. labels: doc_id, quality."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    kinds = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, min(1.0, rows / max(1, kinds.get(1, 0)))).otherwise(min(1.0, rows / max(1, kinds.get(0, 0))))
    chosen = marked.where(place < share)  # about 2 * rows rows

    def run(frames):
        for frame in parts(frames):
            own, length, at = lines(frame.text.tolist())
            cut = at[1:-1]
            yield pd.DataFrame({"doc_id": frame.doc_id, "text_key": frame.text_key, "quality": frame.quality, "own": [o.tobytes() for o in np.split(own, cut)], "length": [x.tobytes() for x in np.split(length, cut)]})

    rows_ = documents(docs).withColumn("text_key", F.xxhash64("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text_key", "quality", "text")
    # One text of an id, so that what comes back is bounded by the ids.
    first = rows_.groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    rows_ = rows_.join(F.broadcast(first), ["doc_id", "text_key"]).dropDuplicates(["doc_id"])
    sample = rows_.mapInPandas(run, "doc_id long, text_key long, quality int, own binary, length binary").toPandas().sort_values(["doc_id", "text_key"], kind="stable")  # about 2 * rows rows
    length = np.frombuffer(b"".join(sample.length), np.float64)
    own = np.frombuffer(b"".join(sample.own), np.float64).reshape(len(length), OWN)
    at = np.concatenate(([0], np.cumsum([len(x) // 8 for x in sample.length]))).astype(np.int64)
    field = learn(own, length, at, sample.quality.to_numpy().astype(int), kinds.get(1, 0) / sum(kinds.values()) if kinds else None)
    if len(kinds) == 2:  # the sample is balanced; the score is for the rows as they are
        odds = np.log(kinds[1] / kinds[0]) - np.log(max(1, (sample.quality == 1).sum()) / max(1, (sample.quality == 0).sum()))
        field.curve = (field.curve[0], field.curve[1] + float(odds)) if field.curve != (0.0, 0.0) else field.curve
    return field


def quality(field: Field, spark) -> Column:
    """A column over text: the score."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.fillna("").tolist()
            done, begin, held = [], 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held > BATCH_CHARS:
                    done.append(score(texts[begin : i + 1], shared.value))
                    begin, held = i + 1, 0
            done.append(score(texts[begin:], shared.value))
            yield pd.Series(np.concatenate(done))

    return run(F.col("text").cast("string"))


def scored(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """docs with a column `quality_score` (replaced if there)."""
    tune(docs.sparkSession)
    field = fit(docs if learn_from is None else docs.where(learn_from), labels if learn_from is None else labels.where(learn_from))
    return docs.withColumn("quality_score", quality(field, docs.sparkSession))
