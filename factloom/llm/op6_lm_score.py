"""Language-model scoring by cross-entropy difference.

Two matched character models of ORDER symbols score every document: one of a target domain, one of the whole corpus. Both have
the same vocabulary (every code point is a symbol of its own, with one more for the start of a text), order and smoothing, and
are learned from all their documents. A document's score is its mean loss under the target minus that under the background for
each token: the lower, the nearer to the target.

Documents are dealt to blocks of about BLOCK code points. Each block counts its grams; the counts are added up, made into
losses and joined with the grams of each block in Spark, and each block's documents meet the losses of their own grams only.
So the model grows with the corpus, and neither a task nor the driver holds it whole.

Defined results: null and empty texts have no token and null losses and score; repeated rows and null ids are counted and
scored each; without target documents the target model is uniform; an empty table gives an empty result; other columns are
ignored. Grams of one block are told apart by 64-bit digests. Rows of
one id share a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import HashedKeys, code_points, documents, mixed, parts, stored, sums, tune

ORDER, SYMBOLS = 4, 0x110000
#: Symbols that are no code point: the text start.
FIXED = 1
#: Strength of each order's belief in the next shorter one, in counts.
BELIEF = 4.0
#: Code points of the documents that are counted and scored together.
BLOCK = 8_000_000
#: Bits of a symbol: ORDER - 1 symbols make a context, which is one long.
BITS = 21


def table_of(vocabulary: list[int] | None = None) -> np.ndarray:
    """The symbol of each code point: one of its own, whichever are listed."""
    return np.arange(FIXED, FIXED + SYMBOLS, dtype=np.int64)


def digests(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """64-bit digests of grams."""
    return mixed(mixed(context.view(np.uint64)) + symbol.view(np.uint64))


def grams(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context and symbol of each token, and where each text's begin; texts start with ORDER - 1 starts."""
    codes, starts = code_points([t.lower() for t in texts])
    pad, size = ORDER - 1, np.diff(starts)
    own = np.arange(len(codes)) + np.repeat((np.arange(len(texts)) + 1) * pad, size)
    row = np.zeros(len(codes) + pad * len(texts), np.int64)
    row[own] = symbols[codes]
    context = np.zeros(len(codes), np.int64)
    for k in range(pad, 0, -1):
        context = context << BITS | row[own - k]
    return context, row[own], starts


def _added(found: list[pd.DataFrame]) -> pd.DataFrame:
    """Counts of distinct grams: context, symbol, n, m."""
    whole = pd.concat(found, ignore_index=True)
    _, first, which = np.unique(digests(whole.context.to_numpy(), whole.symbol.to_numpy()), return_index=True, return_inverse=True)
    total = {c: np.bincount(which, whole[c].to_numpy(), len(first)).astype(np.int64) for c in ("n", "m")}
    return whole[["context", "symbol"]].iloc[first].assign(**total)


def _pieces(docs: DataFrame, member: DataFrame) -> DataFrame:
    """block, context, symbol, n (in all the block's documents) and m (in those of the target).

    docs: block, doc_id, known (it has an id), text; member: block, doc_id.
    """

    def run(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "context", "symbol", "n", "m"]
        symbols, near = table_of(), rows.known.to_numpy(bool) & rows.doc_id.isin(chosen.doc_id).to_numpy()
        found = [pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})]
        for frame, target in ((rows[~near], 0), (rows[near], 1)):
            for part in parts([frame[["text"]]]):
                context, symbol, _ = grams(part.text.tolist(), symbols)
                _, first, n = np.unique(digests(context, symbol), return_index=True, return_counts=True)
                found.append(pd.DataFrame({"context": context[first], "symbol": symbol[first], "n": n, "m": n * target}))
        return _added(found).assign(block=rows.block.iloc[0] if len(rows) else 0)[columns]

    return docs.groupBy("block").cogroup(member.groupBy("block")).applyInPandas(run, "block long, context long, symbol long, n long, m long")


def losses(counts: DataFrame) -> DataFrame:
    """context, symbol, near and far: the losses of each gram under target and background. counts: context, symbol, n, m.

    Every order is interpolated with the next shorter one, the first with the uniform distribution over all symbols.
    """
    shorter = lambda k: F.col("context").bitwiseAND(F.lit((1 << BITS * k) - 1))
    levels = [counts]
    for k in range(ORDER - 2, -1, -1):
        levels.append(levels[-1].groupBy(shorter(k).alias("context"), "symbol").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    uniform = F.lit(1.0 / (FIXED + SYMBOLS))
    likely = lambda n, total, lower: (F.col(n) + BELIEF * lower) / (F.col(total) + BELIEF)
    whole = levels[-1].agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))  # one row
    p = levels[-1].crossJoin(F.broadcast(whole)).select("context", "symbol", likely("m", "all_m", uniform).alias("near"), likely("n", "all_n", uniform).alias("far"))
    for k in range(1, ORDER):
        level = levels[ORDER - 1 - k]
        total = level.groupBy("context").agg(F.sum("n").alias("all_n"), F.sum("m").alias("all_m"))
        lower = p.select(F.col("context").alias("lower"), "symbol", F.col("near").alias("near_lower"), F.col("far").alias("far_lower"))
        # Always sort-merge joins: all sides grow with the corpus.
        own = level.join(total.hint("merge"), "context").withColumn("lower", shorter(k - 1)).join(lower.hint("merge"), ["lower", "symbol"])
        p = own.select("context", "symbol", likely("m", "all_m", F.col("near_lower")).alias("near"), likely("n", "all_n", F.col("far_lower")).alias("far"))
    return p.select("context", "symbol", (-F.log("near")).alias("near"), (-F.log("far")).alias("far"))


def _scored(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss and background_loss. docs as in _pieces; model: block, context, symbol, near, far."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        keys = HashedKeys(digests(found.context.to_numpy(np.int64), found.symbol.to_numpy(np.int64)))
        near, far = (found[c].to_numpy(np.float64)[keys.order] for c in ("near", "far"))
        symbols, done = table_of(), []
        for part in parts([rows]):
            context, symbol, starts = grams(part.text.tolist(), symbols)
            at, n = keys.find(digests(context, symbol)), np.diff(starts)
            mean = [np.where(n > 0, sums(t[at], starts) / np.maximum(n, 1), np.nan) for t in (near, far)]
            done.append(pd.DataFrame({"doc_id": part.doc_id, "known": part.known, "n_tokens": n, "target_loss": mean[0], "background_loss": mean[1]}))
        return pd.concat(done, ignore_index=True) if done else pd.DataFrame({c: [] for c in ("doc_id", "known", "n_tokens", "target_loss", "background_loss")})

    out = docs.groupBy("block").cogroup(model.groupBy("block")).applyInPandas(run, "doc_id long, known boolean, n_tokens long, target_loss double, background_loss double")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "n_tokens", "target_loss", "background_loss")


def difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document; target: the doc_id of the target domain's."""
    spark = docs.sparkSession
    tune(spark)
    # Rows without an id are dealt out by their place; a null would make pandas' ids floats.
    rows = documents(docs).withColumns({"known": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.monotonically_increasing_id())})
    rows = stored(rows, "texts")
    chars = rows.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    block = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-chars // BLOCK)))).alias("block")
    dealt = rows.select(block, "doc_id", "known", "text")
    member = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select(block, "doc_id")
    pieces = stored(_pieces(dealt, member), "grams")
    counts = stored(pieces.groupBy("context", "symbol").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "counts")
    model = pieces.select("block", "context", "symbol").join(losses(counts).hint("merge"), ["context", "symbol"])
    return _scored(dealt, model).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def against_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The target domain: documents labelled good and not toxic."""
    return difference(docs, labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id"))
