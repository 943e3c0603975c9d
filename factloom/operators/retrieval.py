"""Batch retrieval: many queries against many memories, as plans over postings, vectors and ranked lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, text

#: Fixed values of the ranking: field weights, channel weights and constants.
FIELD_WEIGHTS = {"title": 5.0, "content": 2.5, "subject": 1.0, "memory_key": 2.0, "category": 1.0}
CHANNEL_WEIGHTS = {"fts": 1.0, "vector": 1.0, "source_anchor": 1.0, "graph": 0.82, "temporal": 0.9}
RRF_K = 60
SCOPE_WEIGHTS = {"task": 1.0, "branch": 0.92, "repository": 0.84, "workspace": 0.72, "user": 0.62}
SCOPE_FACTORS = {"task": 1.0, "branch": 0.96, "repository": 0.9, "workspace": 0.78, "user": 0.7}
FRESHNESS_FACTORS = {"fresh": 1.0, "unknown": 0.86, "suspect": 0.35, "stale": 0.0}
MMR_LAMBDA = 0.78
QUERY_TOKENS = 24
#: Intents by the first group of words that a query holds.
INTENTS = [
    ("historical_as_of", "temporal_keyword", ["as of", "historical", "当时", "历史"]),
    ("why_decision", "why_keyword", ["why", "reason", "because", "为什么", "原因"]),
    ("constraint_lookup", "constraint_keyword", ["do not", "must not", "constraint", "禁止", "不得", "约束"]),
    ("failure_history", "failure_keyword", ["failed", "failure", "mistake", "失败", "踩坑"]),
    ("implementation_location", "implementation_keyword", ["implemented", "where", "located", "symbol", "实现在哪"]),
    ("preference", "preference_keyword", ["prefer", "preference", "偏好"]),
    ("current_decision", "current_decision_keyword", ["current", "decision", "choose", "architecture", "当前", "决定", "架构"]),
    ("task_state", "task_state_keyword", ["task", "working", "branch", "任务", "分支"]),
]
#: Words that ask for a time, and words that ask for a relation.
TEMPORAL = r"(?i)(?:as of|at the time|before|after|historical|history|timeline|when did|当时|截至|之前|之后|历史|时间线|何时)"
RELATIONAL = r"(?i)(?:depends? on|dependency|relationship|related to|calls?|imports?|impact|affected by|依赖|关系|调用|引用|影响|关联)"


def choose(column: str, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for key, value in values.items():
        out = F.when(F.col(column) == key, F.lit(value)).otherwise(out)
    return out


# --- planning --------------------------------------------------------------------------------------------------------


def planned(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with intent, reason, evidence kind, signals, clauses and the recommended recipe."""
    low, raw = F.lower(F.col(column)), F.trim(F.col(column))
    intent, reason = F.lit("broad_search"), F.lit("unclassified")
    for name, code, words in reversed(INTENTS):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        intent, reason = F.when(hit, F.lit(name)).otherwise(intent), F.when(hit, F.lit(code)).otherwise(reason)
    out = queries.withColumn("intent", intent).withColumn("reason", reason).withColumn("exact", text.exact_terms(F.col(column)))
    evidence = F.when(F.col("intent") == "implementation_location", "source_anchor").when(F.col("intent") == "why_decision", "provenance").when(F.col("intent") == "historical_as_of", "temporal").otherwise("claim")
    marks = F.length(F.regexp_replace(raw, "[^?？]", ""))
    breaks = F.length(F.regexp_replace(raw, "[^;；\n]", "")) + 1
    out = (
        out.withColumn("evidence", evidence)
        .withColumn("has_exact", (F.size("exact") > 0) | (F.col("intent") == "implementation_location"))
        .withColumn("has_temporal", (F.col("intent") == "historical_as_of") | F.regexp_like(raw, F.lit(TEMPORAL)))
        .withColumn("has_relational", (F.col("intent") == "why_decision") | F.regexp_like(raw, F.lit(RELATIONAL)))
        .withColumn("clauses", F.greatest(F.lit(1), marks, breaks))
    )
    signals = sum((F.col(c).cast("int") for c in ("has_temporal", "has_relational")), F.col("has_exact").cast("int"))
    recipe = (
        F.when((F.col("intent") == "broad_search") & (signals == 0), "safe-hybrid-v1")
        .when((F.col("clauses") > 1) | (signals > 1), "complex-hybrid-v1")
        .when(F.col("has_temporal"), "temporal-as-of-v1")
        .when(F.col("has_exact"), "exact-symbol-v1")
        .when(F.col("has_relational"), "relational-graph-v1")
        .otherwise("semantic-hybrid-v1")
    )
    return out.withColumn("recipe", recipe)


# --- lexical channel -------------------------------------------------------------------------------------------------


def _fields(weights: dict[str, float]) -> list[Column]:
    return [text.terms(F.coalesce(F.col(f), F.lit(""))) for f in weights]


def postings(documents: DataFrame, key: str = "memory_id", weights: dict[str, float] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """(key, term, weighted frequency, document length): the index, built once and kept; or only its rows of the asked terms.

    Other terms go before the shuffle, so that a batch of queries moves its own terms only.
    """
    weights = weights or FIELD_WEIGHTS
    split = documents.select(key, F.array(*_fields(weights)).alias("fields"))
    length = F.aggregate("fields", F.lit(0), lambda s, f: s + F.size(f))
    weighted = F.arrays_zip(F.array(*[F.lit(w) for w in weights.values()]).alias("weight"), F.col("fields").alias("terms"))
    each = split.select(key, length.alias("length"), F.inline(weighted).alias("weight", "terms")).select(key, "length", "weight", F.explode("terms").alias("term"))
    if asked is not None:
        each = each.join(asked.select("term").distinct(), "term", "left_semi")
    return each.groupBy(key, "term").agg(F.sum("weight").alias("tf"), F.first("length").alias("length"))


def collection(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: documents and their average length."""
    length = sum((text.term_count(F.coalesce(F.col(f), F.lit(""))) for f in weights or FIELD_WEIGHTS), F.lit(0))
    return documents.agg(F.count("*").alias("n"), (F.sum(length) / F.count("*")).alias("average"))


def query_terms(queries: DataFrame, most: int = QUERY_TOKENS) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(F.slice(text.terms(F.col("query")), 1, most))).alias("term"))


def bm25(index: DataFrame, whole: DataFrame, asked: DataFrame, key: str = "memory_id", df: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, matched): OR over the query's terms; the plan joins terms, never documents with queries.

    whole: the row of `collection`. df: term, df, where they are kept; else they are counted. Inverse document frequency is at
    least 1e-6.
    """
    if df is None:
        df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    stats = df.join(F.broadcast(whole)).select("term", idf.alias("idf"), "average")  # one row
    part = F.col("idf") * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("average")))
    return asked.join(stats, "term").join(index, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


def relaxed(scored: DataFrame, asked: DataFrame, needed: int) -> DataFrame:
    """Rows that match all of a query's terms; for queries with fewer than `needed` such rows, all its rows."""
    wanted = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    marked = scored.join(wanted, "query_id").withColumn("strict", F.col("matched") == F.col("terms"))
    enough = marked.groupBy("query_id").agg((F.count_if("strict") >= needed).alias("enough"))
    return marked.join(enough, "query_id").where("strict or not enough").drop("terms", "enough")


# --- vector channel --------------------------------------------------------------------------------------------------


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """The vector in double at length one; null where its norm is zero."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def cosine(left: Column, right: Column) -> Column:
    """In double; null where a norm is zero or sizes differ."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    return F.when((F.size(left) == F.size(right)) & (norms > 0), dot(left, right) / norms)


#: Rows of a block that meet the queries in one matrix product.
PRODUCT_ROWS = 4096


def cosine_top(vectors: DataFrame, asked: DataFrame, k: int, key: str = "memory_id", blocks: int | None = None) -> DataFrame:
    """(query_id, key, score): the k best by cosine, mapped to 0..1. Vectors of another size than a query's are not its rows.

    A stated query set meets all vectors block by block: the queries are copied to each block of vectors, which gives the k
    best of each by matrix products. Scores are rounded to twelve places before they are compared.
    """
    blocks = blocks or int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = asked.select("query_id", unit(F.col("embedding")).alias("asked")).where("asked is not null").select("query_id", "asked", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = vectors.select(F.col(key).alias("key"), unit(F.col("embedding")).alias("vector"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block")).where("vector is not null")

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "key": [], "score": []}).astype({"query_id": "int64", "key": "int64"})]
        for size, own in queries.groupby(queries.asked.map(len)):
            fit = rows[rows.vector.map(len) == size].sort_values("key")
            if not len(fit):
                continue
            ids, names = fit.key.to_numpy(), own.query_id.to_numpy()
            parts = [np.stack(own.asked.to_numpy()) @ np.stack(fit.vector.iloc[i : i + PRODUCT_ROWS].to_numpy()).T for i in range(0, len(fit), PRODUCT_ROWS)]
            scores = np.round((np.concatenate(parts, axis=1) + 1) / 2, 12)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ties go to the smaller key
            found.append(pd.DataFrame({"query_id": np.repeat(names, best.shape[1]), "key": ids[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(found, ignore_index=True)

    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(run, "query_id long, key long, score double").withColumnRenamed("key", key)
    return best(scored, k, key).select("query_id", key, "score")


# --- ranked lists ----------------------------------------------------------------------------------------------------


def best(scored: DataFrame, k: int, key: str = "memory_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, key: str = "memory_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (query_id, key, rank): score, and each channel's rank."""
    weights = weights or CHANNEL_WEIGHTS
    every = None
    for name, ranked in channels.items():
        part = ranked.select("query_id", key, F.col("rank").cast("int").alias("rank"), F.lit(name).alias("channel"), F.lit(float(weights.get(name, 1.0))).alias("weight"))
        every = part if every is None else every.unionByName(part)
    ranks = [F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    return every.groupBy("query_id", key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), *ranks)


def normalised(fused: DataFrame, channels: list[str], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Fused scores as a share of the best that a query's non-empty channels allow, within 0..1."""
    weights = weights or CHANNEL_WEIGHTS
    window = Window.partitionBy("query_id")
    most = sum((F.when(F.max(F.col(f"{c}_rank").isNotNull()).over(window), F.lit(weights.get(c, 1.0) / (k + 1))).otherwise(F.lit(0.0)) for c in channels), F.lit(0.0))
    return fused.withColumn("normalised", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("score", most))))


def ordered_distinct(rows: DataFrame, order: str, key: str = "memory_id") -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy("query_id", key).agg(F.min(order).alias(order))


def merged(lists: list[DataFrame], key: str = "memory_id") -> DataFrame:
    """Union of scored lists; the greater score counts."""
    out = lists[0].select("query_id", key, "score")
    for more in lists[1:]:
        out = out.unionByName(more.select("query_id", key, "score"))
    return out.groupBy("query_id", key).agg(F.max("score").alias("score"))


def channel_status(counts: DataFrame, requested: Column, applicable: Column, available: Column, fell_back: Column) -> DataFrame:
    """counts (a row a query and channel, with `eligible` rows found) with the status of the channel's execution.

    not_requested, not_applicable (nothing in the query for it), unavailable, provider_fallback, executed_empty or executed.
    """
    status = (
        F.when(~requested, "not_requested").when(~applicable, "not_applicable").when(~available, "unavailable").when(fell_back, "provider_fallback").when(F.col("eligible") == 0, "executed_empty").otherwise("executed")
    )
    return counts.withColumn("status", status)


# --- scores ----------------------------------------------------------------------------------------------------------


def blended(found: DataFrame, at: Column) -> DataFrame:
    """The base score of lexical, semantic, scope, importance, recency and confidence; missing lexical and semantic are 0."""
    recency = F.exp(-intervals.age_days(F.col("created_at"), at) / 90)
    score = F.coalesce("lexical", F.lit(0.0)) * 0.32 + F.coalesce("semantic", F.lit(0.0)) * 0.22 + choose("scope_type", SCOPE_WEIGHTS, 0.5) * 0.18 + F.col("importance") * 0.12 + recency * 0.08 + F.col("confidence") * 0.08
    return found.withColumn("score", score)


def freshness_of(claims: DataFrame) -> DataFrame:
    """Per memory: freshness (worst first: stale, suspect, fresh, unknown) and truth state."""
    has = lambda column, value: F.bool_or(F.col(column) == value)
    freshness = F.when(has("stale_state", "stale"), "stale").when(has("stale_state", "suspect"), "suspect").when(has("stale_state", "fresh"), "fresh").otherwise("unknown")
    truth = F.when(has("status", "contested"), "contested").when(has("status", "stale") | has("stale_state", "stale"), "stale").when(has("status", "accepted"), "resolved").otherwise("unknown")
    return claims.groupBy("memory_id").agg(freshness.alias("freshness"), truth.alias("truth_state"))


def feedback_factor(feedback: DataFrame) -> DataFrame:
    """Per memory: votes, and a factor that helpful votes raise by 0.2 and unhelpful ones lower by 0.35 at most."""
    counted = feedback.groupBy("memory_id").agg(F.count_if(F.col("verdict") == "yes").alias("helpful"), F.count_if(F.col("verdict") == "no").alias("unhelpful"))
    delta = F.least(F.lit(0.2), 0.03 * F.col("helpful")) - F.least(F.lit(0.35), 0.06 * F.col("unhelpful"))
    return counted.withColumn("feedback_factor", F.greatest(F.lit(0.5), 1.0 + delta))


def evidence_counts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return claims.select("claim_id", "memory_id").join(evidence.select("claim_id"), "claim_id").groupBy("memory_id").agg(F.count("*").alias("evidence_count"))


def governed(fused: DataFrame, memories: DataFrame, claims: DataFrame, feedback: DataFrame, with_history: bool = False) -> DataFrame:
    """Fused scores times freshness, feedback and scope factors; stale memories go unless history is asked for."""
    out = fused.join(memories, "memory_id").join(freshness_of(claims), "memory_id", "left").join(feedback_factor(feedback), "memory_id", "left")
    out = out.withColumns({"freshness": F.coalesce("freshness", F.lit("unknown")), "truth_state": F.coalesce("truth_state", F.lit("unknown")), "feedback_factor": F.coalesce("feedback_factor", F.lit(1.0))})
    if not with_history:
        out = out.where("freshness <> 'stale'")
    factor = choose("freshness", FRESHNESS_FACTORS, 1.0) * F.col("feedback_factor") * choose("scope_type", SCOPE_FACTORS, 0.6)
    return out.withColumn("factor", factor).withColumn("final_score", F.col("score") * F.col("factor"))


#: What a shadow profile weighs.
FEATURES = (
    "fts_reciprocal_rank", "vector_reciprocal_rank", "graph_reciprocal_rank", "temporal_reciprocal_rank", "freshness_fresh", "freshness_suspect", "scope_task", "scope_branch", "scope_repository", "scope_workspace",
    "scope_user", "truth_resolved", "truth_contested", "evidence_log1p", "helpful_feedback_log1p", "unhelpful_feedback_log1p", "memory_confidence", "memory_importance", "reranker_score",
)


def shadow_features(rows: DataFrame) -> DataFrame:
    """rows with the features of a shadow profile as columns. rows: *_rank, freshness, truth_state, scope_type, evidence_count,
    helpful, unhelpful, confidence, importance, reranker_score.

    A rank, count or reranker's score that is missing is 0. Stale rows, unknown freshness, ranks below 1, negative counts, shares
    outside 0 to 1 and scores that are not finite are errors.
    """
    refused = lambda wrong, value, said: F.when(wrong, F.raise_error(F.lit(said)).cast("double")).otherwise(value)
    rank = lambda c: refused(F.col(c) < 1, F.coalesce(1 / F.col(c), F.lit(0.0)), f"{c} must be a positive integer")
    counted = lambda c: refused(F.col(c) < 0, F.log1p(F.coalesce(c, F.lit(0)).cast("double")), f"{c} must not be negative")
    share = lambda c: refused(~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.col(c), f"{c} must be within 0 and 1")
    is_ = lambda c, value: F.coalesce(F.col(c) == value, F.lit(False)).cast("double")
    own = F.col("reranker_score")
    fresh = refused(~F.coalesce(F.col("freshness").isin("fresh", "unknown", "suspect"), F.lit(False)), is_("freshness", "fresh"), "stale rows have no features")
    values = [
        *[rank(f"{c}_rank") for c in ("fts", "vector", "graph", "temporal")], fresh, is_("freshness", "suspect"), *[is_("scope_type", c) for c in ("task", "branch", "repository", "workspace", "user")],
        is_("truth_state", "resolved"), is_("truth_state", "contested"), counted("evidence_count"), counted("helpful"), counted("unhelpful"), share("confidence"), share("importance"),
        refused(F.isnan(own) | (F.abs(own) == float("inf")), F.coalesce(own, F.lit(0.0)), "reranker_score must be finite"),
    ]
    return rows.withColumns(dict(zip(FEATURES, values, strict=True)))


def logistic_score(features: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """A shadow profile's score; a stale row is an error."""
    z = sum((F.col(c) * w for c, w in weights.items()), F.lit(bias))
    return features.withColumn("shadow_score", F.when(F.col("freshness") == "stale", F.raise_error(F.lit("stale rows have no features")).cast("double")).otherwise(1 / (1 + F.exp(-z))))


def reranked(candidates: DataFrame, reranker: Column, pool: int = 40) -> DataFrame:
    """0.7 of the fused and 0.3 of the reranker's score for each query's first rows; all of a query's scores must be within 0..1."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "memory_id")))
    ranked = ranked.withColumn("reranker_score", F.when(F.col("rank") <= pool, reranker))
    fine = F.min(F.when(F.col("rank") <= pool, F.coalesce(F.col("reranker_score").between(0, 1), F.lit(False))).otherwise(F.lit(True))).over(Window.partitionBy("query_id"))
    return ranked.withColumn("final_score", F.when(fine & (F.col("rank") <= pool), 0.7 * F.col("final_score") + 0.3 * F.col("reranker_score")).otherwise(F.col("final_score")))


def rerouted(candidates: DataFrame, reranker: Column, pool: int = 40) -> DataFrame:
    """candidates with rank and final_score of a routed reranker, whose score times the factors replaces that of each query's first
    `pool` rows; the rest follow in their order. A query whose first rows don't all have a score within 0..1 stays as it was.
    """
    fused = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "memory_id")
    ranked = candidates.withColumn("rank", F.row_number().over(fused)).withColumn("reranker_score", F.when(F.col("rank") <= pool, reranker))
    first = F.col("rank") <= pool
    fine = F.min(F.when(first, F.coalesce(F.col("reranker_score").between(0, 1), F.lit(False))).otherwise(F.lit(True))).over(Window.partitionBy("query_id"))
    scored = ranked.withColumn("routed", fine).withColumn("final_score", F.when(F.col("routed") & first, F.round(F.col("reranker_score") * F.col("factor"), 9)).otherwise(F.col("final_score")))
    behind = (F.col("routed") & ~first).cast("int")
    moved = F.when(F.col("routed") & first, -F.col("final_score")).otherwise(F.col("rank").cast("double"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(behind, moved, "rank")))


def diversified(candidates: DataFrame, limit: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance: (query_id, position, memory_id, mmr_score). candidates: query_id, memory_id, final_score, tokens."""

    def select(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["final_score", "memory_id"], ascending=[False, True])
        ids, scores = frame.memory_id.tolist(), frame.final_score.tolist()
        sets = [frozenset(t) for t in frame.tokens]
        overlap, left, out = [0.0] * len(ids), list(range(len(ids))), []
        while left and len(out) < limit:
            value = [weight * scores[i] - (1 - weight) * overlap[i] for i in left]
            chosen = left.pop(value.index(best_value := max(value)))
            out.append((frame.query_id.iloc[0], len(out) + 1, ids[chosen], best_value))
            for i in left:
                union = len(sets[i] | sets[chosen])
                overlap[i] = max(overlap[i], len(sets[i] & sets[chosen]) / union if union else 0.0)
        return pd.DataFrame(out, columns=["query_id", "position", "memory_id", "mmr_score"])

    return candidates.select("query_id", "memory_id", "final_score", "tokens").groupBy("query_id").applyInPandas(select, "query_id long, position int, memory_id long, mmr_score double")


def redundancy(selected: DataFrame, least: float = 0.8) -> DataFrame:
    """Share of a query's selected pairs whose tokens overlap by at least so much. selected: query_id, memory_id, tokens."""
    left, right = (selected.select("query_id", F.col("memory_id").alias(f"{s}_id"), F.col("tokens").alias(f"{s}_tokens")) for s in ("left", "right"))
    pairs = left.join(right, "query_id").where("left_id < right_id").withColumn("near", text.jaccard(F.col("left_tokens"), F.col("right_tokens")) >= least)
    return pairs.groupBy("query_id").agg(F.count("*").alias("pairs"), F.count_if("near").alias("near_pairs"), F.avg(F.col("near").cast("double")).alias("redundancy"))


# --- visibility ------------------------------------------------------------------------------------------------------


def visible(memories: DataFrame, health: DataFrame, at: Column, known: Column | None = None, scopes: list[tuple[str, str | None]] | None = None, history: bool = False) -> DataFrame:
    """Memories that a search may return at a moment: active and not archived (unless history), valid, alive, known, in scope."""
    rows = memories.where(intervals.holds_at(F.col("valid_from"), F.col("valid_to"), at) & intervals.lives(F.col("created_at"), F.col("ttl_seconds"), at))
    if known is not None:
        rows = rows.where(intervals.known_at(F.col("created_at"), known))
    if scopes is not None:
        allowed = F.lit(False)
        for kind, key in scopes:
            allowed = allowed | ((F.col("scope_type") == kind) & (F.lit(True) if key is None else F.col("scope_key") == key))
        rows = rows.where(allowed)
    if not history:
        rows = rows.where("status = 'active'").join(health.where("temperature = 'archived'").select("memory_id"), "memory_id", "left_anti")
    return rows
