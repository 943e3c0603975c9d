"""Queries of the retrieval core."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, text
from factloom.operators import claims as truth
from factloom.operators import context, retrieval
from factloom.plans.registry import query
from factloom.plans.texts import IN_SIGNS, in_signs
from factloom.sources import postings
from factloom.sources.model import Store
from factloom.sources.shared import kept_path


def at():
    return intervals.moment("2024-06-01 00:00:00")


AT = "timestamp '2024-06-01'"
#: Rows that the channels of words and vectors give at least, and that any channel gives at most.
POOL_LEAST, POOL_MOST = 80, 1000
#: Rows that a context is made of.
CONTEXT_ROWS = 80


def pool(limit: int, offset: int = 0) -> int:
    """Rows that the channels of words and vectors give for a page of so many."""
    return min(POOL_MOST, max(POOL_LEAST, offset + limit))


#: Memories that a search may return.
ELIGIBLE = f"""elig as (select memory_id from memories where status = 'active' and (valid_from is null or valid_from <= {AT}) and (valid_to is null or {AT} < valid_to) and (ttl_seconds is null or {AT} < created_at + to_seconds(ttl_seconds))
    and memory_id not in (select memory_id from health where temperature = 'archived'))"""
FOLD = f"translate(lower({{0}}), '{text.ACCENTED}', '{text.PLAIN}')"
TERMS = "regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}]+')"
#: DuckDB text of the lexical channel, scored rows of all queries.
BM25 = f"""{ELIGIBLE}, fields as (select memory_id, unnest([5.0, 2.5, 1.0, 2.0, 1.0])::double as weight, unnest([{', '.join(TERMS.format(f"coalesce({c}, '')") for c in retrieval.FIELD_WEIGHTS)}]) as terms from memories),
    lengths as (select memory_id, sum(len(terms)) as length from fields group by memory_id), words as (select memory_id, weight, unnest(terms) as term from fields),
    postings as (select memory_id, term, sum(weight) as tf from words group by memory_id, term), q as (select distinct query_id, unnest(list_slice({TERMS.format('query')}, 1, 24)) as term from asks),
    df as (select term, count(*) as df from postings group by term), n as (select (select count(*) from memories) as n, (select sum(length) from lengths) as total),
    bm25 as (select query_id, p.memory_id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n)))) as score, count(*) as matched
        from q join df using (term) join postings p using (term) join lengths l on l.memory_id = p.memory_id cross join n group by query_id, p.memory_id),
    fts as (select query_id, memory_id, score, row_number() over (partition by query_id order by round(score, 9) desc, memory_id) as rank from bm25 join elig using (memory_id))"""
COSINE = """cosines as (select a.query_id, b.memory_id, (list_cosine_similarity(a.embedding::double[], b.embedding::double[]) + 1) / 2 as score from (select query_id, embedding from asks join vectors on memory_id = query_id) a, vectors b),
    vec as (select query_id, memory_id, score, row_number() over (partition by query_id order by round(score, 9) desc, memory_id) as rank from cosines join elig using (memory_id))"""


def scored(t: Store) -> DataFrame:
    """From the kept index: its postings, frequencies and lengths of the asked terms."""
    asked = retrieval.query_terms(t.asks)
    index, df, whole = postings.kept(t.memories, kept_path(t.spark, "postings", t.sf_dir)).asked(asked)
    return retrieval.bm25(index, whole, asked, df=df).withColumn("exact", F.col("score")).withColumn("score", F.round("score", 9))


def eligible(t: Store) -> DataFrame:
    return retrieval.visible(t.memories, t.health, at()).select("memory_id")


def lexical(t: Store, k: int) -> DataFrame:
    return retrieval.best(scored(t).join(eligible(t), "memory_id", "left_semi"), k)


def semantic(t: Store, k: int, only: DataFrame | None = None) -> DataFrame:
    asked = t.asks.join(t.vectors.select(F.col("memory_id").alias("query_id"), "embedding"), "query_id")
    vectors = t.vectors.join(only, "memory_id", "left_semi") if only is not None else t.vectors
    rows = retrieval.cosine_top(vectors, asked, k).withColumn("score", F.round("score", 9))
    return retrieval.best(rows, k)


def recent_claims(t: Store, k: int) -> DataFrame:
    """The temporal channel: newest claims' memories, the same list for every query that asks for the past."""
    newest = t.claims.where("status in ('accepted', 'superseded')").join(eligible(t), "memory_id", "left_semi").groupBy("memory_id").agg(F.max("recorded_at").alias("recorded_at"))
    ranked = newest.orderBy(F.desc("recorded_at"), "memory_id").limit(k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("recorded_at"), "memory_id")))  # at most k rows
    asked = retrieval.planned(t.asks).where("intent = 'historical_as_of'").select("query_id")
    return asked.join(F.broadcast(ranked.select("memory_id", "rank")))


def source_anchors(t: Store, k: int) -> DataFrame:
    """Memories whose evidence lies in code that a query names."""
    wanted = t.asks.select("query_id", F.explode(text.exact_terms(F.col("query"))).alias("term"))
    claims = t.claims.join(eligible(t), "memory_id", "left_semi")
    return truth.anchor_matches(claims, t.claim_evidence, t.anchors, wanted, k)


def graph(t: Store, k: int) -> DataFrame:
    """Memories with claims about entities that a query names, and those one relation away."""
    words = t.asks.select("query_id", F.explode(text.entity_words(F.col("query"))).alias("word"))
    claims = t.claims.where("status in ('accepted', 'contested')").join(eligible(t), "memory_id", "left_semi")
    return truth.graph_channel(claims, t.entities, t.relations_of, words, k)


INTENT = f"case {' '.join(f"when {' or '.join(f"contains(lower(query), '{w}')" for w in words)} then '{name}'" for name, _, words in retrieval.INTENTS)} else 'broad_search' end"
TEMPORAL = f"temporal as (select query_id, memory_id, rank from (select query_id from asks where {INTENT} = 'historical_as_of'), (select memory_id, row_number() over (order by recorded_at desc, memory_id) as rank from (select memory_id, max(recorded_at) as recorded_at from claims join elig using (memory_id) where status in ('accepted', 'superseded') group by memory_id)) where rank <= 1000)"
ANCHORED = """named as (select distinct query_id, term, regexp_extract(term, '([^/]*)$', 1) as tail from (select query_id, unnest(list_concat(regexp_extract_all(query, '`([^`]+)`', 1), regexp_extract_all(query, '[a-z_]+[.]py'))) as term from asks)),
    places as (select anchor_id, lower(path) as path, lower(symbol_fqn) as symbol, regexp_extract(lower(path), '([^/]*)$', 1) as base, regexp_extract(lower(symbol_fqn), '([^.]*)$', 1) as final from anchors),
    hits as (select query_id, anchor_id, path, symbol, max((term in (symbol, final))::int * 16 + (term in (path, base))::int * 8 + contains(symbol, term)::int * 4 + contains(path, term)::int * 2 + (tail in (final, base))::int) as m from places, named group by query_id, anchor_id, path, symbol),
    code as (select *, row_number() over (partition by query_id, memory_id order by m desc, path, symbol) as n from (select query_id, c.memory_id, path, symbol, m from hits join claim_evidence e using (anchor_id) join claims c using (claim_id) join elig on elig.memory_id = c.memory_id where m > 0)),
    anchored as (select * from (select query_id, memory_id, row_number() over (partition by query_id order by m desc, path, symbol, memory_id) as rank from code where n = 1) where rank <= 1000)"""
GRAPH = """topic_words as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_.+#/-]+'))) as word from asks), usable as (select c.* from claims c join elig using (memory_id) where status in ('accepted', 'contested')),
    topics as (select query_id, entity_id, max(case when normalized_name = word then 2 else 1 end) as priority from topic_words join entities on normalized_name = word or entity_type = word group by query_id, entity_id),
    seeds as (select * from (select *, row_number() over (partition by query_id order by priority desc, recorded_at desc, claim_id) as rank from (select query_id, u.memory_id, claim_id, recorded_at, priority, row_number() over (partition by query_id, u.memory_id order by priority desc, recorded_at desc, claim_id) as n from usable u join topics on entity_id = subject_entity_id) where n = 1) where rank <= 1000),
    hops as (select query_id, u.memory_id, min(u.claim_id) as claim_id from (select query_id, to_id as claim_id from seeds join claim_relations on from_id = claim_id union select query_id, from_id from seeds join claim_relations on to_id = claim_id) h join usable u using (claim_id) where not exists (select 1 from seeds s where s.query_id = h.query_id and s.memory_id = u.memory_id) group by query_id, u.memory_id),
    graph as (select query_id, memory_id, rank from seeds union all select * from (select query_id, memory_id, (select count(*) from seeds s where s.query_id = hops.query_id) + row_number() over (partition by query_id order by claim_id) as rank from hops) where rank <= 1000)"""
CHANNELS = ["fts", "vector", "source_anchor", "graph", "temporal"]
FUSED = f"""{TEMPORAL}, {ANCHORED}, {GRAPH}, every as (select query_id, memory_id, 'fts' as channel, rank, 1.0::double as weight from fts where rank <= 80 union all select query_id, memory_id, 'vector', rank, 1.0 from vec where rank <= 80 union all select query_id, memory_id, 'source_anchor', rank, 1.0 from anchored
    union all select query_id, memory_id, 'graph', rank, 0.82 from graph union all select query_id, memory_id, 'temporal', rank, 0.9 from temporal),
    fused as (select query_id, memory_id, sum(weight / (60 + rank)) as score, {', '.join(f"min(case when channel = '{c}' then rank end) as {c}_rank" for c in CHANNELS)} from every group by query_id, memory_id)"""


def channels(t: Store, limit: int = 10) -> dict[str, DataFrame]:
    """The ranked lists that a page of so many rows is fused from."""
    own = pool(limit)
    return {"fts": lexical(t, own), "vector": semantic(t, own, eligible(t)), "source_anchor": source_anchors(t, POOL_MOST), "graph": graph(t, POOL_MOST), "temporal": recent_claims(t, POOL_MOST)}


def fused(t: Store) -> DataFrame:
    return retrieval.fuse(channels(t))


@query("R1_query_plan", f"""select query_id, case {' '.join(f"when {' or '.join(f"contains(lower(query), '{w}')" for w in words)} then '{name}'" for name, _, words in retrieval.INTENTS)} else 'broad_search' end as intent,
    greatest(1, length(regexp_replace(trim(query), '[^?？]', '', 'g')), length(regexp_replace(trim(query), '[^;；\n]', '', 'g')) + 1) as clauses from asks""")
def r1(t: Store) -> DataFrame:
    return retrieval.planned(t.asks).select("query_id", "intent", F.col("clauses").cast("long").alias("clauses"))


ROUTES = f"""routed as (select query_id, intent, exact, {"{0}"} as clauses, exact > 0 or intent = 'implementation_location' as has_exact, intent = 'historical_as_of' or regexp_matches(trim(query), '{retrieval.TEMPORAL}') as has_temporal, intent = 'why_decision' or regexp_matches(trim(query), '{retrieval.RELATIONAL}') as has_relational
    from (select *, {INTENT} as intent, len(list_concat(regexp_extract_all(query, '`([^`]+)`', 1), regexp_extract_all(query, '[a-z_]+[.]py'))) as exact from asks))""".replace("{0}", "greatest(1, length(regexp_replace(trim(query), '[^?？]', '', 'g')), length(regexp_replace(trim(query), '[^;；\n]', '', 'g')) + 1)")


@query("R2_recipe_router", f"""with {ROUTES}, signalled as (select *, has_exact::int + has_temporal::int + has_relational::int as signals from routed)
    select query_id, case when intent = 'broad_search' and signals = 0 then 'safe-hybrid-v1' when clauses > 1 or signals > 1 then 'complex-hybrid-v1' when has_temporal then 'temporal-as-of-v1' when has_exact then 'exact-symbol-v1' when has_relational then 'relational-graph-v1' else 'semantic-hybrid-v1' end as recipe from signalled""")
def r2(t: Store) -> DataFrame:
    return retrieval.planned(t.asks).select("query_id", "recipe")


@query("R3_bm25", f"with {BM25} select query_id, memory_id, round(score, 6) as score, rank from fts where rank <= 10")
def r3(t: Store) -> DataFrame:
    return lexical(t, 10).select("query_id", "memory_id", F.round("exact", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("K2_strict_then_relaxed", f"with {BM25}, wanted as (select query_id, count(*) as terms from q group by query_id), marked as (select b.query_id, b.memory_id, matched = terms as strict from bm25 b join wanted using (query_id)), enough as (select query_id, count(*) filter (strict) >= 3 as enough from marked group by query_id) select query_id, count(*) as rows from marked join enough using (query_id) where strict or not enough group by query_id")
def k2(t: Store) -> DataFrame:
    return retrieval.relaxed(scored(t), retrieval.query_terms(t.asks), 3).groupBy("query_id").agg(F.count("*").alias("rows"))


@query("R4_cjk_similarity", f"""with signs as (select memory_id, list_filter(list_transform(regexp_extract_all({IN_SIGNS}, '[㐀-䶿一-鿿豈-﫿]+'), lambda r: list_distinct(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), lambda g: len(g) > 0) as grams from memories)
    select a.memory_id, round(coalesce(list_max(flatten(list_transform(a.grams, lambda x: list_transform(b.grams, lambda y: 2.0::double * len(list_intersect(x, y)) / (len(x) + len(y)))))), 0), 6) as score from signs a join signs b on b.memory_id = a.memory_id + 1""")
def r4(t: Store) -> DataFrame:
    """The best overlap of signs of each memory's title with the next one's."""
    own = t.memories.select("memory_id", in_signs().alias("signs"))
    after = own.select((F.col("memory_id") - 1).alias("memory_id"), F.col("signs").alias("others"))
    return own.join(after, "memory_id").select("memory_id", F.round(text.cjk_similarity(F.col("signs"), F.col("others")), 6).alias("score"))


@query("R5_cosine_top", f"with {ELIGIBLE}, {COSINE} select query_id, memory_id, round(score, 6) as score, rank from vec where rank <= 5")
def r5(t: Store) -> DataFrame:
    return semantic(t, 5, eligible(t)).select("query_id", "memory_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SCOPES = "case scope_type when 'task' then 1.0 when 'branch' then 0.92 when 'repository' then 0.84 when 'workspace' then 0.72 when 'user' then 0.62 else 0.5 end::double"


@query("R7_blended_score", f"select memory_id, round(0.35 * 0.32 + {SCOPES} * 0.18 + importance * 0.12 + exp(-greatest(0, epoch_us(timestamp '2024-06-01') - epoch_us(created_at)) / 86400000000.0::double / 90) * 0.08 + confidence * 0.08, 6) as score from memories")
def r7(t: Store) -> DataFrame:
    return retrieval.blended(t.memories.withColumns({"lexical": F.lit(0.35), "semantic": F.lit(None).cast("double")}), at()).select("memory_id", F.round("score", 6).alias("score"))


@query("R8_source_anchor_channel", f"with {ELIGIBLE}, {ANCHORED} select query_id, memory_id, rank from anchored")
def r8(t: Store) -> DataFrame:
    return source_anchors(t, POOL_MOST).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("R9_graph_channel", f"with {ELIGIBLE}, {GRAPH} select query_id, memory_id, rank from graph")
def r9(t: Store) -> DataFrame:
    return graph(t, POOL_MOST)


@query("R9b_temporal_channel", f"with {ELIGIBLE}, {TEMPORAL} select query_id, memory_id, rank from temporal")
def r9b(t: Store) -> DataFrame:
    return recent_claims(t, POOL_MOST).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query("R10_weighted_rrf", f"with {BM25}, {COSINE}, {FUSED} select query_id, memory_id, round(score, 6) as score, fts_rank, vector_rank, source_anchor_rank, graph_rank, temporal_rank from fused")
def r10(t: Store) -> DataFrame:
    return fused(t).select("query_id", "memory_id", F.round("score", 6).alias("score"), *[F.col(f"{c}_rank").cast("long").alias(f"{c}_rank") for c in CHANNELS])


@query("R11_normalised_rrf", f"with {BM25}, {COSINE}, {FUSED} select query_id, memory_id, round(least(1, score / ({' + '.join(f'max(case when {c}_rank is not null then {retrieval.CHANNEL_WEIGHTS[c]}::double / 61 else 0 end) over w' for c in CHANNELS)})), 6) as normalised from fused window w as (partition by query_id)")
def r11(t: Store) -> DataFrame:
    return retrieval.normalised(fused(t), CHANNELS).select("query_id", "memory_id", F.round("normalised", 6).alias("normalised"))


GOVERNED = f"""fresh as (select memory_id, case when bool_or(stale_state = 'stale') then 'stale' when bool_or(stale_state = 'suspect') then 'suspect' when bool_or(stale_state = 'fresh') then 'fresh' else 'unknown' end as freshness from claims group by memory_id),
    votes as (select memory_id, greatest(0.5, 1 + least(0.2, 0.03 * count(*) filter (verdict = 'yes')) - least(0.35, 0.06 * count(*) filter (verdict = 'no'))) as factor from feedback group by memory_id),
    governed as (select query_id, f.memory_id, coalesce(freshness, 'unknown') as freshness, f.score * case coalesce(freshness, 'unknown') when 'fresh' then 1.0 when 'unknown' then 0.86 when 'suspect' then 0.35 else 0 end * coalesce(factor, 1)
        * case scope_type when 'task' then 1.0 when 'branch' then 0.96 when 'repository' then 0.9 when 'workspace' then 0.78 when 'user' then 0.7 else 0.6 end as final_score from fused f join memories m on m.memory_id = f.memory_id left join fresh on fresh.memory_id = f.memory_id left join votes on votes.memory_id = f.memory_id where coalesce(freshness, 'unknown') <> 'stale')"""


def governed(t: Store) -> DataFrame:
    return retrieval.governed(fused(t), t.memories, t.claims, t.feedback)


@query("R12_hybrid_search", f"with {BM25}, {COSINE}, {FUSED}, {GOVERNED} select query_id, memory_id, freshness, round(final_score, 6) as final_score, rank from (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, memory_id) as rank from governed) where rank <= 10")
def r12(t: Store) -> DataFrame:
    rows = governed(t).withColumn("score", F.round("final_score", 9))
    return retrieval.best(rows, 10).select("query_id", "memory_id", "freshness", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("long").alias("rank"))


#: A profile of the shadow score, and the features as SQL.
PROFILE = {name: round(0.15 * (i % 6) - 0.25, 2) for i, name in enumerate(retrieval.FEATURES)}
FEATURE_SQL = [
    *[f"coalesce(1.0::double / {c}_rank, 0)" for c in ("fts", "vector", "graph", "temporal")], "(freshness = 'fresh')::int", "(freshness = 'suspect')::int", *[f"(scope_type = '{c}')::int" for c in ("task", "branch", "repository", "workspace", "user")],
    "(truth = 'resolved')::int", "(truth = 'contested')::int", "ln(1 + coalesce(evidence, 0))", "ln(1 + coalesce(helpful, 0))", "ln(1 + coalesce(unhelpful, 0))", "confidence", "importance", "coalesce(rr, 0)",
]
#: Stands in for a reranker: the share of a query's words that a memory's title has.
WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}\\p{{M}}_.]+'))"
SHARE = f"len(list_intersect({WORDS.format('query')}, {WORDS.format('title')})) / greatest(1, len({WORDS.format('query')}))::double"
JUDGED = f"""placed as (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, memory_id) as rank from governed),
    states as (select memory_id, case when bool_or(status = 'contested') then 'contested' when bool_or(status = 'stale' or stale_state = 'stale') then 'stale' when bool_or(status = 'accepted') then 'resolved' else 'unknown' end as truth from claims group by memory_id),
    counted as (select memory_id, count(*) filter (verdict = 'yes') as helpful, count(*) filter (verdict = 'no') as unhelpful from feedback group by memory_id), shown as (select memory_id, count(*) as evidence from claims join claim_evidence using (claim_id) group by memory_id),
    seen as (select p.query_id, p.memory_id, p.freshness, p.final_score, p.rank, f.score, {', '.join(f'{c}_rank' for c in CHANNELS)}, m.scope_type, m.confidence, m.importance, truth, helpful, unhelpful, evidence, case when p.rank <= 40 then {SHARE} end as rr
    from placed p join fused f on f.query_id = p.query_id and f.memory_id = p.memory_id join memories m on m.memory_id = p.memory_id join asks a on a.query_id = p.query_id left join states s on s.memory_id = p.memory_id left join counted c on c.memory_id = p.memory_id left join shown e on e.memory_id = p.memory_id)"""


def judged_by_title(t: Store) -> DataFrame:
    """Governed rows with the words' share that stands in for a reranker."""
    words = lambda c: F.array_distinct(text.tokens(F.col(c)))
    asked = t.asks.select("query_id", words("query").alias("asked"))
    rows = governed(t).withColumn("final_score", F.round("final_score", 9)).join(asked, "query_id")
    return rows.withColumn("share", F.size(F.array_intersect("asked", words("title"))) / F.greatest(F.lit(1), F.size("asked"))).drop("asked")


@query("R13_shadow_score", f"with {BM25}, {COSINE}, {FUSED}, {GOVERNED}, {JUDGED} select query_id, memory_id, round(1 / (1 + exp(-(-0.4 + {' + '.join(f'{w} * ({x})' for w, x in zip(PROFILE.values(), FEATURE_SQL, strict=True))}))), 6) as shadow_score from seen")
def r13(t: Store) -> DataFrame:
    placed = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "memory_id")
    rows = judged_by_title(t).withColumn("reranker_score", F.when(F.row_number().over(placed) <= 40, F.col("share")))
    rows = rows.join(retrieval.evidence_counts(t.claims, t.claim_evidence), "memory_id", "left")
    return retrieval.logistic_score(retrieval.shadow_features(rows), PROFILE, -0.4).select("query_id", "memory_id", F.round("shadow_score", 6).alias("shadow_score"))


@query("R14_rerank", f"with {BM25}, {COSINE}, {FUSED}, {GOVERNED}, {JUDGED} select query_id, memory_id, round(case when rank <= 40 then 0.7 * round(final_score, 9) + 0.3 * rr else round(final_score, 9) end, 6) as final_score from seen")
def r14(t: Store) -> DataFrame:
    return retrieval.reranked(judged_by_title(t), F.col("share")).select("query_id", "memory_id", F.round("final_score", 6).alias("final_score"))


@query("R14_routed_rerank", f"""with {BM25}, {COSINE}, {FUSED}, {GOVERNED}, {JUDGED}, given as (select *, case when query_id % 10 = 3 and memory_id % 7 = 0 then null else rr end as own from seen), whole as (select *, bool_and(rank > 40 or coalesce(own between 0 and 1, false)) over (partition by query_id) as fine from given),
    scored as (select *, case when fine and rank <= 40 then round(own * (final_score / score), 9) else round(final_score, 9) end as new_score from whole)
    select query_id, memory_id, round(new_score, 6) as final_score, row_number() over (partition by query_id order by case when fine and rank > 40 then 1 else 0 end, case when fine and rank <= 40 then -new_score else rank end, rank) as rank from scored""")
def r14_routed(t: Store) -> DataFrame:
    """A reranker that leaves out a row of some queries is not followed in those."""
    given = F.when((F.col("query_id") % 10 == 3) & (F.col("memory_id") % 7 == 0), None).otherwise(F.col("share"))
    return retrieval.rerouted(judged_by_title(t), given).select("query_id", "memory_id", F.round("final_score", 6).alias("final_score"), F.col("rank").cast("long").alias("rank"))


@query("R16_channel_telemetry", f"""with {BM25}, {COSINE}, {FUSED}, slots as (select query_id, query, channel from asks, (select unnest({CHANNELS}) as channel)), found as (select query_id, channel, count(*) as eligible from every group by query_id, channel)
    select s.query_id, s.channel, coalesce(eligible, 0) as eligible, case when s.query_id % 10 = 0 and s.channel not in ('fts', 'vector') then 'not_requested' when s.channel = 'source_anchor' and s.query_id not in (select query_id from named) or s.channel = 'graph' and s.query_id not in (select query_id from topics) or s.channel = 'temporal' and {INTENT} <> 'historical_as_of' then 'not_applicable'
    when s.channel = 'vector' and s.query_id not in (select memory_id from vectors) then 'unavailable' when s.channel = 'vector' and s.query_id % 7 = 0 then 'provider_fallback' when coalesce(eligible, 0) = 0 then 'executed_empty' else 'executed' end as status
    from slots s left join found f on f.query_id = s.query_id and f.channel = s.channel""")
def r16(t: Store) -> DataFrame:
    found = None
    for name, rows in channels(t).items():
        part = rows.groupBy("query_id").agg(F.count("*").alias("eligible")).withColumn("channel", F.lit(name))
        found = part if found is None else found.unionByName(part)
    topics = t.asks.select("query_id", F.explode(text.entity_words(F.col("query"))).alias("word"))
    names = t.entities.select(F.explode(F.array("normalized_name", "entity_type")).alias("word")).distinct()
    slots = retrieval.planned(t.asks).select("query_id", (F.size("exact") > 0).alias("named"), (F.col("intent") == "historical_as_of").alias("historical"), F.explode(F.array(*map(F.lit, CHANNELS))).alias("channel"))
    slots = slots.join(topics.join(names, "word", "left_semi").select("query_id").distinct().withColumn("topical", F.lit(True)), "query_id", "left")
    slots = slots.join(t.vectors.select(F.col("memory_id").alias("query_id"), F.lit(True).alias("embedded")), "query_id", "left")
    counts = slots.join(found, ["query_id", "channel"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    is_ = lambda name: F.col("channel") == name
    applicable = F.when(is_("source_anchor"), F.col("named")).when(is_("graph"), F.coalesce("topical", F.lit(False))).when(is_("temporal"), F.col("historical")).otherwise(True)
    out = retrieval.channel_status(counts, (F.col("query_id") % 10 != 0) | F.col("channel").isin("fts", "vector"), applicable, ~is_("vector") | F.coalesce("embedded", F.lit(False)), is_("vector") & (F.col("query_id") % 7 == 0))
    return out.select("query_id", "channel", "eligible", "status")


@query("R17_retrieval_counts", f"with {BM25} select memory_id, count(*) as retrieved from fts where rank <= 10 group by memory_id")
def r17(t: Store) -> DataFrame:
    run = lexical(t, 10).groupBy("query_id").agg(F.collect_list("memory_id").alias("selected"))
    return run.select(F.explode("selected").alias("memory_id")).groupBy("memory_id").agg(F.count("*").alias("retrieved"))


@query("R19_flat_baseline", "select query_id, memory_id, round(share, 6) as share from (select a.query_id, m.memory_id, share, row_number() over (partition by a.query_id order by share desc, importance desc, m.memory_id) as n from (select query_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}\\p{M}_.]+')) as w from asks) a, (select memory_id, importance, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}\\p{M}_.]+')) as d from memories) m, lateral (select len(list_intersect(w, d)) / len(w) as share)) where n <= 5 and share > 0")
def r19(t: Store) -> DataFrame:
    asked = t.asks.select("query_id", F.array_distinct(text.tokens(F.col("query"))).alias("words")).withColumn("size", F.size("words"))
    own = t.memories.select("memory_id", "importance", F.explode(F.array_distinct(text.tokens(F.col("title")))).alias("word"))
    shared = asked.select("query_id", "size", F.explode("words").alias("word")).join(own, "word").groupBy("query_id", "memory_id", "importance").agg((F.count("*") / F.max("size")).alias("share"))
    return shared.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("share"), F.desc("importance"), "memory_id"))).where("n <= 5").select("query_id", "memory_id", F.round("share", 6).alias("share"))


def candidates(t: Store) -> DataFrame:
    best = retrieval.best(governed(t).withColumn("score", F.round("final_score", 9)), CONTEXT_ROWS)
    counts = retrieval.evidence_counts(t.claims, t.claim_evidence)
    rows = best.join(counts, "memory_id", "left").withColumns({"evidence_count": F.coalesce("evidence_count", F.lit(0)), "source_ref": F.col("subject"), "final_score": F.round("final_score", 9)})
    return context.prepared(rows)


@query("X1_utility_and_cost", f"""with {BM25}, {COSINE}, {FUSED}, {GOVERNED}, placed as (select *, row_number() over (partition by query_id order by round(final_score, 9) desc, memory_id) as rank from governed),
    ev as (select memory_id, count(*) as n from claims join claim_evidence using (claim_id) group by memory_id)
    select query_id, p.memory_id, round(greatest(round(final_score, 9), 1e-6) * confidence * (1 + 0.05 * least(coalesce(n, 0), 3)) * case freshness when 'fresh' then 1.0 when 'unknown' then 0.82 when 'suspect' then 0.3 else 0 end, 6) as utility from placed p join memories m on m.memory_id = p.memory_id left join ev on ev.memory_id = p.memory_id where rank <= 80""")
def x1(t: Store) -> DataFrame:
    return candidates(t).select("query_id", "memory_id", F.round("utility", 6).alias("utility"))


@query("X7_exact_dedup", """with atoms as (select memory_id, subject, importance, sha256('{"category":"' || category || '","fact":"' || trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) || '","scope":"' || scope_key || '","valid_from":"' || coalesce(strftime(valid_from, '%Y-%m-%d %H:%M:%S'), '') || '"}') as content_key from memories)
    select content_key, arg_max(memory_id, (importance, -memory_id)) as memory_id, string_agg(distinct subject, ',' order by subject) as sources, count(*) as merged from atoms group by content_key""")
def x7(t: Store) -> DataFrame:
    """Atoms that say the same of the same scope, category and time are one: that of most importance, with the sources of all."""
    fact = F.concat(
        F.lit('{"category":"'), F.col("category"), F.lit('","fact":"'), text.semantic_key(F.col("content")), F.lit('","scope":"'), F.col("scope_key"),
        F.lit('","valid_from":"'), F.coalesce(F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit('"}'),
    )
    atoms = t.memories.select(F.sha2(fact, 256).alias("content_key"), "memory_id", F.col("importance").alias("score"), F.col("subject").alias("source_ref"))
    return context.deduplicated(atoms, ["content_key"]).select("content_key", "memory_id", "sources", "merged")


@query("X10_token_estimate", "select memory_id, cast(ceil(octet_length(encode(content)) / 4.0) as bigint) as tokens from memories")
def x10(t: Store) -> DataFrame:
    return t.memories.select("memory_id", text.token_estimate(F.col("content")).cast("long").alias("tokens"))


@query("X12_snapshot_validity", "select memory_id, case when created_at + to_days(30) <= timestamp '2024-06-01' then 'expired' when scope_type <> 'task' then 'scope_changed' when scope_key <> 'en' then 'tokenizer_changed' end as fallback_reason from memories")
def x12(t: Store) -> DataFrame:
    rows = t.memories.select("memory_id", (F.col("created_at") + F.make_dt_interval(F.lit(30))).alias("expires_at"), F.col("scope_type").alias("scope"), F.col("scope_key").alias("tokenizer"), F.lit("p").alias("policy"))
    return context.snapshot_state(rows, at(), "task", "en", "p").select("memory_id", "fallback_reason")


@query("R15_mmr")
def r15(t: Store) -> DataFrame:
    """Contents are read, cut into words and hashed once for each memory that any query found."""
    rows = governed(t).select("query_id", "memory_id", "final_score")
    found = t.memories.join(rows.select("memory_id").distinct(), "memory_id", "left_semi")
    words = F.array_distinct(F.transform(text.tokens(F.concat_ws(" ", "title", "content")), lambda w: F.xxhash64(w)))
    return retrieval.diversified(rows.join(found.select("memory_id", words.alias("tokens")), "memory_id"), 8).withColumn("mmr_score", F.round("mmr_score", 6))


@query("M17_redundancy", f"with {BM25}, picked as (select query_id, f.memory_id, list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}\\p{{M}}_.]+')) as w from fts f join memories m on m.memory_id = f.memory_id where rank <= 10), pairs as (select a.query_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.8 as near from picked a join picked b on a.query_id = b.query_id and a.memory_id < b.memory_id) select query_id, count(*) as pairs, count(*) filter (near) as near_pairs, round(avg(near::int), 6) as redundancy from pairs group by query_id")
def m17(t: Store) -> DataFrame:
    rows = lexical(t, 10).join(t.memories.select("memory_id", "content"), "memory_id").withColumn("tokens", F.array_distinct(text.tokens(F.col("content"))))
    return retrieval.redundancy(rows).withColumn("redundancy", F.round("redundancy", 6))
