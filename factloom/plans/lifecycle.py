"""Queries of the life of claims and memories, and of what is learned and measured from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, plain, text
from factloom.operators import claims as truth
from factloom.operators import lifecycle
from factloom.plans import claims as claim_plans
from factloom.plans.registry import query, sql_of
from factloom.sources.model import Store

#: What the notes say besides their title, by memory_id % 6, and the claims of each: subject, predicate, object and confidence.
NOTES = ["We use Postgres here.", "Do not use Redis or npm!", "I prefer pnpm over yarn;", "Parser is implemented in src/app/parser now.", "The build failed because sqlite3 locked.", "Nothing of note"]
TITLE = "'T ' || trim(regexp_replace(title, '[^a-zA-Z ]', ' ', 'g')) || '. '"
NOTE_SQL = f"""notes as (select memory_id, category, subject, {TITLE} as head, [{', '.join(f"'{n}'" for n in NOTES)}][memory_id % 6 + 1] as said from memories),
    said as (select memory_id, category, subject, said, length(head) as start, rtrim(head || said) as whole from notes),
    shown as (select memory_id, unnest(case memory_id % 6 when 0 then [{{'s': 'project.production_database', 'p': 'uses', 'o': 'postgresql', 'c': 0.88}}]
        when 1 then [{{'s': 'project.dependencies.redis', 'p': 'forbidden', 'o': 'redis', 'c': 0.88}}, {{'s': 'project.dependencies.npm', 'p': 'forbidden', 'o': 'npm', 'c': 0.88}}]
        when 2 then [{{'s': 'project.package_manager', 'p': 'prefers', 'o': 'yarn', 'c': 0.88}}] when 3 then [{{'s': subject, 'p': 'implemented_in', 'o': 'src/app/parser', 'c': 0.82}}]
        when 4 then [{{'s': 'project.production_database', 'p': 'failed_because', 'o': said, 'c': 0.78}}]
        else [{{'s': subject, 'p': case category when 'decision' then 'uses' when 'constraint' then 'forbidden' when 'preference' then 'prefers' when 'failure' then 'failed_because' else 'states' end, 'o': whole, 'c': 0.65}}] end) as x,
        case when memory_id % 6 = 5 then 0 else start end as start, case when memory_id % 6 = 5 then length(whole) else start + length(said) end as stop from said),
    extracted as (select memory_id, x.s as subject, x.p as predicate, x.o as object, start, stop, x.c::double as confidence from shown)"""


def notes(t: Store) -> DataFrame:
    head = F.concat(F.lit("T "), F.trim(F.regexp_replace("title", "[^a-zA-Z ]", " ")), F.lit(". "))
    said = F.array(*map(F.lit, NOTES))[(F.col("memory_id") % 6).cast("int")]
    return t.memories.select("memory_id", "category", "subject", F.concat(head, said).alias("text"))


@query("C1_claim_extraction", f"with {NOTE_SQL} select memory_id, subject, predicate, object, cast(start as int) as start, cast(stop as int) as stop, confidence from extracted")
def c1(t: Store) -> DataFrame:
    return lifecycle.extracted(notes(t)).withColumnRenamed("end", "stop")


@query("D4_lazy_claims", f"with {NOTE_SQL} select memory_id, predicate, object, true as exact from extracted where memory_id not in (select memory_id from claims where status in ('accepted', 'contested') and stale_state <> 'stale')")
def d4(t: Store) -> DataFrame:
    """Claims are made for memories that have no live one, and each is checked against the text that it quotes."""
    live = t.claims.where("status in ('accepted', 'contested') and stale_state <> 'stale'").select("memory_id")
    texts = notes(t).join(live, "memory_id", "left_anti")
    rows = lifecycle.extracted(texts).join(texts.select("memory_id", F.trim("text").alias("source")), "memory_id")
    quote = F.substring(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))
    named = F.when(F.col("predicate").isin("uses", "forbidden", "prefers"), F.col("confidence") < 0.8).otherwise(F.contains(quote, F.col("object")))
    return rows.select("memory_id", "predicate", "object", (named | F.regexp_like(quote, F.lit(lifecycle.TECHNOLOGY))).alias("exact"))


EPISODES = """episodes as (select c.subject_entity_id, c.predicate, c.object_value, c.polarity, c.claim_id, c.memory_id, s.source_ref, e.captured_at from claims c join claim_evidence e using (claim_id) join sources s using (source_id) where c.status in ('accepted', 'contested') and c.stale_state <> 'stale'),
    counted as (select subject_entity_id, predicate, object_value, polarity, count(*) as n, min(claim_id) as first_claim from episodes group by all), placed as (select *, row_number() over (partition by subject_entity_id, predicate order by n desc, first_claim, object_value, polarity) as place, count(*) over (partition by subject_entity_id, predicate) as sides from counted),
    main as (select subject_entity_id, predicate, object_value, polarity, sides from placed where place = 1)"""


def episodes(t: Store) -> DataFrame:
    usable = t.claims.where("status in ('accepted', 'contested') and stale_state <> 'stale'").select("claim_id", "memory_id", "subject_entity_id", "predicate", "object_value", "polarity")
    return usable.join(t.claim_evidence.select("claim_id", "source_id", "captured_at"), "claim_id").join(t.sources.select("source_id", "source_ref"), "source_id")


@query("A12_cluster_labels", f"""with {EPISODES}, sourced as (select e.subject_entity_id, e.predicate, source_ref, min(captured_at) as captured_at from episodes e join main m on m.subject_entity_id = e.subject_entity_id and m.predicate = e.predicate and m.object_value = e.object_value and m.polarity = e.polarity group by all),
    spans as (select subject_entity_id, predicate, count(*) as sources, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 86400000000.0::double as days from sourced group by all)
    select subject_entity_id, predicate, case when sources < 3 or days < 7 then 'none' when sides > 1 then 'contested' else 'candidate' end as label from main join spans using (subject_entity_id, predicate)""")
def a12(t: Store) -> DataFrame:
    return truth.consolidated(t.claims, t.claim_evidence, t.sources).select("subject_entity_id", "predicate", "label")


PROPOSALS = """proposals as (select distinct e.subject_entity_id, e.predicate, 'for' as role, memory_id from episodes e join main m on m.subject_entity_id = e.subject_entity_id and m.predicate = e.predicate where (e.object_value = m.object_value and e.polarity = m.polarity) or e.subject_entity_id % 4 = 1
    union all select distinct subject_entity_id, predicate, 'against', case when subject_entity_id % 4 = 2 then -1 else memory_id end from episodes where subject_entity_id % 4 = 2 or (subject_entity_id % 4 = 3 and claim_id % 2 = 0))"""


@query("D11_grounding", f"""with {EPISODES}, {PROPOSALS}, named as (select subject_entity_id, predicate, memory_id, bool_or(role = 'for') as supports, bool_or(role = 'against') as counters from proposals group by all),
    ids as (select n.subject_entity_id, n.predicate, bool_or(k.memory_id is null) as strange, bool_or(supports and counters) as twice, bool_or(counters) as against from named n left join (select distinct subject_entity_id, predicate, memory_id from episodes) k on k.subject_entity_id = n.subject_entity_id and k.predicate = n.predicate and k.memory_id = n.memory_id group by all),
    support as (select e.*, m.object_value = e.object_value and m.polarity = e.polarity as fits from episodes e join named n on n.subject_entity_id = e.subject_entity_id and n.predicate = e.predicate and n.memory_id = e.memory_id and n.supports join main m on m.subject_entity_id = e.subject_entity_id and m.predicate = e.predicate),
    spans as (select subject_entity_id, predicate, count(*) as sources, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 86400000000.0::double as days from (select subject_entity_id, predicate, source_ref, min(captured_at) as captured_at from support group by all) group by all)
    select i.subject_entity_id, i.predicate, case when strange then 'foreign' when twice then 'overlap' when not coalesce(pure, false) then 'assertion' when sources < 3 or days < 7 then 'thin' when against or sides > 1 then 'contested' else 'candidate' end as verdict
    from ids i left join (select subject_entity_id, predicate, bool_and(fits) as pure from support group by all) p on p.subject_entity_id = i.subject_entity_id and p.predicate = i.predicate left join spans s on s.subject_entity_id = i.subject_entity_id and s.predicate = i.predicate left join main m on m.subject_entity_id = i.subject_entity_id and m.predicate = i.predicate""")
def d11(t: Store) -> DataFrame:
    """Proposals that name the dominant side, all sides, strangers or both sides, by subject."""
    rows = episodes(t)
    slot = ["subject_entity_id", "predicate"]
    main = truth.consolidated(t.claims, t.claim_evidence, t.sources).select(*slot, F.col("object_value").alias("main"), F.col("polarity").alias("side"))
    case = F.col("subject_entity_id") % 4
    given = rows.join(main, slot).where(((F.col("object_value") == F.col("main")) & (F.col("polarity") == F.col("side"))) | (case == 1)).select(*slot, F.lit("for").alias("role"), "memory_id")
    against = rows.where((case == 2) | ((case == 3) & (F.col("claim_id") % 2 == 0))).select(*slot, F.lit("against").alias("role"), F.when(case == 2, -1).otherwise(F.col("memory_id")).alias("memory_id"))
    return lifecycle.grounded(rows, given.union(against).distinct())


@query("C12_activation", """with own as (select *, row_number() over w as place, first_value(object_value) over w as newest from claims where status = 'accepted' window w as (partition by identity_id order by recorded_at desc, claim_id desc)), rivals as (select identity_id, claim_id from own where place > 1 and object_value <> newest),
    touched as (select identity_id, claim_id, false as latest from rivals union all select identity_id, claim_id, true from own where place = 1 and identity_id in (select identity_id from rivals))
    select * from (select claim_id, case when identity_id % 3 = 1 then 'contested' when identity_id % 3 = 0 and not latest then 'superseded' when identity_id % 3 = 2 and latest then 'rejected' end as status from touched) where status is not null""")
def c12(t: Store) -> DataFrame:
    strategy = F.array(F.lit("supersede"), F.lit("keep_both"), F.lit("reject"))[(F.col("identity_id") % 3).cast("int")]
    return lifecycle.activated(t.claims, t.claims.select("identity_id").distinct().withColumn("strategy", strategy))


LIFE = "life as (select user_id as memory_id, event_id, ts, case when event_type = 'signup' then 'propose' when event_type = 'view' then 'update' when event_type = 'purchase' then 'confirm' when event_type = 'error' then 'reject' when event_id % 40 = 0 then 'forget' else 'update' end as action from events)"


@query("C13_status_fold", f"with {LIFE}, last as (select memory_id, bool_or(action = 'forget') as gone, arg_max(action, (ts, event_id)) filter (action in ('propose', 'confirm', 'reject', 'forget')) as last, count(*) filter (action = 'update') as updates from life group by memory_id) select memory_id, case when gone then 'forgotten' else case last when 'confirm' then 'active' when 'reject' then 'rejected' else 'candidate' end end as status, updates from last")
def c13(t: Store) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "propose").when(F.col("event_type") == "view", "update").when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject").when(F.col("event_id") % 40 == 0, "forget").otherwise("update")
    return lifecycle.folded(t.raw("events").select(F.col("user_id").alias("memory_id"), "event_id", "ts", action.alias("action")))


@query("D6_bulk_transition", """with due as (select claim_id, identity_id, version_number, status from claim_versions where transaction_to is null and stale_state = 'stale' and status <> 'stale')
    select claim_id, version_number, status, false as open from due union all select claim_id, version_number + 1, 'stale', true from due""")
def d6(t: Store) -> DataFrame:
    """Open versions of stale claims that don't say so yet get one that does."""
    due = t.claim_versions.where("transaction_to is null and stale_state = 'stale' and status <> 'stale'")
    changes = due.select("claim_id", F.lit("stale").alias("status"), intervals.moment("2003-01-01 00:00:00").alias("at"))
    out = truth.append_transition(t.claim_versions, changes).join(due.select("claim_id"), "claim_id", "left_semi")
    return out.select("claim_id", F.col("version_number").cast("long").alias("version_number"), "status", F.col("transaction_to").isNull().alias("open"))


@query("D7_conflict_resolution", f"""with pairs as ({sql_of('C5_claim_pairs')}), live as (select claim_id from claims c join memories m using (memory_id) where c.status = 'accepted' and m.status = 'active')
    select left_claim_id, right_claim_id, case when left_claim_id in (from live) and right_claim_id in (from live) then 'contested' else 'unchanged' end as outcome from pairs where relationship = 'contradicts'""")
def d7(t: Store) -> DataFrame:
    pairs = claim_plans.c5(t).where("relationship = 'contradicts'")
    return lifecycle.contested(pairs, t.claims, t.memories)


@query("F9_similarity", "select memory_id, round(2.0::double * length(title) / (2 * length(title) + 5), 6) as ratio from memories where length(title) > 0")
def f9(t: Store) -> DataFrame:
    """A title and itself with two characters before and three after it: all of it matches."""
    rows = t.memories.where(F.length("title") > 0).select("memory_id", "title", F.concat(F.lit("ab"), F.col("title"), F.lit("xyz")).alias("other"))
    return rows.select("memory_id", F.round(plain.sequence_ratio("title", "other"), 6).alias("ratio"))


@query("M2_training_rows", """with paired as (select query_id, memory_id as a_id, quality as qa, lead(memory_id) over w as b_id, lead(quality) over w as qb from judged window w as (partition by query_id order by memory_id))
    select query_id, a_id, b_id, round(x.importance - y.importance, 6) as importance, round(x.confidence - y.confidence, 6) as confidence, (qa > qb)::int as label from paired join memories x on x.memory_id = a_id join memories y on y.memory_id = b_id where b_id is not null and qa <> qb""")
def m2(t: Store) -> DataFrame:
    """Neighbours in a query's list as comparisons: the difference of their features and which is better; even ones teach nothing."""
    order = Window.partitionBy("query_id").orderBy("memory_id")
    pairs = t.judged.select("query_id", F.col("memory_id").alias("a_id"), F.lead("memory_id").over(order).alias("b_id"), F.signum(F.col("quality") - F.lead("quality").over(order)).alias("better")).where("b_id is not null and better <> 0")
    features = lambda side: t.memories.select(F.col("memory_id").alias(f"{side}_id"), F.col("importance").alias(f"{side}_importance"), F.col("confidence").alias(f"{side}_confidence"))
    rows = pairs.join(features("a"), "a_id").join(features("b"), "b_id")
    delta = [F.round(F.col(f"a_{c}") - F.col(f"b_{c}"), 6).alias(c) for c in ("importance", "confidence")]
    return rows.select("query_id", "a_id", "b_id", *delta, (F.col("better") > 0).cast("int").alias("label"))


WORD = "[\\p{L}\\p{N}\\p{M}_.]+"


@query("M16_hard_negatives", f"""with cases as (select j.query_id, j.memory_id, quality, len(list_intersect(list_distinct(regexp_extract_all(lower(a.query), '{WORD}')), list_distinct(regexp_extract_all(lower(m.title), '{WORD}')))) + case when category = 'decision' then 3 else 0 end - case when m.memory_id % 7 = 0 then 10 else 0 end as score
        from judged j join asks a on a.query_id = j.query_id join memories m on m.memory_id = j.memory_id where m.status = 'active' and m.memory_id not in (select memory_id from claims where stale_state = 'stale')),
    picked as (select *, row_number() over (partition by query_id order by score desc, memory_id) as place from cases), wanted as (select query_id, count(*) filter (quality = 1) as gold from judged group by query_id)
    select w.query_id, count(place) as retrieved, count(*) filter (quality = 1 and place is not null) as hits, round(count(*) filter (quality = 1 and place is not null) / nullif(count(place), 0)::double, 6) as precision, round(count(*) filter (quality = 1 and place is not null) / nullif(any_value(gold), 0)::double, 6) as recall, false as leaks
    from wanted w join asks using (query_id) left join (select * from picked where place <= 5) p on p.query_id = w.query_id group by w.query_id""")
def m16(t: Store) -> DataFrame:
    """The five best of each query by a rule that sees no judgement, from what is visible, against the judged ones."""
    fresh = t.claims.where("stale_state = 'stale'").select("memory_id")
    shown = t.memories.where("status = 'active'").join(fresh, "memory_id", "left_anti")
    cases = t.judged.select("query_id", "memory_id").join(t.asks, "query_id").join(shown.select("memory_id", "title", "category"), "memory_id")
    leaks = bool({"quality", "toxic", "relevance", "gold"} & set(cases.columns))
    shared = F.size(F.array_intersect(text.tokens(F.col("query")), text.tokens(F.col("title"))))
    score = shared + F.when(F.col("category") == "decision", 3).otherwise(0) - F.when(F.col("memory_id") % 7 == 0, 10).otherwise(0)
    picked = cases.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "memory_id"))).where("place <= 5").select("query_id", "memory_id", "place")
    marked = t.judged.join(t.asks.select("query_id"), "query_id", "left_semi").join(picked, ["query_id", "memory_id"], "left")
    hit = (F.col("quality") == 1) & F.col("place").isNotNull()
    out = marked.groupBy("query_id").agg(F.count("place").alias("retrieved"), F.count_if(hit).alias("hits"), F.count_if(F.col("quality") == 1).alias("gold"))
    share = lambda c: F.round(F.try_divide(F.col("hits"), F.col(c)), 6)
    return out.select("query_id", "retrieved", "hits", share("retrieved").alias("precision"), share("gold").alias("recall"), F.lit(leaks).alias("leaks"))


@query("C2_evidence_spans", f"with {NOTE_SQL} select memory_id, predicate, object, case when memory_id % 5 = 0 then 'evidence_out_of_bounds' when memory_id % 5 = 1 then 'evidence_quote_mismatch' when memory_id % 5 = 2 then 'empty_predicate' end as reason from extracted")
def c2(t: Store) -> DataFrame:
    """Claims whose span, quote or predicate was spoilt are refused, with the first reason."""
    texts = notes(t)
    case = F.col("memory_id") % 5
    rows = lifecycle.extracted(texts).join(texts.select("memory_id", F.trim("text").alias("source")), "memory_id").withColumn("said", F.col("predicate"))
    quote = F.substring(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start"))
    rows = rows.withColumn("quote", F.when(case == 1, F.concat(F.lit("#"), quote)).otherwise(quote)).withColumn("end", F.when(case == 0, F.col("end") + 100_000).otherwise(F.col("end"))).withColumn("predicate", F.when(case == 2, " ").otherwise(F.col("predicate")))
    return lifecycle.refused(rows).select("memory_id", F.col("said").alias("predicate"), "object", "reason")


@query("ST5_late_knowledge", """with at_once as (select claim_id, status from claim_versions where transaction_from <= timestamp '1997-06-01' and (transaction_to is null or timestamp '1997-06-01' < transaction_to) and valid_from <= timestamp '1997-06-01' and (valid_to is null or timestamp '1997-06-01' < valid_to)),
    later as (select claim_id, status from claim_versions where transaction_from <= timestamp '1997-06-05' and (transaction_to is null or timestamp '1997-06-05' < transaction_to) and valid_from <= timestamp '1997-06-01' and (valid_to is null or timestamp '1997-06-01' < valid_to))
    select coalesce(a.claim_id, l.claim_id) as claim_id, case when a.claim_id is null then 'learned' when l.claim_id is null then 'corrected' when a.status <> l.status then 'changed' else 'same' end as knowledge from at_once a full join later l using (claim_id)""")
def st5(t: Store) -> DataFrame:
    """What was true at a moment, as known then and four days later: late rows correct the past, they are not dropped."""
    moment = lambda text: intervals.moment(f"{text} 00:00:00")
    then = truth.visible_versions(t.claim_versions, moment("1997-06-01"), moment("1997-06-01")).select("claim_id", F.col("status").alias("then"))
    later = truth.visible_versions(t.claim_versions, moment("1997-06-01"), moment("1997-06-05")).select("claim_id", F.col("status").alias("later"))
    knowledge = F.when(F.col("then").isNull(), "learned").when(F.col("later").isNull(), "corrected").when(F.col("then") != F.col("later"), "changed").otherwise("same")
    return then.join(later, "claim_id", "full").select("claim_id", knowledge.alias("knowledge"))
