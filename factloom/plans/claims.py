"""Queries about claims, entities and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, plain, text
from factloom.operators import claims as truth
from factloom.plans.registry import query, sql_of
from factloom.sources.model import Store

MOMENT, EVENTS = "1997-06-01 00:00:00", "2024-01-20 00:00:00"


def at():
    return intervals.moment(MOMENT)


VISIBLE = f"""visible as (select * from (select *, row_number() over (partition by claim_id order by transaction_from desc, version_number desc, identity_id) as visibility from claim_versions
    where transaction_from <= timestamp '{MOMENT}' and (transaction_to is null or timestamp '{MOMENT}' < transaction_to) and valid_from <= timestamp '{MOMENT}' and (valid_to is null or timestamp '{MOMENT}' < valid_to)) where visibility = 1)"""
SINGLE = "(predicate = 'prefers' or (predicate = 'uses' and regexp_matches(subject, 'database|framework|package_manager|current|primary')))"


@query("C5_claim_pairs", f"""select a.claim_id as left_claim_id, b.claim_id as right_claim_id, case when a.object_value = b.object_value and a.polarity = b.polarity then 'equivalent' when a.polarity = b.polarity and (contains(a.object_value, b.object_value) or contains(b.object_value, a.object_value)) then 'supports'
    when a.object_value = b.object_value then 'contradicts' when {SINGLE.replace('predicate', 'a.predicate').replace('subject', 'e.normalized_name')} then 'contradicts' else 'uncertain' end as relationship from claims a join claims b on a.scope_type = b.scope_type and a.scope_key = b.scope_key and a.subject_entity_id = b.subject_entity_id and a.predicate = b.predicate and a.claim_id < b.claim_id
    join entities e on e.entity_id = a.subject_entity_id where greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, timestamp '2200-01-01'), coalesce(b.valid_to, timestamp '2200-01-01'))""")
def c5(t: Store) -> DataFrame:
    rows = t.claims.join(t.entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("normalized_name").alias("subject")), "subject_entity_id")
    return truth.classified_pairs(rows).select("left_claim_id", "right_claim_id", "relationship")


@query("C6_cardinality", f"select entity_id, predicate, {SINGLE.replace('subject', 'normalized_name')} as single from (select entity_id, normalized_name, unnest(['uses', 'prefers', 'forbidden']) as predicate from (select entity_id, case when entity_id % 5 = 0 then 'primary ' else '' end || normalized_name as normalized_name from entities))")
def c6(t: Store) -> DataFrame:
    name = F.concat(F.when(F.col("entity_id") % 5 == 0, "primary ").otherwise(""), F.col("normalized_name"))
    rows = t.entities.select("entity_id", name.alias("subject"), F.explode(F.array(F.lit("uses"), F.lit("prefers"), F.lit("forbidden"))).alias("predicate"))
    return rows.select("entity_id", "predicate", truth.single_valued(F.col("predicate"), F.col("subject")).alias("single"))


@query("C8_stable_identity", "select claim_id, sha256(scope_type || '|' || scope_key || '|' || subject_entity_id || '|' || predicate) as identity from claims")
def c8(t: Store) -> DataFrame:
    return t.claims.select("claim_id", truth.stable_identity(F.col("scope_type"), F.col("scope_key"), F.col("subject_entity_id").cast("string"), F.col("predicate")).alias("identity"))


@query("C9_transitions", "select claim_id, status, version_number from claim_versions union all select claim_id, 'rejected', version_number + 1 from claim_versions where transaction_to is null and identity_id % 4 = 0")
def c9(t: Store) -> DataFrame:
    changes = t.claim_versions.where("transaction_to is null and identity_id % 4 = 0").select("claim_id", F.lit("rejected").alias("status"), intervals.moment("2002-01-01 00:00:00").alias("at"))
    return truth.append_transition(t.claim_versions, changes).select("claim_id", "status", F.col("version_number").cast("long").alias("version_number"))


@query("C10_visible_versions", f"with {VISIBLE} select claim_id, identity_id, status from visible")
def c10(t: Store) -> DataFrame:
    return truth.visible_versions(t.claim_versions, at(), at()).select("claim_id", "identity_id", "status")


EVIDENCE = "select {0}, claim_id, 'evidence' as section, evidence_id as item_id, concat_ws(' ', source_ref, path) as detail from {1} join claim_evidence using (claim_id) join sources using (source_id) left join anchors using (anchor_id)"
HISTORY = f"select {{0}}, claim_id, 'history' as section, version_number as item_id, v.status || ' ' || v.stale_state as detail from {{1}} join claim_versions v using (claim_id) where v.transaction_from <= timestamp '{MOMENT}'"
RELATION = "select {0}, claim_id, 'relation' as section, to_id as item_id, 'from' as detail from {1} join claim_relations on from_id = claim_id union all select {0}, claim_id, 'relation', from_id, 'to' from {1} join claim_relations on to_id = claim_id where from_id <> to_id"
STOOD = f"""{VISIBLE}, gone as (select memory_id from (select memory_id, arg_max(action, (ts, event_id)) as action from audit_events where action <> 'other' and ts <= timestamp '{EVENTS}' group by memory_id) where action = 'health_archive'
    union select memory_id from health where temperature = 'archived' and memory_id not in (select memory_id from audit_events where action <> 'other')),
    standing as (select v.*, normalized_name as subject from visible v join entities e on e.entity_id = v.subject_entity_id where memory_id not in (select memory_id from gone)),
    grouped as (select identity_id, predicate, subject, count(*) as versions, count(*) filter (status in ('accepted', 'contested') and stale_state <> 'stale') as live, count(distinct case when status in ('accepted', 'contested') and stale_state <> 'stale' then object_value end) as objects, bool_or(status = 'contested') as c from standing group by identity_id, predicate, subject),
    states as (select *, case when c or ({SINGLE} and objects > 1) then 'contested' when live = 0 then 'stale' else 'resolved' end as state from grouped),
    stood as (select claim_id, identity_id, status, object_value, state from standing join states using (identity_id))"""


def standing(t: Store) -> DataFrame:
    """Events have a clock of their own here, so archived memories are taken at the events' moment."""
    return truth.standing_versions(t.claim_versions, t.entities, t.audit_events, at(), at(), intervals.moment(EVENTS), t.health)


@query("C11_current_truth", f"""with {STOOD}, related as ({RELATION.format('identity_id, state', 'stood')}), told as (select identity_id, state, claim_id, 'accepted' as section, claim_id as item_id, status || ' ' || object_value as detail from stood where status in ('accepted', 'contested')
    union all select identity_id, state, claim_id, 'conflicting', claim_id, status || ' ' || object_value from stood where state = 'contested' union all {EVIDENCE.format('identity_id, state', 'stood')} union all {HISTORY.format('s.identity_id, state', 'stood s')}
    union all select r.* from related r where detail = 'from' or not exists (select 1 from stood s where s.claim_id = r.item_id and s.identity_id = r.identity_id))
    select identity_id, state, section, claim_id, item_id, detail from told""")
def c11(t: Store) -> DataFrame:
    return truth.told_truth(standing(t), t.claim_evidence, t.sources, t.anchors, t.claim_versions, t.claim_relations, at())


@query("C11_truth_states", f"with {STOOD} select identity_id, versions, live, objects, state from states")
def c11_states(t: Store) -> DataFrame:
    return truth.truth_states(standing(t)).select("identity_id", "versions", "live", "objects", "state")


@query("C16_archive_guard", "select distinct memory_id from (select identity_id, min(memory_id) as memory_id, max(memory_id) as other from claim_versions where status = 'accepted' and transaction_to is null group by identity_id) where memory_id = other")
def c16(t: Store) -> DataFrame:
    return truth.sole_support(t.claim_versions)


@query("C17_consolidation", """with episodes as (select c.subject_entity_id, c.predicate, c.object_value, c.polarity, c.claim_id, s.source_ref, e.captured_at from claims c join claim_evidence e using (claim_id) join sources s using (source_id) where c.status in ('accepted', 'contested') and c.stale_state <> 'stale'),
    counted as (select subject_entity_id, predicate, object_value, polarity, count(*) as n, min(claim_id) as first_claim from episodes group by all), placed as (select *, row_number() over (partition by subject_entity_id, predicate order by n desc, first_claim, object_value, polarity) as place, sum(n) over (partition by subject_entity_id, predicate) as total from counted),
    sourced as (select e.subject_entity_id, e.predicate, source_ref, min(captured_at) as captured_at from episodes e join placed p on p.place = 1 and p.subject_entity_id = e.subject_entity_id and p.predicate = e.predicate and p.object_value = e.object_value and p.polarity = e.polarity group by all),
    span as (select subject_entity_id, predicate, count(*) as source_count, (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 86400000000.0::double as span_days from sourced group by all)
    select p.subject_entity_id, p.object_value, p.polarity, source_count, round(span_days, 6) as span_days, case when source_count < 3 or span_days < 7 then 'none' when total > n then 'contested' else 'candidate' end as label from placed p join span s on s.subject_entity_id = p.subject_entity_id and s.predicate = p.predicate where place = 1""")
def c17(t: Store) -> DataFrame:
    return truth.consolidated(t.claims, t.claim_evidence, t.sources).select("subject_entity_id", "object_value", "polarity", "source_count", F.round("span_days", 6).alias("span_days"), "label")


@query("C18_claim_graph", "select node, count(*) as degree from (select from_id as node from claim_relations union all select to_id from claim_relations) group by node")
def c18(t: Store) -> DataFrame:
    r = t.claim_relations
    return r.select(F.col("from_id").alias("node")).union(r.select("to_id")).groupBy("node").agg(F.count("*").alias("degree"))


@query("C20_freshness_machine", "select anchor_id, case when p_size % 7 = 0 then 'stale' when p_size % 3 = 0 or (p_size % 2 = 0 and p_size % 5 = 0) then case when p_size % 4 = 0 then 'moved' else 'fresh' end when p_size % 2 = 0 and p_size / 50.0 >= 0.35 then 'suspect' else 'stale' end as state from anchors")
def c20(t: Store) -> DataFrame:
    n = F.col("p_size")
    return t.anchors.select("anchor_id", truth.mutation_state(n % 7 != 0, n % 3 == 0, n % 4 == 0, n % 2 == 0, n % 5 == 0, n / 50).alias("state"))


@query("D8_review_queue", "select m.memory_id from memories m where status = 'candidate' and exists (select 1 from memories o where o.memory_key = m.memory_key and o.memory_id <> m.memory_id)")
def d8(t: Store) -> DataFrame:
    keys = t.memories.where("memory_key is not null").groupBy("memory_key").agg(F.count("*").alias("n")).where("n > 1")
    return t.memories.where("status = 'candidate'").join(keys, "memory_key", "left_semi").select("memory_id")


@query("D10_idempotent_edges", "select from_id, to_id from claim_relations union select claim_id, claim_id + 1 from claims where claim_id % 50 = 0")
def d10(t: Store) -> DataFrame:
    new = t.claims.where("claim_id % 50 = 0").select(F.col("claim_id").alias("from_id"), (F.col("claim_id") + 1).alias("to_id"))
    return t.claim_relations.union(new.join(t.claim_relations, ["from_id", "to_id"], "left_anti").dropDuplicates())


@query("D13_rename_detection", "select anchor_id, path as old_path, replace(path, '.py', '_new.py') as new_path from anchors where freshness_state = 'moved'")
def d13(t: Store) -> DataFrame:
    """Lines of a change log, of which renames have a score, the old and the new path."""
    moved = F.concat_ws("\t", F.concat(F.lit("R0"), (F.col("anchor_id") % 90 + 10).cast("string")), "path", F.replace(F.col("path"), F.lit(".py"), F.lit("_new.py")))
    line = F.when(F.col("freshness_state") == "moved", moved).when(F.col("freshness_state") == "stale", F.concat_ws("\t", F.lit("D"), "path")).otherwise(F.concat_ws("\t", F.lit("M"), "path"))
    part = F.split("line", "\t")
    return t.anchors.select("anchor_id", line.alias("line")).where(part[0].rlike("^R[0-9]{3}$")).select("anchor_id", part[1].alias("old_path"), part[2].alias("new_path"))


@query("D19_version_backfill", "select identity_id, count(*) as versions, max(version_number) as last from claim_versions group by identity_id")
def d19(t: Store) -> DataFrame:
    return truth.version_chain(t.claims).groupBy("identity_id").agg(F.count("*").alias("versions"), F.max("version_number").cast("long").alias("last"))


@query("A16_worst_freshness", "select path_group, arg_max(freshness_state, severity) as freshness_state, count(*) as anchors from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as path_group, freshness_state, case freshness_state when 'fresh' then 0 when 'moved' then 1 when 'unknown' then 2 when 'suspect' then 3 else 4 end as severity from anchors) group by path_group")
def a16(t: Store) -> DataFrame:
    return truth.worst_freshness(t.anchors.withColumn("path_group", text.path_parts(F.col("path"))["parent"]), ["path_group"])


@query("C19_timeline", "select memory_id, event_id, action, place from (select memory_id, event_id, action, row_number() over (partition by memory_id order by ts desc, event_id) as place from audit_events) where place <= 50")
def c19(t: Store) -> DataFrame:
    """The last fifty events of every memory."""
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("ts"), "event_id"))
    return t.audit_events.withColumn("place", place).where("place <= 50").select("memory_id", "event_id", "action", F.col("place").cast("long").alias("place"))


@query("C22_distillation", "select scope_type, part, count(*) as members, sha256(string_agg(title, chr(10) order by memory_id)) as digest from (select scope_type, memory_id, title, (row_number() over (partition by scope_type order by memory_id) - 1) // 50 as part from memories join health using (memory_id) where temperature = 'archived') group by scope_type, part")
def c22(t: Store) -> DataFrame:
    """Candidates of distillation: the titles of archived memories in order, fifty to a text, so that no list grows with a scope."""
    part = F.floor((F.row_number().over(Window.partitionBy("scope_type").orderBy("memory_id")) - 1) / 50)
    rows = t.memories.select("memory_id", "scope_type", "title").join(t.health.where("temperature = 'archived'").select("memory_id"), "memory_id").withColumn("part", part)
    titles = F.array_sort(F.collect_list(F.struct("memory_id", "title")))
    out = rows.groupBy("scope_type", "part").agg(F.count("*").alias("members"), titles.alias("titles"))
    return out.select("scope_type", "part", "members", F.sha2(F.array_join(F.transform("titles", lambda x: x["title"]), "\n"), 256).alias("digest"))


@query("C23_explain", f"""with held as (select memory_id, case when bool_or(status = 'contested') then 'contested' when bool_or(status = 'stale' or stale_state = 'stale') then 'stale' when bool_or(status = 'accepted') then 'resolved' else 'unknown' end as truth,
    case when bool_or(stale_state = 'stale') then 'stale' when bool_or(stale_state = 'suspect') then 'suspect' when bool_or(stale_state = 'fresh') then 'fresh' else 'unknown' end as freshness from claims group by memory_id), own as (select claim_id, memory_id from claims semi join memories using (memory_id)),
    told as (select memory_id, null::bigint as claim_id, 'fact' as section, memory_id as item_id, sha256(content) || ' ' || coalesce(truth, 'unknown') || ' ' || coalesce(freshness, 'unknown') as detail from memories left join held using (memory_id)
    union all select memory_id, null, 'audit', event_id, action from audit_events semi join memories using (memory_id) union all {EVIDENCE.format('memory_id', 'own')} union all {HISTORY.format('own.memory_id', 'own')} union all {RELATION.format('memory_id', 'own')})
    select memory_id, section, claim_id, item_id, detail from told""")
def c23(t: Store) -> DataFrame:
    return truth.explained(t.memories, t.claims, t.claim_evidence, t.sources, t.anchors, t.claim_versions, t.claim_relations, t.audit_events, at())


@query("D2_archive_restore", "select event_id, memory_id, action, lag(action) over w as previous, ts + to_microseconds(row_number() over (partition by memory_id, ts order by event_id) - 1) as at from audit_events where action <> 'other' window w as (partition by memory_id order by ts, event_id)")
def d2(t: Store) -> DataFrame:
    """Each event with the state before it, and at a time of its own: events of one moment follow each other by microseconds."""
    own = t.audit_events.where("action <> 'other'")
    later = F.row_number().over(Window.partitionBy("memory_id", "ts").orderBy("event_id")) - 1
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + later).cast("timestamp_ntz")
    return own.select("event_id", "memory_id", "action", F.lag("action").over(Window.partitionBy("memory_id").orderBy("ts", "event_id")).alias("previous"), at.alias("at"))


@query("D5_identity_find_or_create", """with keyed as (select claim_id, sha256(concat_ws('|', scope_type, scope_key, subject_entity_id::varchar, predicate)) as identity_key from claims), held as (select distinct identity_key from keyed where claim_id % 2 = 0)
    select k.identity_key, min(claim_id) as first_claim, count(*) as claims, bool_or(h.identity_key is not null) as found from keyed k left join held h on h.identity_key = k.identity_key group by k.identity_key""")
def d5(t: Store) -> DataFrame:
    """Identities by their stable key: found among those that are held, or created with their first claim."""
    key = truth.stable_identity(F.col("scope_type"), F.col("scope_key"), F.col("subject_entity_id").cast("string"), F.col("predicate"))
    keyed = t.claims.select("claim_id", key.alias("identity_key"))
    held = keyed.where("claim_id % 2 = 0").select("identity_key").distinct().withColumn("held", F.lit(True))
    out = keyed.groupBy("identity_key").agg(F.min("claim_id").alias("first_claim"), F.count("*").alias("claims"))
    return out.join(held, "identity_key", "left").select("identity_key", "first_claim", "claims", F.coalesce("held", F.lit(False)).alias("found"))


@query("D12_context_hash", "with cut as (select memory_id, string_split(content, chr(10)) as lines from memories), placed as (select memory_id, lines, memory_id % len(lines) + 1 as line from cut) select memory_id, line, substr(lines[line], 1, 400) as excerpt, sha256(array_to_string(list_slice(lines, greatest(1, line - 3), line + 3), chr(10))) as context_hash from placed")
def d12(t: Store) -> DataFrame:
    """An anchor at a line: a bounded excerpt of the line, and the digest of it with three lines on either side."""
    rows = t.memories.select("memory_id", F.split("content", "\n").alias("lines")).withColumn("at", F.col("memory_id") % F.size("lines") + 1)
    first = F.greatest(F.lit(1).cast("long"), F.col("at") - 3)
    around = F.slice("lines", first.cast("int"), (F.col("at") + 3 - first + 1).cast("int"))
    line = F.element_at("lines", F.col("at").cast("int"))
    return rows.select("memory_id", F.col("at").alias("line"), F.substring(line, 1, 400).alias("excerpt"), F.sha2(F.array_join(around, "\n"), 256).alias("context_hash"))


@query("D14_symmetric_comparison", f"with pairs as ({sql_of('C5_claim_pairs')}) select case when relationship = 'uncertain' then 'independent' else relationship end as relationship, count(*) as pairs from pairs group by 1")
def d14(t: Store) -> DataFrame:
    """What pairs come to when nobody judges: the uncertain are independent."""
    kind = F.when(F.col("relationship") == "uncertain", "independent").otherwise(F.col("relationship"))
    return c5(t).groupBy(kind.alias("relationship")).agg(F.count("*").alias("pairs"))


@query("C7_judged_conflicts", f"with pairs as ({sql_of('C5_claim_pairs')}), judged_pairs as (select left_claim_id, right_claim_id, ((left_claim_id + right_claim_id) % 10) / 10.0::double as confidence, (left_claim_id * 7 + right_claim_id) % 3 <> 0 as says from pairs where relationship = 'uncertain') select left_claim_id, right_claim_id, case when confidence < 0.7 then 'abstained' when says then 'conflict' else 'no_conflict' end as decision from judged_pairs")
def c7(t: Store) -> DataFrame:
    """Only uncertain pairs are judged; a judgement below 0.7 is kept as an abstention."""
    rows = c5(t).where("relationship = 'uncertain'")
    confidence, says = ((F.col("left_claim_id") + F.col("right_claim_id")) % 10) / 10, (F.col("left_claim_id") * 7 + F.col("right_claim_id")) % 3 != 0
    return truth.judged_conflicts(rows, says, confidence)


@query("A9_truth_groups", f"with grouped as (select identity_id, predicate, normalized_name as subject, count(distinct object_value) as objects, bool_or(status = 'contested') as any_contested from claims join entities on entity_id = subject_entity_id where stale_state <> 'stale' group by identity_id, predicate, normalized_name) select identity_id, predicate, objects, any_contested or ({SINGLE} and objects > 1) as contested from grouped")
def a9(t: Store) -> DataFrame:
    rows = t.claims.where("stale_state <> 'stale'").join(t.entities.select(F.col("entity_id").alias("subject_entity_id"), "normalized_name"), "subject_entity_id")
    grouped = rows.groupBy("identity_id", "predicate", "normalized_name").agg(F.count_distinct("object_value").alias("objects"), F.bool_or(F.col("status") == "contested").alias("any"))
    single = truth.single_valued(F.col("predicate"), F.col("normalized_name")) & (F.col("objects") > 1)
    return grouped.select("identity_id", "predicate", "objects", (F.col("any") | single).alias("contested"))


@query("D9_relations_of_claims", f"with {STOOD}, asked as (select claim_id from stood where state = 'contested') {RELATION.format('1 as one', 'asked').replace('1 as one, ', '')} union all {HISTORY.format('1', 'asked').replace('select 1, ', 'select ')}")
def d9(t: Store) -> DataFrame:
    """Relations at either end, and the history up to a moment, of the claims whose truth is contested."""
    rows = standing(t)
    asked = rows.join(truth.truth_states(rows).where("state = 'contested'").select("identity_id"), "identity_id", "left_semi").select("claim_id")
    return truth.relation_items(asked, t.claim_relations).unionByName(truth.history_items(asked, t.claim_versions, at()))


@query("C3_canonical_predicate", "select memory_id, p as predicate, lower(subject) || '|' || p || '|postgresql|' || case when memory_id % 5 = 0 then 'negative' else 'positive' end as claim_key from (select memory_id, subject, case category when 'decision' then 'uses' when 'constraint' then 'forbidden' when 'preference' then 'prefers' when 'failure' then 'failed_because' else category end as p from memories)")
def c3(t: Store) -> DataFrame:
    """A predicate's normal form, and the key of a claim: subject, predicate, object and polarity in theirs."""
    polarity = F.when(F.col("memory_id") % 5 == 0, "negative").otherwise("positive")
    predicate = text.canonical_predicate(F.upper("category"))
    key = F.concat_ws("|", plain.normalized_entity("subject"), predicate, plain.normalized_entity(F.lit(" PostgreSQL  DB ")), polarity)
    return t.memories.select("memory_id", predicate.alias("predicate"), key.alias("claim_key"))


@query("C14_alias_union", "select entity_id % 100 as target_id, string_agg(distinct alias, ',' order by alias) as aliases, count(distinct entity_id) - 1 as merged from (select entity_id, unnest([normalized_name, entity_type]) as alias from entities) group by entity_id % 100")
def c14(t: Store) -> DataFrame:
    """Entities merged into one: all names of all of them, and how many redirect to it."""
    merged = t.entities.select(F.col("entity_id").alias("entity_id"), (F.col("entity_id") % 100).alias("target_id"), F.explode(F.array("normalized_name", "entity_type")).alias("alias"))
    return merged.groupBy("target_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases"), (F.count_distinct("entity_id") - 1).alias("merged"))
