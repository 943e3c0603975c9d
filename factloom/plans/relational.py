"""Scans, filters, joins, windows, top-k and set operations of the memory store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, text
from factloom.operators import claims as truth
from factloom.operators import context, health, joins, retrieval
from factloom.plans.registry import query
from factloom.sources import vectors
from factloom.sources.model import Store
from factloom.sources.shared import kept_path

AT, KNOWN, VALID = "2024-02-10 00:00:00", "2024-02-01 00:00:00", "1997-06-01 00:00:00"


def at():
    return intervals.moment(AT)


def known():
    return intervals.moment(KNOWN)


def valid():
    return intervals.moment(VALID)


ALIVE = f"(valid_from is null or valid_from <= timestamp '{AT}') and (valid_to is null or timestamp '{AT}' < valid_to) and (ttl_seconds is null or created_at + to_seconds(ttl_seconds) > timestamp '{AT}')"


@query("S1_scan_pruned", "select memory_id, scope_type, status, importance from memories")
def s1(t: Store) -> DataFrame:
    return t.memories.select("memory_id", "scope_type", "status", "importance")


@query("S2_point_lookup", "select memory_id, title, status from memories where memory_id in (3, 5, 77, 100000000)")
def s2(t: Store) -> DataFrame:
    wanted = t.spark.createDataFrame([(3,), (5,), (77,), (100_000_000,)], "memory_id long")
    return t.memories.join(F.broadcast(wanted), "memory_id", "left_semi").select("memory_id", "title", "status")


@query("S4_substring_fallback", "select memory_id from memories where contains(lower(title), 'tion') or contains(lower(content), 'the the') or contains(coalesce(memory_key, ''), '33')")
def s4(t: Store) -> DataFrame:
    hit = F.lower("title").contains("tion") | F.lower("content").contains("the the") | F.coalesce("memory_key", F.lit("")).contains("33")
    return t.memories.where(hit).select("memory_id")


@query("S6_vector_upsert", """with old as (select 'n' || (label % 3) as namespace, memory_id, embedding from vectors), changed as (select namespace, memory_id, case when namespace = 'n1' and memory_id % 10 = 0 then list_reverse(embedding) else embedding end as embedding from old
    union all select 'n1', max(memory_id) + 1, any_value(embedding) from (select * from old where namespace = 'n1' order by memory_id desc limit 1)), kept as (select * from changed where namespace <> 'n2')
    select names.namespace, count(memory_id) as items, round(coalesce(sum(embedding[1]::double * (memory_id % 7)), 0), 6) as content from (select distinct namespace from old) names left join kept on kept.namespace = names.namespace group by names.namespace""")
def s6(t: Store) -> DataFrame:
    """An index by namespace in which some vectors of one are replaced, one is put in and another namespace is cleared; the third is as it was."""
    own = t.vectors.withColumn("namespace", F.concat(F.lit("n"), (F.col("label") % 3).cast("string")))
    index = vectors.VectorIndex(t.spark, kept_path(t.spark, f"upsert-{uuid.uuid4().hex}", t.sf_dir))
    names = sorted(r["namespace"] for r in own.select("namespace").distinct().collect())  # three
    for name in names:
        index.rebuild(name, own.where(F.col("namespace") == name))
    n1 = own.where("namespace = 'n1'")
    last = n1.agg(F.max_by("embedding", "memory_id").alias("embedding"), (F.max("memory_id") + 1).alias("memory_id"))
    index.upsert("n1", n1.where("memory_id % 10 = 0").select("memory_id", F.reverse("embedding").alias("embedding")).unionByName(last))
    index.clear("n2")
    out = None
    for name in names:
        one = index.rows(name).agg(F.lit(name).alias("namespace"), F.count("*").alias("items"), F.round(F.coalesce(F.sum(F.col("embedding")[0] * (F.col("memory_id") % 7)), F.lit(0.0)), 6).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out


@query("S7_index_status", "select label as namespace, count(*) as items, max(len(embedding)) as dimensions, max(memory_id) as last_id from vectors group by label")
def s7(t: Store) -> DataFrame:
    return t.vectors.groupBy(F.col("label").alias("namespace")).agg(F.count("*").alias("items"), F.max(F.size("embedding")).cast("long").alias("dimensions"), F.max("memory_id").alias("last_id"))


@query("S8_index_backfill", "select memory_id from memories where memory_id not in (select memory_id from vectors)")
def s8(t: Store) -> DataFrame:
    return t.memories.select("memory_id").join(t.vectors.select("memory_id"), "memory_id", "left_anti")


@query("S11_row_validation", """select * from (select 'confidence_bounds' as rule, count(*) filter (confidence < 0.55 or confidence > 1) as violations from claims union all
    select 'interval', count(*) filter (not (valid_to is null or valid_from < valid_to)) from claims union all select 'polarity', count(*) filter (polarity not in ('positive', 'negative')) from claims)""")
def s11(t: Store) -> DataFrame:
    return health.violations(t.claims, {"confidence_bounds": F.col("confidence").between(0.55, 1), "interval": F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")), "polarity": F.col("polarity").isin("positive", "negative")})


@query("V1_vector_validity", "select 'dimensions' as rule, count(*) filter (len(embedding) <> 64) as violations from vectors union all select 'finite', count(*) filter (list_sum(list_transform(embedding, lambda x: case when isfinite(x) then 0 else 1 end)) > 0) from vectors")
def v1(t: Store) -> DataFrame:
    return health.violations(t.vectors, {"dimensions": F.size("embedding") == 64, "finite": F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))})


@query("S14_logical_delete", "select memory_id, case when memory_id % 5 = 0 then 'forgotten' else status end as status from memories")
def s14(t: Store) -> DataFrame:
    from factloom.sources.tables import upsert

    gone = t.memories.where("memory_id % 5 = 0").select("memory_id", F.lit("forgotten").alias("status"))
    return upsert(t.memories.select("memory_id", "status"), gone, ["memory_id"])


@query("P1_equality_filters", "select memory_id from memories where scope_type = 'repository' and scope_key = 'en' and memory_type = 'episodic' and status = 'active'")
def p1(t: Store) -> DataFrame:
    return t.memories.where("scope_type = 'repository' and scope_key = 'en' and memory_type = 'episodic' and status = 'active'").select("memory_id")


@query("P2_default_visibility", "select m.memory_id from memories m left join health h using (memory_id) where m.status = 'active' and (h.memory_id is null or h.temperature <> 'archived')")
def p2(t: Store) -> DataFrame:
    return t.memories.where("status = 'active'").join(t.health.where("temperature = 'archived'"), "memory_id", "left_anti").select("memory_id")


@query("P3_valid_at", f"select claim_id from claims where (valid_from is null or valid_from <= timestamp '{VALID}') and (valid_to is null or timestamp '{VALID}' < valid_to)")
def p3(t: Store) -> DataFrame:
    return t.claims.where(intervals.holds_at(F.col("valid_from"), F.col("valid_to"), valid())).select("claim_id")


@query("P4_ttl", f"select memory_id from memories where ttl_seconds is null or created_at + to_seconds(ttl_seconds) > timestamp '{AT}'")
def p4(t: Store) -> DataFrame:
    return t.memories.where(intervals.lives(F.col("created_at"), F.col("ttl_seconds"), at())).select("memory_id")


@query("P5_known_at", f"select claim_id from claims where recorded_at <= timestamp '{VALID}'")
def p5(t: Store) -> DataFrame:
    return t.claims.where(intervals.known_at(F.col("recorded_at"), valid())).select("claim_id")


@query("P6_interval_overlap", """select a.identity_id, count(*) as overlapping from claims a join claims b on a.identity_id = b.identity_id and a.claim_id < b.claim_id
    where greatest(a.valid_from, b.valid_from) < least(coalesce(a.valid_to, timestamp '2200-01-01'), coalesce(b.valid_to, timestamp '2200-01-01')) group by a.identity_id""")
def p6(t: Store) -> DataFrame:
    """Each pair once, where its later interval starts: intervals of an identity meet by nodes over time, not all with all."""
    pairs = joins.overlapping_within(t.claims.select("identity_id", "claim_id", "valid_from", "valid_to"), ["identity_id"], "claim_id")
    return pairs.groupBy("identity_id").agg(F.count("*").alias("overlapping"))


@query("P7_allowed_scopes", f"select memory_id from memories m where {ALIVE} and created_at <= timestamp '{KNOWN}' and ((scope_type = 'user') or (scope_type = 'task' and scope_key = 'en')) and status = 'active' and memory_id not in (select memory_id from health where temperature = 'archived')")
def p7(t: Store) -> DataFrame:
    return retrieval.visible(t.memories, t.health, at(), known(), [("user", None), ("task", "en")]).select("memory_id")


@query("P8_row_eligibility", f"select memory_id from memories where {ALIVE} and status = 'active' and memory_type <> 'procedural' and memory_id not in (select memory_id from health where temperature = 'archived')")
def p8(t: Store) -> DataFrame:
    return retrieval.visible(t.memories, t.health, at()).where("memory_type <> 'procedural'").select("memory_id")


@query("P9_claim_eligibility", f"""select c.claim_id from claims c join entities e on e.entity_id = c.subject_entity_id join memories m on m.memory_id = c.memory_id left join health h on h.memory_id = m.memory_id
    where m.status = 'active' and (h.memory_id is null or h.temperature <> 'archived') and c.status in ('accepted', 'contested') and c.stale_state <> 'stale' and (c.valid_from is null or c.valid_from <= timestamp '{VALID}') and (c.valid_to is null or timestamp '{VALID}' < c.valid_to)""")
def p9(t: Store) -> DataFrame:
    usable = t.claims.where("status in ('accepted', 'contested') and stale_state <> 'stale'").where(intervals.holds_at(F.col("valid_from"), F.col("valid_to"), valid())).select("claim_id", "memory_id", F.col("subject_entity_id").alias("entity_id"))
    return usable.join(t.entities.select("entity_id"), "entity_id", "left_semi").join(t.memories.where("status = 'active'").select("memory_id"), "memory_id", "left_semi").join(t.health.where("temperature = 'archived'"), "memory_id", "left_anti").select("claim_id")


@query("P10_contains_ends_equal", "select anchor_id, contains(lower(path), 'brand#1') as has, lower(symbol_fqn) like '%steel' as ends, lower(symbol_fqn) = 'large' as same from anchors")
def p10(t: Store) -> DataFrame:
    return t.anchors.select("anchor_id", F.lower("path").contains("brand#1").alias("has"), F.lower("symbol_fqn").endswith("steel").alias("ends"), (F.lower("symbol_fqn") == "large").alias("same"))


@query("P11_all_tokens_in_haystack", "select claim_id from claims c join entities e on e.entity_id = c.subject_entity_id where contains(normalized_name || ' ' || predicate || ' ' || object_value, 'customer') and contains(normalized_name || ' ' || predicate || ' ' || object_value, 'uses') and contains(normalized_name || ' ' || predicate || ' ' || object_value, 'urgent')")
def p11(t: Store) -> DataFrame:
    rows = t.claims.join(t.entities, F.col("entity_id") == F.col("subject_entity_id")).withColumn("haystack", F.concat_ws(" ", "normalized_name", "predicate", "object_value"))
    return rows.where(F.forall(F.split(F.lit("customer uses urgent"), " "), lambda w: F.contains(F.col("haystack"), w))).select("claim_id")


@query("P12_alias_subject", "select entity_id from entities where normalized_name = 'customer#000000007' or list_contains([lower(entity_type), 'c' || entity_id], 'c9')")
def p12(t: Store) -> DataFrame:
    aliases = F.array(F.lower("entity_type"), F.concat(F.lit("c"), F.col("entity_id").cast("string")))
    return t.entities.where((F.col("normalized_name") == "customer#000000007") | F.array_contains(aliases, "c9")).select("entity_id")


@query("P13_freshness_gate", "select memory_id from claims group by memory_id having not bool_or(stale_state = 'stale')")
def p13(t: Store) -> DataFrame:
    return retrieval.freshness_of(t.claims).where("freshness <> 'stale'").select("memory_id")


SECTION = "case when status <> 'active' then 'HISTORICAL / SUPERSEDED' when category = 'decision' then 'CURRENT DECISIONS' when category = 'constraint' then 'ACTIVE CONSTRAINTS' when category = 'failure' then 'KNOWN FAILURES / DO NOT REPEAT' when category = 'preference' or memory_type = 'preference' then 'RELEVANT PREFERENCES' else 'CURRENT BRANCH / TASK STATE' end"


@query("P14_sections", f"select memory_id, {SECTION} as section from memories")
def p14(t: Store) -> DataFrame:
    return t.memories.select("memory_id", context.section(F.col("status"), F.col("category"), F.col("memory_type")).alias("section"))


@query("P15_serialised", "select memory_id, scope_type || ':' || coalesce(scope_key, '') as scope, title, length(content) as chars, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created from memories")
def p15(t: Store) -> DataFrame:
    return t.memories.select("memory_id", F.concat_ws(":", "scope_type", F.coalesce("scope_key", F.lit(""))).alias("scope"), "title", F.length("content").cast("long").alias("chars"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("P16_due_for_expiry", f"select memory_id, case when valid_to is not null and valid_to <= timestamp '{AT}' then 'valid_to' else 'ttl' end as reason from memories where status in ('active', 'candidate') and ((valid_to is not null and valid_to <= timestamp '{AT}') or (ttl_seconds is not null and created_at + to_seconds(ttl_seconds) <= timestamp '{AT}'))")
def p16(t: Store) -> DataFrame:
    return health.due(t.memories, at())


@query("J2_claims_evidence_anchors", "select c.memory_id, count(*) as n, min(a.path) as first_path from claims c join claim_evidence e using (claim_id) join anchors a using (anchor_id) where a.freshness_state = 'fresh' group by c.memory_id")
def j2(t: Store) -> DataFrame:
    fresh = t.anchors.where("freshness_state = 'fresh'").select("anchor_id", "path")
    return t.claims.select("claim_id", "memory_id").join(t.claim_evidence.select("claim_id", "anchor_id"), "claim_id").join(fresh, "anchor_id").groupBy("memory_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("J3_graph_seed_join", "select e.entity_type, count(*) as claims, count(h.memory_id) as with_health from claims c join entities e on e.entity_id = c.subject_entity_id join memories m on m.memory_id = c.memory_id left join health h on h.memory_id = m.memory_id group by e.entity_type")
def j3(t: Store) -> DataFrame:
    rows = t.claims.select("memory_id", F.col("subject_entity_id").alias("entity_id")).join(t.entities.select("entity_id", "entity_type"), "entity_id").join(t.memories.select("memory_id"), "memory_id").join(t.health.select("memory_id", F.lit(1).alias("has")), "memory_id", "left")
    return rows.groupBy("entity_type").agg(F.count("*").alias("claims"), F.count("has").alias("with_health"))


@query("J6_evidence_sources", "select s.source_type, count(*) as n, round(sum(support_weight), 6) as support from claim_evidence e join sources s using (source_id) left join anchors a using (anchor_id) group by s.source_type")
def j6(t: Store) -> DataFrame:
    rows = t.claim_evidence.join(t.sources, "source_id").join(t.anchors.select("anchor_id"), "anchor_id", "left")
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.sum("support_weight"), 6).alias("support"))


@query("J7_newest_source", "select memory_id, arg_max(source_ref, (captured_at, evidence_id)) as source_ref from claims join claim_evidence using (claim_id) join sources using (source_id) group by memory_id")
def j7(t: Store) -> DataFrame:
    """Evidence of one time and id (the driver's lineitem repeats lines) ties; then the first row of the table counts."""
    evidence = t.placed_evidence.select("claim_id", "source_id", "captured_at", "evidence_id", "place")
    rows = t.claims.select("claim_id", "memory_id").join(evidence, "claim_id").join(t.sources, "source_id")
    return rows.groupBy("memory_id").agg(F.max_by("source_ref", F.struct("captured_at", "evidence_id", -F.col("place"))).alias("source_ref"))


@query("J11_semi_join", "select claim_id from claims where memory_id in (select memory_id from memories where category = 'decision')")
def j11(t: Store) -> DataFrame:
    return t.claims.join(t.memories.where("category = 'decision'").select("memory_id"), "memory_id", "left_semi").select("claim_id")


@query("J12_anti_join", "select memory_id from memories where memory_id not in (select memory_id from audit_events where action <> 'other')")
def j12(t: Store) -> DataFrame:
    return t.memories.select("memory_id").join(t.audit_events.where("action <> 'other'").select("memory_id"), "memory_id", "left_anti")


@query("J13_archived_as_of", "select memory_id from (select memory_id, arg_max(action, (ts, event_id)) as action from audit_events where action in ('health_archive', 'health_restore') and ts <= timestamp '2024-01-20' group by memory_id) where action = 'health_archive'")
def j13(t: Store) -> DataFrame:
    return truth.archived_at(t.audit_events, intervals.moment("2024-01-20 00:00:00"))


@query("J14_arm_pairs", "select a.task_id, a.run_id as baseline_run, b.run_id as treatment_run from usage a join usage b on a.task_id = b.task_id and a.cache_phase = b.cache_phase where a.condition = 'baseline' and b.condition = 'treatment'")
def j14(t: Store) -> DataFrame:
    side = lambda c: t.usage.where(F.col("condition") == c).select("task_id", "cache_phase", F.col("run_id").alias(f"{c}_run"))
    return side("baseline").join(side("treatment"), ["task_id", "cache_phase"]).select("task_id", "baseline_run", "treatment_run")


@query("J18_semantic_key", "select key_text, count(*) as n, min(memory_id) as first_id from (select memory_id, trim(regexp_replace(lower(coalesce(memory_key, subject, title)), '\\s+', ' ', 'g')) as key_text from memories) group by key_text having count(*) > 1")
def j18(t: Store) -> DataFrame:
    keyed = t.memories.select("memory_id", text.semantic_key(F.coalesce("memory_key", "subject", "title")).alias("key_text"))
    return keyed.groupBy("key_text").agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id")).where("n > 1")


@query("W1_latest_version", f"select identity_id, claim_id, version_number from (select *, row_number() over (partition by identity_id order by transaction_from desc, version_number desc, claim_id) as n from claim_versions where transaction_from <= timestamp '{VALID}') where n = 1")
def w1(t: Store) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("identity_id").orderBy(F.desc("transaction_from"), F.desc("version_number"), "claim_id"))
    return t.claim_versions.where(F.col("transaction_from") <= valid()).withColumn("n", rank).where("n = 1").select("identity_id", "claim_id", F.col("version_number").cast("long").alias("version_number"))


@query("W5_lookback_100", "select task_id, run_id, count(*) over (partition by task_id order by run_id rows between 100 preceding and 1 preceding) as earlier from usage")
def w5(t: Store) -> DataFrame:
    return t.usage.select("task_id", "run_id", F.count("*").over(Window.partitionBy("task_id").orderBy("run_id").rowsBetween(-100, -1)).alias("earlier"))


@query("W7_time_buckets", "select memory_id, bucket from (select memory_id, bucket, row_number() over (partition by scope_type, bucket order by sha256('seed:' || memory_id), memory_id) as n from (select memory_id, scope_type, (place * 4) // total as bucket from (select memory_id, scope_type, row_number() over (partition by scope_type order by created_at, memory_id) - 1 as place, count(*) over (partition by scope_type) as total from memories))) where n = 1")
def w7(t: Store) -> DataFrame:
    order, whole = Window.partitionBy("scope_type").orderBy("created_at", "memory_id"), Window.partitionBy("scope_type")
    placed = t.memories.select("memory_id", "scope_type", (F.row_number().over(order) - 1).alias("place"), F.count("*").over(whole).alias("total")).withColumn("bucket", F.floor(F.col("place") * 4 / F.col("total")))
    pick = F.row_number().over(Window.partitionBy("scope_type", "bucket").orderBy(F.sha2(F.concat(F.lit("seed:"), F.col("memory_id").cast("string")), 256), "memory_id"))
    return placed.withColumn("n", pick).where("n = 1").select("memory_id", "bucket")


@query("W9_version_chain", "select claim_id, version_number, transaction_from, transaction_to from claim_versions")
def w9(t: Store) -> DataFrame:
    return t.claim_versions.select("claim_id", F.col("version_number").cast("long").alias("version_number"), "transaction_from", "transaction_to")


@query("W10_latin_square", "select task_id, position, (task_id + position) % 3 as condition from (select distinct task_id from usage), (select unnest([0, 1, 2]) as position)")
def w10(t: Store) -> DataFrame:
    return t.usage.select("task_id").distinct().select("task_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("position")).withColumn("condition", (F.col("task_id") + F.col("position")) % 3)


@query("K3_page", "select memory_id from memories order by importance desc, created_at desc, memory_id limit 20 offset 10")
def k3(t: Store) -> DataFrame:
    return t.memories.orderBy(F.desc("importance"), F.desc("created_at"), "memory_id").offset(10).limit(20).select("memory_id")


@query("K6_ordered_distinct", "select query_id, memory_id, min(event_id) as event_id from (select event_id % 5 as query_id, memory_id, event_id from feedback) group by query_id, memory_id")
def k6(t: Store) -> DataFrame:
    return retrieval.ordered_distinct(t.feedback.select((F.col("event_id") % 5).alias("query_id"), "memory_id", "event_id"), "event_id")


@query("K7_recent_first", "select memory_id, title from memories order by created_at desc, memory_id limit 25")
def k7(t: Store) -> DataFrame:
    return t.memories.orderBy(F.desc("created_at"), "memory_id").limit(25).select("memory_id", "title")


@query("K8_hash_sample", "select scope_key, memory_id from (select scope_key, memory_id, row_number() over (partition by scope_key order by sha256('s1:' || coalesce(scope_key || ':', '') || memory_id), memory_id) as n from memories) where n <= 5")
def k8(t: Store) -> DataFrame:
    from factloom.operators import metrics

    return metrics.hash_sample(t.memories.select("scope_key", "memory_id"), "scope_key", "memory_id", "s1", 5).select("scope_key", "memory_id")


@query("K9_row_cap", "select memory_id from memories where contains(lower(content), 'er') order by importance desc, confidence desc, created_at desc, memory_id limit 40")
def k9(t: Store) -> DataFrame:
    return t.memories.where(F.lower("content").contains("er")).orderBy(F.desc("importance"), F.desc("confidence"), F.desc("created_at"), "memory_id").limit(40).select("memory_id")


@query("U5_holdout_disjoint", "select count(*) as shared from (select memory_id from judged where query_id < 10 intersect select memory_id from judged where query_id >= 10)")
def u5(t: Store) -> DataFrame:
    ids = lambda c: t.judged.where(c).select("memory_id")
    return ids("query_id < 10").intersect(ids("query_id >= 10")).agg(F.count("*").alias("shared"))


@query("U6_coupling_audit", "select (select count(*) from (select memory_id from claims intersect select memory_id from feedback)) as both, (select count(*) from (select memory_id from claims except select memory_id from feedback)) as only_claims")
def u6(t: Store) -> DataFrame:
    a, b = t.claims.select("memory_id").distinct(), t.feedback.select("memory_id").distinct().withColumn("f", F.lit(1))
    return a.join(b, "memory_id", "left").agg(F.count("f").alias("both"), F.count_if(F.col("f").isNull()).alias("only_claims"))


@query("S5_knn_l2", """select query_id, memory_id, round(1 / (1 + distance), 6) as score from (select *, row_number() over (partition by query_id order by round(distance, 9), memory_id) as place from (select a.memory_id as query_id, b.memory_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) * (x[1]::double - x[2]::double)))) as distance
    from vectors a join vectors b on a.memory_id <> b.memory_id where a.memory_id % 20 = 0)) where place <= 10""")
def s5(t: Store) -> DataFrame:
    """The ten nearest of every row whose id is divisible by 20; the queries are copied to each block of vectors."""
    blocks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    asked = t.vectors.where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    rows = t.vectors.select("memory_id", "embedding", F.pmod(F.xxhash64("memory_id"), F.lit(blocks)).cast("int").alias("block"))
    square = F.aggregate(F.zip_with("embedding", "asked", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    found = asked.join(rows, "block").where("memory_id <> query_id").select("query_id", "memory_id", (-F.round(F.sqrt(square), 9)).alias("score"))
    return retrieval.best(found, 10).select("query_id", "memory_id", F.round(1 / (1 - F.col("score")), 6).alias("score"))


@query("S10_import_roundtrip", "select memory_id, title, round(importance, 6) as importance, status from memories")
def s10(t: Store) -> DataFrame:
    from factloom.sources.tables import from_json_lines, json_lines

    rows = t.memories.select("memory_id", "title", "importance", "status")
    back = from_json_lines(json_lines(rows, "memory"), {"memory": rows.schema})["memory"]
    return back.select("memory_id", "title", F.round("importance", 6).alias("importance"), "status")


@query("J4_one_hop", "select distinct query_id, claim_id from (select s.claim_id % 3 as query_id, r.to_id as claim_id from claims s join claim_relations r on r.from_id = s.claim_id union all select s.claim_id % 3, r.from_id from claims s join claim_relations r on r.to_id = s.claim_id)")
def j4(t: Store) -> DataFrame:
    return truth.one_hop(t.claims.select((F.col("claim_id") % 3).alias("query_id"), "claim_id"), t.claim_relations)


@query("J9_first_evidence_per_anchor", "select anchor_id, path, claim_id, memory_id from (select a.anchor_id, a.path, c.claim_id, c.memory_id, row_number() over (partition by a.anchor_id order by c.recorded_at desc, c.claim_id) as n from anchors a join claim_evidence e using (anchor_id) join claims c using (claim_id) join memories m using (memory_id) where m.status = 'active') where n = 1")
def j9(t: Store) -> DataFrame:
    live = t.memories.where("status = 'active'").select("memory_id")
    claims = t.claims.select("claim_id", "memory_id", "recorded_at").join(live, "memory_id", "left_semi")
    first = F.min_by(F.struct("claim_id", "memory_id"), F.struct(-F.unix_micros(F.col("recorded_at").cast("timestamp")), F.col("claim_id"))).alias("first")
    rows = t.claim_evidence.select("anchor_id", "claim_id").join(claims, "claim_id").groupBy("anchor_id").agg(first)
    return t.anchors.select("anchor_id", "path").join(rows, "anchor_id").select("anchor_id", "path", "first.claim_id", "first.memory_id")


@query("J16_review_coverage", "with a as (select case_id, candidate_id from reviews where (case_id + candidate_id) % 9 <> 0), b as (select case_id, candidate_id from reviews where candidate_id % 7 <> 6) select coalesce(a.case_id, b.case_id) as case_id, count(*) filter (a.case_id is not null and b.case_id is not null) as matched, count(*) filter (b.case_id is null) as first_only, count(*) filter (a.case_id is null) as second_only from a full join b on a.case_id = b.case_id and a.candidate_id = b.candidate_id group by 1")
def j16(t: Store) -> DataFrame:
    """Two reviewers, each with gaps: what both saw, and what only one did."""
    one = t.reviews.where("(case_id + candidate_id) % 9 <> 0").select("case_id", "candidate_id", F.lit(True).alias("first"))
    other = t.reviews.where("candidate_id % 7 <> 6").select("case_id", "candidate_id", F.lit(True).alias("second"))
    both = one.join(other, ["case_id", "candidate_id"], "full")
    return both.groupBy("case_id").agg(F.count_if(F.col("first") & F.col("second")).alias("matched"), F.count_if(F.col("second").isNull()).alias("first_only"), F.count_if(F.col("first").isNull()).alias("second_only"))


@query("J20_canary_containment", "select item_id, count(*) as leaks from benchmark b join memories m on contains(lower(m.content), lower(b.text)) where b.text <> '' group by item_id")
def j20(t: Store) -> DataFrame:
    """Whole canaries in whole contents: a canary meets the contents that hold its rarest word."""
    seeds = t.raw("benchmark").where("text <> ''").select("item_id", F.lower("text").alias("term"))
    found = joins.containing(t.memories.select(F.col("memory_id").alias("text_id"), F.lower("content").alias("text")), seeds)
    return seeds.join(found.groupBy("term").agg(F.count("*").alias("leaks")), "term").groupBy("item_id").agg(F.sum("leaks").alias("leaks"))


@query("J21_redirects", "with recursive chase as (select entity_id, entity_id // 2 as target_id from entities where entity_id > 1 union all select c.entity_id, c.target_id // 2 from chase c where c.target_id > 1) select entity_id, min(target_id) as target_id from chase group by entity_id")
def j21(t: Store) -> DataFrame:
    return truth.resolved_redirects(t.entities.where("entity_id > 1").select("entity_id", F.floor(F.col("entity_id") / 2).alias("target_id")))


@query("U4_path_relevance", "select a.anchor_id, case when a.path = b.path then 3 when regexp_extract(a.path, '^(.*)/[^/]*$', 1) = regexp_extract(b.path, '^(.*)/[^/]*$', 1) then 2 when a.symbol_fqn = b.symbol_fqn then 1 else 0 end as relevance from anchors a join anchors b on b.anchor_id = a.anchor_id // 10 * 10")
def u4(t: Store) -> DataFrame:
    """Every anchor against the one that its ten start with."""
    other = t.anchors.select(F.col("anchor_id").alias("asked"), F.col("path").alias("other"), F.col("symbol_fqn").alias("other_symbol"))
    parent = lambda c: text.path_parts(F.col(c))["parent"]
    relevance = F.when(F.col("path") == F.col("other"), 3).when(parent("path") == parent("other"), 2).when(F.col("symbol_fqn") == F.col("other_symbol"), 1).otherwise(0)
    return t.anchors.withColumn("asked", F.floor(F.col("anchor_id") / 10) * 10).join(other, "asked").select("anchor_id", relevance.alias("relevance"))


@query("W8_spread_pick", "with placed as (select memory_id, scope_type, row_number() over (partition by scope_type order by memory_id) - 1 as place, count(*) over (partition by scope_type) - 1 as last from memories) select distinct scope_type, memory_id from placed, (select unnest([0, 1, 2, 3]) as i) where place = round_even(i * last / 3.0::double, 0)")
def w8(t: Store) -> DataFrame:
    """Four of each scope, evenly spread; positions are rounded half to even."""
    placed = t.memories.select("memory_id", "scope_type", (F.row_number().over(Window.partitionBy("scope_type").orderBy("memory_id")) - 1).alias("place"), (F.count("*").over(Window.partitionBy("scope_type")) - 1).alias("last"))
    wanted = F.array(*[F.bround(F.lit(float(i)) * F.col("last") / 3, 0).cast("long") for i in range(4)])
    return placed.where(F.array_contains(wanted, F.col("place").cast("long"))).select("scope_type", "memory_id")


@query("P17_current_version", "select claim_id, version_number from claim_versions where stale_state <> 'stale' and transaction_to is null and valid_from <= timestamp '2001-07-20' and (valid_to is null or timestamp '2001-07-20' < valid_to)")
def p17(t: Store) -> DataFrame:
    rows = t.claim_versions.where("stale_state <> 'stale' and transaction_to is null").where(intervals.holds_at(F.col("valid_from"), F.col("valid_to"), intervals.moment("2001-07-20 00:00:00")))
    return rows.select("claim_id", F.col("version_number").cast("long").alias("version_number"))


@query("J17_preference_pairs", """with better as (select query_id, memory_id, quality from judged where quality = 1), worse as (select query_id, memory_id, row_number() over (partition by query_id order by memory_id) - 1 as place, count(*) over (partition by query_id) as n from judged where quality = 0)
    select b.query_id, b.memory_id as better_id, w.memory_id as worse_id, w.n as choices from better b join worse w on w.query_id = b.query_id and w.place = ('0x' || substr(sha256('pair:' || b.memory_id), 1, 8))::bigint % w.n""")
def j17(t: Store) -> DataFrame:
    """Every better row with one worse row of its query, by a stable number: as many pairs as better rows, never all."""
    worse = t.judged.where("quality = 0").select("query_id", F.col("memory_id").alias("worse_id"), (F.row_number().over(Window.partitionBy("query_id").orderBy("memory_id")) - 1).alias("place"))
    sizes = worse.groupBy("query_id").agg(F.count("*").alias("choices"))
    number = F.conv(F.substring(F.sha2(F.concat(F.lit("pair:"), F.col("better_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    better = t.judged.where("quality = 1").select("query_id", F.col("memory_id").alias("better_id")).join(sizes, "query_id").withColumn("place", number % F.col("choices"))
    return better.join(worse, ["query_id", "place"]).select("query_id", "better_id", "worse_id", "choices")


@query("U2_snapshot_delta", """with d as (select coalesce(a.memory_id, b.memory_id) as memory_id, case when a.memory_id is null then 'added' when b.memory_id is null then 'removed' when a.d <> b.d then 'changed' else 'kept' end as change from (select memory_id, sha256(title) as d from memories where memory_id % 4 <> 0) a full join (select memory_id, sha256(case when memory_id % 6 = 1 then upper(title) else title end) as d from memories where memory_id % 5 <> 0) b on a.memory_id = b.memory_id),
    safe as (select distinct memory_id // 5 as bundle from d join memories using (memory_id) where category = 'constraint' and change <> 'kept') select memory_id, change, change in ('added', 'changed') or (change = 'kept' and memory_id // 5 in (select bundle from safe)) as sent from d""")
def u2(t: Store) -> DataFrame:
    """What changed between two snapshots; a bundle with a changed constraint is sent whole."""
    old = t.memories.where("memory_id % 4 <> 0").select("memory_id", F.sha2("title", 256).alias("digest"))
    new = t.memories.where("memory_id % 5 <> 0").select("memory_id", F.sha2(F.when(F.col("memory_id") % 6 == 1, F.upper("title")).otherwise(F.col("title")), 256).alias("digest"))
    changes = context.delta(old, new, "memory_id", "digest")
    bundles = t.memories.select("memory_id", F.floor(F.col("memory_id") / 5).alias("bundle"), (F.col("category") == "constraint").alias("safety"))
    return context.expanded(changes, bundles, "memory_id")


@query("P18_calibration_guards", "select memory_id, case when created_at > timestamp '2024-02-01' then 'future' when scope_type = 'user' and scope_key <> 'en' then 'cross_scope' when length(title) < 12 or regexp_extract(lower(title), '^[a-z]+', 0) in ('the', 'and', 'of', '') then 'unusable_subject' end as refused from memories")
def p18(t: Store) -> DataFrame:
    """The first guard that refuses a memory as a case: from the future, from another scope, or with a subject that says nothing."""
    first = F.regexp_extract(F.lower("title"), "^[a-z]+", 0)
    refused = F.when(F.col("created_at") > known(), "future").when((F.col("scope_type") == "user") & (F.col("scope_key") != "en"), "cross_scope").when((F.length("title") < 12) | first.isin("the", "and", "of", ""), "unusable_subject")
    return t.memories.select("memory_id", refused.alias("refused"))


@query("S9_export_manifest", """with lines as (select 'memory' as kind, '{"memory_id":' || memory_id || ',"status":"' || status || '"}' as line from memories union all select 'claim', '{"claim_id":' || claim_id || ',"status":"' || status || '"}' from claims union all select 'source', '{"source_id":' || source_id || ',"source_ref":"' || source_ref || '"}' from sources)
    select kind, count(*) as rows, sum(octet_length(encode(line)))::bigint as bytes, cast(sum(('0x' || substr(sha256(line), 1, 15))::bigint) as varchar) as digest from lines group by kind""")
def s9(t: Store) -> DataFrame:
    """A manifest of JSON lines: rows, bytes and a digest of each kind that doesn't depend on the order of lines."""
    from factloom.sources.tables import manifest

    return manifest({"memory": t.memories.select("memory_id", "status"), "claim": t.claims.select("claim_id", "status"), "source": t.sources.select("source_id", "source_ref")})
