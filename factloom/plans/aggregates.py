"""Queries of counts, rollups, health and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import intervals
from factloom.operators import health, metrics, retrieval
from factloom.plans.registry import query
from factloom.sources.model import Store

AT = "2024-06-01 00:00:00"


@query("A1_evidence_count", "select memory_id, count(*) as evidence_count from claims join claim_evidence using (claim_id) group by memory_id")
def a1(t: Store) -> DataFrame:
    return retrieval.evidence_counts(t.claims, t.claim_evidence)


@query("A2_feedback_factor", "select memory_id, count(*) filter (verdict = 'yes') as helpful, count(*) filter (verdict = 'no') as unhelpful, round(greatest(0.5, 1 + least(0.2, 0.03 * count(*) filter (verdict = 'yes')) - least(0.35, 0.06 * count(*) filter (verdict = 'no')))::double, 6) as feedback_factor from feedback group by memory_id")
def a2(t: Store) -> DataFrame:
    return retrieval.feedback_factor(t.feedback).withColumn("feedback_factor", F.round("feedback_factor", 6))


@query("A3_status_counts", "select status, coalesce(n, 0) as n from (select unnest(['active', 'candidate', 'superseded', 'rejected', 'forgotten']) as status) left join (select status, count(*) as n from memories group by status) using (status)")
def a3(t: Store) -> DataFrame:
    return health.counts(t.memories, "status", ["active", "candidate", "superseded", "rejected", "forgotten"])


@query("A4_provenance_rate", "select round(count(s.memory_id) / count(*), 6) as provenance_rate, count(*) as active from memories m left join (select distinct memory_id from claims) s using (memory_id) where m.status = 'active'")
def a4(t: Store) -> DataFrame:
    return health.provenance_rate(t.memories, t.claims).withColumn("provenance_rate", F.round("provenance_rate", 6))


@query("A6_dimensions", "select distinct len(embedding) as dimensions from vectors")
def a6(t: Store) -> DataFrame:
    return t.vectors.select(F.size("embedding").cast("long").alias("dimensions")).distinct()


@query("A7_freshness_rollup", "select memory_id, case when bool_or(stale_state = 'stale') then 'stale' when bool_or(stale_state = 'suspect') then 'suspect' when bool_or(stale_state = 'fresh') then 'fresh' else 'unknown' end as freshness, case when bool_or(status = 'contested') then 'contested' when bool_or(stale_state = 'stale') then 'stale' when bool_or(status = 'accepted') then 'resolved' else 'unknown' end as truth_state from claims group by memory_id")
def a7(t: Store) -> DataFrame:
    return retrieval.freshness_of(t.claims)


@query("A8_truth_rollup", "select truth_state, count(*) as n from (select memory_id, case when bool_or(status = 'contested') then 'contested' when bool_or(stale_state = 'stale') then 'stale' when bool_or(status = 'accepted') then 'resolved' else 'unknown' end as truth_state from claims group by memory_id) group by truth_state")
def a8(t: Store) -> DataFrame:
    return retrieval.freshness_of(t.claims).groupBy("truth_state").agg(F.count("*").alias("n"))


@query("A10_dominant_assertion", "select predicate, object_value, n from (select predicate, object_value, count(*) as n, row_number() over (partition by predicate order by count(*) desc, min(claim_id)) as place from claims group by predicate, object_value) where place = 1")
def a10(t: Store) -> DataFrame:
    from pyspark.sql import Window

    counted = t.claims.groupBy("predicate", "object_value").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("predicate").orderBy(F.desc("n"), "first"))).where("place = 1").select("predicate", "object_value", "n")


@query("A11_source_span", "select predicate, count(*) as sources, round((epoch_us(max(first)) - epoch_us(min(first))) / 86400000000.0::double, 6) as span_days from (select predicate, source_id, min(captured_at) as first from claims join claim_evidence using (claim_id) group by predicate, source_id) group by predicate")
def a11(t: Store) -> DataFrame:
    first = t.claims.select("claim_id", "predicate").join(t.claim_evidence, "claim_id").groupBy("predicate", "source_id").agg(F.min("captured_at").alias("first"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return first.groupBy("predicate").agg(F.count("*").alias("sources"), F.round((micros(F.max("first")) - micros(F.min("first"))) / 86_400_000_000.0, 6).alias("span_days"))


HEALTH = f"""with parts as (select m.memory_id, exp(-greatest(0, epoch_us(timestamp '{AT}') - epoch_us(created_at)) / 86400000000.0::double / 90) as recency, least(1, ln(1 + coalesce(retrieval_count, 0)) / ln(21)) as usage_score, (coalesce(yes, 0) + 1)::double / (coalesce(yes, 0) + coalesce(no, 0) + 2) as votes, coalesce(freshness, 0.55)::double as freshness, importance, confidence, temperature, last_retrieved_at
    from memories m left join health h using (memory_id) left join (select memory_id, case when bool_or(stale_state = 'stale') then 0.0 when bool_or(stale_state = 'suspect') then 0.3 when bool_or(stale_state = 'fresh') then 1.0 else 0.55 end as freshness from claims group by memory_id) f using (memory_id)
    left join (select memory_id, count(*) filter (verdict = 'yes') as yes, count(*) filter (verdict = 'no') as no from feedback group by memory_id) v using (memory_id)), scored as (select *, recency * 0.25 + usage_score * 0.2 + votes * 0.2 + freshness * 0.15 + importance * 0.1 + confidence * 0.1 as score from parts)"""


def healthy(t: Store) -> DataFrame:
    return health.scored(t.memories, t.health, t.claims, t.feedback, intervals.moment(AT))


@query("A14_health_score", f"{HEALTH} select memory_id, round(score, 6) as health_score, case when temperature = 'archived' then 'archived' when round(score, 6) >= 0.75 or (last_retrieved_at is not null and floor(greatest(0, epoch_us(timestamp '{AT}') - epoch_us(last_retrieved_at)) / 86400000000.0::double) <= 7) then 'hot' when round(score, 6) >= 0.45 then 'warm' else 'cold' end as temperature from scored")
def a14(t: Store) -> DataFrame:
    return healthy(t).select("memory_id", "health_score", "temperature")


@query("A15_strongest_component", f"{HEALTH} select memory_id, case greatest(recency, usage_score, votes, freshness, importance, confidence) when recency then 'recency' when usage_score then 'usage' when votes then 'feedback' when freshness then 'freshness' when importance then 'importance' else 'confidence' end as strongest, case least(recency, usage_score, votes, freshness, importance, confidence) when recency then 'recency' when usage_score then 'usage' when votes then 'feedback' when freshness then 'freshness' when importance then 'importance' else 'confidence' end as weakest from scored")
def a15(t: Store) -> DataFrame:
    return healthy(t).select("memory_id", "strongest", "weakest")


@query("D3_health_listing", f"{HEALTH} select memory_id, round(score, 6) as health_score from scored where temperature is distinct from 'archived' order by round(score, 6) desc, memory_id limit 20")
def d3(t: Store) -> DataFrame:
    return healthy(t).where("temperature <> 'archived'").orderBy(F.desc("health_score"), "memory_id").limit(20).select("memory_id", "health_score")


@query("A17_whole_sums", "select task_id, count(*) as requests, cast(sum(input_tokens) as bigint) as input_tokens, case when count(*) = count(cache_hit_tokens) then cast(sum(cache_hit_tokens) as bigint) end as cache_hit_tokens, cast(sum(output_tokens) as bigint) as output_tokens, round(sum(latency_seconds), 6) as latency_seconds from usage group by task_id")
def a17(t: Store) -> DataFrame:
    return metrics.usage_totals(t.usage, ["task_id"]).withColumn("latency_seconds", F.round("latency_seconds", 6))


PRICES = [("alpha", "2.5", "0.25", "10"), ("beta", "1.1", None, "4.4"), ("gamma", "3", "3", "15")]


@query("A18_cost", """with p as (select * from (values ('alpha', 2.5, 0.25, 10.0), ('beta', 1.1, null, 4.4), ('gamma', 3.0, 3.0, 15.0)) v(provider, miss, hit, out_price)) select run_id, round(cast(case when cache_hit_tokens is not null then case when hit is not null then (input_tokens - cache_hit_tokens) * miss + cache_hit_tokens * hit end
    when hit is null or hit = miss then input_tokens * miss end + output_tokens * out_price as double) / 1000000, 9) as cost_usd from usage left join p using (provider)""")
def a18(t: Store) -> DataFrame:
    prices = t.spark.createDataFrame(PRICES, "provider string, miss string, hit string, output string").selectExpr("provider", "cast(miss as decimal(12,6)) as miss", "cast(hit as decimal(12,6)) as hit", "cast(output as decimal(12,6)) as output")
    return metrics.costed(t.usage, prices).select("run_id", F.round(F.col("cost_usd").cast("double"), 9).alias("cost_usd"))


@query("A19_condition_summary", "select condition, count(*) as runs, round(avg(input_tokens), 6) as mean_input, count(*) filter (success) as successes from usage group by condition")
def a19(t: Store) -> DataFrame:
    return t.usage.groupBy("condition").agg(F.count("*").alias("runs"), F.round(F.avg("input_tokens"), 6).alias("mean_input"), F.count_if("success").alias("successes"))


@query("A20_condition_phase", "select condition, cache_phase, count(*) as runs, round(avg(latency_seconds), 6) as mean_latency from usage group by condition, cache_phase")
def a20(t: Store) -> DataFrame:
    return t.usage.groupBy("condition", "cache_phase").agg(F.count("*").alias("runs"), F.round(F.avg("latency_seconds"), 6).alias("mean_latency"))


@query("A21_worst_groups", "select dimension, value, n, round(rate, 6) as rate from (select case when grouping(provider) = 0 then 'provider' when grouping(cache_phase) = 0 then 'cache_phase' else 'condition' end as dimension, coalesce(provider, cache_phase, condition) as value, count(*) as n, avg(success::int) as rate from usage group by grouping sets ((provider), (cache_phase), (condition))) where n >= 10")
def a21(t: Store) -> DataFrame:
    # One pass: each row counts once for each of its slices.
    slices = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("provider", "cache_phase", "condition")])
    return t.usage.select("success", F.inline(slices)).groupBy("dimension", "value").agg(F.count("*").alias("n"), F.round(F.avg(F.col("success").cast("int")), 6).alias("rate")).where("n >= 10")


@query("A22_macro_average", "select round(avg(m), 6) as macro from (select task_id, avg(success::int) as m from usage group by task_id)")
def a22(t: Store) -> DataFrame:
    return t.usage.groupBy("task_id").agg(F.avg(F.col("success").cast("int")).alias("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


@query("A23_nearest_rank", "select condition, percentile_disc(0.95) within group (order by latency_seconds) as value from usage group by condition")
def a23(t: Store) -> DataFrame:
    return metrics.nearest_rank(t.usage, ["condition"], "latency_seconds", 0.95)


@query("A24_median_reduction", "select round(median(1 - treatment / baseline), 6) as reduction from (select task_id, avg(case when condition = 'baseline' then input_tokens end) as baseline, avg(case when condition = 'treatment' then input_tokens end) as treatment from usage group by task_id) where baseline is not null and treatment is not null")
def a24(t: Store) -> DataFrame:
    pairs = metrics.paired(t.usage, "task_id", "condition", "input_tokens", "baseline", "treatment")
    return pairs.agg(F.round(F.median(1 - F.try_divide("treatment", "baseline")), 6).alias("reduction"))


@query("A36_tokens_per_success", "select condition, round(sum(input_tokens + output_tokens) / nullif(count(*) filter (success), 0), 6) as tokens_per_success from usage group by condition")
def a36(t: Store) -> DataFrame:
    return t.usage.groupBy("condition").agg(F.round(F.try_divide(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.count_if("success")), 6).alias("tokens_per_success"))


@query("A38_best_evidence", "select source_id, arg_max(evidence_id, (support_weight, captured_at, evidence_id)) as evidence_id from claim_evidence group by source_id")
def a38(t: Store) -> DataFrame:
    return t.claim_evidence.groupBy("source_id").agg(F.max_by("evidence_id", F.struct("support_weight", "captured_at", "evidence_id")).alias("evidence_id"))


@query("M18_relative_weights", "select condition, round(w / sum(w) over (), 6) as share from (select condition, sum(output_tokens) as w from usage group by condition)")
def m18(t: Store) -> DataFrame:
    totals = t.usage.groupBy("condition").agg(F.sum("output_tokens").alias("w"))
    return totals.join(F.broadcast(totals.agg(F.sum("w").alias("all")))).select("condition", F.round(F.coalesce(F.try_divide("w", "all"), F.lit(0.5)), 6).alias("share"))


@query("D1_feedback_guard", "select verdict, count(*) as accepted from feedback where memory_id in (select memory_id from memories where status = 'active') group by verdict")
def d1(t: Store) -> DataFrame:
    return t.feedback.join(t.memories.where("status = 'active'"), "memory_id", "left_semi").groupBy("verdict").agg(F.count("*").alias("accepted"))


@query("A5_latest", "select a.memory_id, last_event, last_at, coalesce(version, 0) as version from (select memory_id, max(event_id) as last_event, max(ts) as last_at from audit_events group by memory_id) a left join (select memory_id, max(version_number) as version from claim_versions group by memory_id) v using (memory_id)")
def a5(t: Store) -> DataFrame:
    events = t.audit_events.groupBy("memory_id").agg(F.max("event_id").alias("last_event"), F.max("ts").alias("last_at"))
    versions = t.claim_versions.groupBy("memory_id").agg(F.max("version_number").cast("long").alias("version"))
    return events.join(versions, "memory_id", "left").na.fill(0, ["version"])


PRICE_LIST = [("alpha", "m0", 1.0), ("alpha", "m1", 1.5), ("beta", "m0", 2.0), ("gamma", "m2", 3.0)]


@query("J19_price_lookup", f"with prices as (select * from (values {', '.join(f"('{p}', '{m}', {x}::double)" for p, m, x in PRICE_LIST)}) v(provider, model, price)), runs as (select provider, 'm' || (run_id % 3) as model from usage) select r.provider, r.model, count(*) as runs, count(price) as priced, max(price) as price from runs r left join prices p on p.provider = r.provider and p.model = r.model group by r.provider, r.model")
def j19(t: Store) -> DataFrame:
    """Prices by provider and model; what the list doesn't have stays without one."""
    prices = t.spark.createDataFrame(PRICE_LIST, "provider string, model string, price double")
    runs = t.usage.select("provider", F.concat(F.lit("m"), (F.col("run_id") % 3).cast("string")).alias("model"))
    return runs.join(prices, ["provider", "model"], "left").groupBy("provider", "model").agg(F.count("*").alias("runs"), F.count("price").alias("priced"), F.max("price").alias("price"))
