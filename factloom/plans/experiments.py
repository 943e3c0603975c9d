"""Queries of evaluation: ranking and agreement metrics, experiments, juries and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import metrics
from factloom.plans.registry import query
from factloom.sources.model import Store

RANKED = "ranked as (select query_id, memory_id, row_number() over (partition by query_id order by sha256('rank:' || memory_id), memory_id) as rank, quality, toxic from judged)"


def ranked(t: Store) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.sha2(F.concat(F.lit("rank:"), F.col("memory_id").cast("string")), 256), "memory_id")
    return t.judged.withColumn("rank", F.row_number().over(order))


@query("A25_ranking_metrics", f"with {RANKED}, g as (select query_id, memory_id from judged where quality = 0), s as (select query_id, count(*) as gold from g group by query_id), hits as (select r.query_id, rank from ranked r join g using (query_id, memory_id)), d as (select query_id, count(*) filter (rank <= 5) as found, min(rank) as first, coalesce(sum(case when rank <= 10 then 1 / log2(rank + 1) end), 0) as dcg from hits group by query_id) select query_id, round(coalesce(found, 0) / gold, 6) as recall, round(coalesce(1.0 / first, 0), 6) as reciprocal_rank, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, gold) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg from s left join d using (query_id)")
def a25(t: Store) -> DataFrame:
    out = metrics.ranking(ranked(t), t.judged.where("quality = 0"))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query("A26_graded_ndcg", f"with {RANKED}, r as (select query_id, rank, quality * 2 + toxic as relevance, toxic = 1 as required, row_number() over (partition by query_id order by quality * 2 + toxic desc, rank) as ideal from ranked) select query_id, round(sum(case when rank <= 10 then (pow(2, relevance) - 1) / log2(rank + 1) else 0 end) / nullif(sum(case when ideal <= 10 then (pow(2, relevance) - 1) / log2(ideal + 1) else 0 end), 0), 6) as ndcg, round(count(*) filter (required and rank <= 5) / nullif(count(*) filter (required), 0), 6) as required_recall from r group by query_id")
def a26(t: Store) -> DataFrame:
    rows = ranked(t).withColumns({"relevance": F.col("quality") * 2 + F.col("toxic"), "required": F.col("toxic") == 1})
    return metrics.graded(rows).select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("required_recall", 6).alias("required_recall"))


@query("A27_classification", "with c as (select first_relevance as e, second_relevance as p, count(*) as n from reviews group by e, p), l as (select unnest([0, 1, 2, 3]) as label), s as (select label, sum(n) filter (e = label and p = label) as tp, sum(n) filter (p = label) as pp, sum(n) filter (e = label) as ep from l, c group by label) select cast(label as bigint) as label, round(coalesce(tp, 0) / pp, 6) as precision, round(coalesce(tp, 0) / ep, 6) as recall, round(2 * coalesce(tp, 0) / (pp + ep), 6) as f1 from s")
def a27(t: Store) -> DataFrame:
    return metrics.classification(t.reviews, "first_relevance", "second_relevance").select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


KAPPA = "with c as (select first_relevance as l, second_relevance as r, count(*) as n from reviews group by l, r), t as (select sum(n) as total from c), a as (select l, sum(n) as nl from c group by l), b as (select r, sum(n) as nr from c group by r) select cast(total as bigint) as total, round(1 - (select sum(n * {d}) from c) / total, 6) as agreement, round(1 - ((select sum(n * {d}) from c) / total) / ((select sum(nl * nr * {d}) from a, b) / (total * total)), 6) as kappa from t"


def _kappa(t: Store, weight: str) -> DataFrame:
    return metrics.kappa(t.reviews, "first_relevance", "second_relevance", weight=weight, categories=4).select("total", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("A28_cohen_kappa", KAPPA.format(d="(l <> r)::int"))
def a28(t: Store) -> DataFrame:
    return _kappa(t, "none")


@query("A29_linear_kappa", KAPPA.format(d="abs(l - r) / 3.0::double"))
def a29(t: Store) -> DataFrame:
    return _kappa(t, "linear")


@query("A29_quadratic_kappa", KAPPA.format(d="pow(abs(l - r) / 3.0::double, 2)"))
def a29q(t: Store) -> DataFrame:
    return _kappa(t, "quadratic")


@query("A30_confusion", "select first_relevance, second_relevance, count(*) as n from reviews group by first_relevance, second_relevance")
def a30(t: Store) -> DataFrame:
    return metrics.confusion(t.reviews, "first_relevance", "second_relevance")


@query("A33_sample_size", "select cache_phase, provider, case when abs(effect) > 0 then cast(ceil(round(pow(2.8015852189 * spread / effect, 2), 6)) as bigint) end as n from (select cache_phase, provider, avg(latency_seconds) filter (condition = 'treatment') - avg(latency_seconds) filter (condition = 'baseline') as effect, stddev_samp(latency_seconds) as spread from usage group by cache_phase, provider)")
def a33(t: Store) -> DataFrame:
    """Pairs needed to see each group's difference of means, from its own spread."""
    mean = lambda c: F.avg(F.when(F.col("condition") == c, F.col("latency_seconds")))
    found = t.usage.groupBy("cache_phase", "provider").agg((mean("treatment") - mean("baseline")).alias("effect"), F.stddev_samp("latency_seconds").alias("spread"))
    return found.select("cache_phase", "provider", F.when(F.abs("effect") > 0, metrics.sample_sizes(F.col("effect"), F.col("spread"))).alias("n"))


JUDGES = "votes as (select l_orderkey as comparison_id, l_linenumber % 3 as judge_id, case l_linenumber % 3 when 0 then 'f1' when 1 then 'f2' else 'f2' end as family, l_linenumber // 3 % 2 as presentation, case l_partkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'tie' else 'abstain' end as preference, l_discount * 5 as confidence from lineitem)"


def votes(t: Store) -> DataFrame:
    return t.raw("lineitem").selectExpr("l_orderkey as comparison_id", "l_linenumber % 3 as judge_id", "case l_linenumber % 3 when 0 then 'f1' else 'f2' end as family", "cast(floor(l_linenumber / 3) as int) % 2 as presentation", "case l_partkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'tie' else 'abstain' end as preference", "l_discount * 5 as confidence")


@query("A34_jury", f"""with {JUDGES}, j as (select comparison_id, judge_id, family, count(*) = 2 and count(distinct presentation) = 2 as complete, min(preference) as low, max(preference) as high, bool_or(preference = 'abstain') as abstains, greatest(min(confidence), 0.05) as w from votes group by comparison_id, judge_id, family),
    f as (select comparison_id, family, coalesce(sum(w) filter (low = 'a'), 0) / sum(w) as a, coalesce(sum(w) filter (low = 'b'), 0) / sum(w) as b, coalesce(sum(w) filter (low = 'tie'), 0) / sum(w) as tie from j where complete and not abstains and low = high group by comparison_id, family), s as (select comparison_id, sum(a) as a, sum(b) as b, sum(tie) as tie, count(*) as families from f group by comparison_id)
    select e.comparison_id, judges, complete, coalesce(families, 0) as families, round((coalesce(a, 0) + 0.25) / (coalesce(a, 0) + coalesce(b, 0) + coalesce(tie, 0) + 0.75), 6) as p_a from (select comparison_id, count(*) as judges, count(*) filter (complete) as complete from j group by comparison_id) e left join s using (comparison_id)""")
def a34(t: Store) -> DataFrame:
    return metrics.jury(votes(t)).select("comparison_id", "judges", "complete", "families", F.round("p_a", 6).alias("p_a"))


@query("A35_ablation_effect", "select effect, count(*) as n from (select task_id, case when treatment > baseline then 'helped' when treatment < baseline then 'harmed' else 'unchanged' end as effect from (select task_id, avg(success::int) filter (condition = 'baseline') as baseline, avg(success::int) filter (condition = 'treatment') as treatment from usage group by task_id) where baseline is not null and treatment is not null) group by effect")
def a35(t: Store) -> DataFrame:
    pairs = metrics.paired(t.usage.withColumn("won", F.col("success").cast("int")), "task_id", "condition", "won", "baseline", "treatment")
    effect = F.when(F.col("treatment") > F.col("baseline"), "helped").when(F.col("treatment") < F.col("baseline"), "harmed").otherwise("unchanged")
    return pairs.select(effect.alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))


@query("A39_paired_tasks", "select task_id, round(baseline, 6) as baseline, round(treatment, 6) as treatment, round(treatment - baseline, 6) as difference from (select task_id, avg(latency_seconds) filter (condition = 'baseline') as baseline, avg(latency_seconds) filter (condition = 'treatment') as treatment from usage group by task_id) where baseline is not null and treatment is not null")
def a39(t: Store) -> DataFrame:
    pairs = metrics.paired(t.usage, "task_id", "condition", "latency_seconds", "baseline", "treatment")
    return pairs.select("task_id", *[F.round(c, 6).alias(c) for c in ("baseline", "treatment", "difference")])


@query("J15_matched_pairs", "select provider, count(*) as pairs from (select task_id, provider from usage group by task_id, provider having count(distinct condition) = 2) group by provider")
def j15(t: Store) -> DataFrame:
    both = t.usage.groupBy("task_id", "provider").agg(F.count_distinct("condition").alias("n")).where("n = 2")
    return both.groupBy("provider").agg(F.count("*").alias("pairs"))


def preferences(t: Store) -> DataFrame:
    """Judged rows as differences from a middling memory, with a split by hash."""
    rows = t.judged.join(t.memories, "memory_id").select("memory_id", "scope_type", (F.col("importance") - 0.45).alias("importance"), (F.col("confidence") - 0.7).alias("confidence"), F.col("quality").alias("label"))
    return metrics.hash_split(rows, "memory_id", "fit")


@query("L1_pairwise_fit")
def l1(t: Store) -> DataFrame:
    """Weights at the penalty that serves the dev rows best."""
    best = metrics.fold_fits(preferences(t), ["importance", "confidence"], dev=F.col("split") != "train")
    rows = [(f, b["penalty"], w) for b in best for f, w in zip(("importance", "confidence"), b["weights"], strict=True)]
    return t.spark.createDataFrame(rows, "feature string, penalty double, weight double")


@query("L3_losses", "with r as (select query_id, quality, greatest(1e-12, least(1 - 1e-12, 0.05 + 0.9 * (memory_id % 10) / 10.0::double)) as p, 1 + memory_id % 3 as w from judged) select query_id, round(sum(w * -(quality * ln(p) + (1 - quality) * ln(1 - p))) / sum(w), 6) as log_loss, round(sum(w * pow(p - quality, 2)) / sum(w), 6) as brier, round(sum(w * ((p >= 0.5)::int = quality)::int) / sum(w), 6) as accuracy from r group by query_id")
def l3(t: Store) -> DataFrame:
    rows = t.judged.withColumns({"p": 0.05 + 0.9 * (F.col("memory_id") % 10) / 10, "w": 1 + F.col("memory_id") % 3})
    return metrics.probability_losses(rows, "p", "quality", "w", ["query_id"]).select("query_id", *[F.round(c, 6).alias(c) for c in ("log_loss", "brier", "accuracy")])


@query("L10_usage_guard", "select task_id, alpha > 1.3 * greatest(beta, gamma) as over from (select task_id % 50 as task_id, sum(input_tokens) filter (provider = 'alpha') as alpha, sum(input_tokens) filter (provider = 'beta') as beta, sum(input_tokens) filter (provider = 'gamma') as gamma from usage group by task_id % 50) where alpha is not null and beta is not null and gamma is not null")
def l10(t: Store) -> DataFrame:
    arm = lambda p: F.sum(F.when(F.col("provider") == p, F.col("input_tokens"))).alias(p)
    rows = t.usage.groupBy((F.col("task_id") % 50).alias("task_id")).agg(arm("alpha"), arm("beta"), arm("gamma")).where("alpha is not null and beta is not null and gamma is not null")
    return rows.select("task_id", (F.col("alpha") > 1.3 * F.greatest("beta", "gamma")).alias("over"))


@query("M5_disagreement", "select case_id, candidate_id from reviews where first_relevance is distinct from second_relevance or first_label is distinct from second_label")
def m5(t: Store) -> DataFrame:
    same = F.col("first_relevance").eqNullSafe(F.col("second_relevance")) & F.col("first_label").eqNullSafe(F.col("second_label"))
    return t.reviews.where(~same).select("case_id", "candidate_id")


@query("M9_protocol", "select task_id, count(distinct condition) = 2 as complete, count(distinct provider) = 1 as one_provider from usage group by task_id")
def m9(t: Store) -> DataFrame:
    return t.usage.groupBy("task_id").agg((F.count_distinct("condition") == 2).alias("complete"), (F.count_distinct("provider") == 1).alias("one_provider"))


@query("M13_usage_mapping", "select run_id, case when hit + miss = input_tokens then hit end as hit, case when hit + miss = input_tokens then miss end as miss from (select run_id, input_tokens, cache_hit_tokens as hit, case when run_id % 4 <> 1 then input_tokens - cache_hit_tokens end as miss from usage)")
def m13(t: Store) -> DataFrame:
    """Providers' payloads under either name of a figure; cache figures count where they add up to the whole."""
    miss = F.when(F.col("run_id") % 4 != 1, F.col("input_tokens") - F.col("cache_hit_tokens"))
    one = F.struct(F.col("input_tokens").alias("prompt_tokens"), F.col("cache_hit_tokens").alias("prompt_cache_hit_tokens"), miss.alias("prompt_cache_miss_tokens"))
    other = F.struct("input_tokens", F.col("cache_hit_tokens").alias("cache_read"), miss.alias("prompt_cache_miss_tokens"))
    rows = t.usage.select("run_id", F.when(F.col("provider") == "alpha", F.to_json(one)).otherwise(F.to_json(other)).alias("payload"))
    number = lambda *names: F.coalesce(*[F.get_json_object("payload", f"$.{n}").cast("long") for n in names])
    out = rows.withColumns({"total": number("prompt_tokens", "input_tokens"), "hit": number("prompt_cache_hit_tokens", "cache_read"), "miss": number("prompt_cache_miss_tokens")})
    fits = (F.col("hit") + F.col("miss")) == F.col("total")
    return out.select("run_id", F.when(fits, F.col("hit")).alias("hit"), F.when(fits, F.col("miss")).alias("miss"))


@query("L4_bradley_terry")
def l4(t: Store) -> DataFrame:
    """Utilities of each reviewed case's candidates, from both reviewers' relevance of every two of them: a tie is half a win."""
    seen = t.reviews.select("case_id", "candidate_id", F.explode(F.array(F.struct(F.lit(1).alias("judge"), F.col("first_relevance").alias("relevance")), F.struct(F.lit(2).alias("judge"), F.col("second_relevance").alias("relevance")))).alias("v")).select("case_id", "candidate_id", "v.*")
    other = seen.select("case_id", "judge", F.col("candidate_id").alias("b_id"), F.col("relevance").alias("b"))
    met = seen.join(other, ["case_id", "judge"]).where("candidate_id < b_id and relevance is not null and b is not null")  # a case has few candidates
    a, b = F.col("relevance"), F.col("b")
    results = met.select(F.col("case_id").alias("query_id"), F.col("candidate_id").alias("a_id"), "b_id", F.when(a > b, 1.0).otherwise(0.0).alias("p_a"), F.when(a == b, 1.0).otherwise(0.0).alias("p_tie"), F.lit(1.0).alias("weight"))
    return metrics.bradley_terry(results).withColumn("utility", F.round("utility", 6))


@query("L7_hash_split", "with ranked as (select subject, row_number() over (order by sha256('split:' || subject)) - 1 as place, count(*) over () as n from (select distinct subject from memories)) select memory_id, case when place < round_even(n * 0.6::double, 0) then 'train' when place < round_even(n * 0.8::double, 0) then 'dev' else 'test' end as split from memories join ranked using (subject)")
def l7(t: Store) -> DataFrame:
    """Whole repositories go to train, dev and test, by the order of their digests."""
    return t.memories.select("memory_id", "subject").join(metrics.ranked_split(t.memories.select("subject").distinct(), "subject", "split"), "subject").select("memory_id", "split")


@query("L8_adjudication", "with marked as (select *, case first_label when 'N' then 0 when 'A' then 1 else 2 end as x, case second_label when 'O' then 0 else 2 end as y from reviews) select case_id, candidate_id, least(first_relevance, second_relevance) as relevance, ['clear', 'caution', 'unsafe'][greatest(x, y) + 1] as label, first_relevance > 1 and second_relevance > 1 as required from marked")
def l8(t: Store) -> DataFrame:
    """The lower relevance, the graver label by a stated order, and required only if both say so."""
    first = F.when(F.col("first_label") == "N", 0).when(F.col("first_label") == "A", 1).otherwise(2)
    second = F.when(F.col("second_label") == "O", 0).otherwise(2)
    label = F.array(F.lit("clear"), F.lit("caution"), F.lit("unsafe"))[F.greatest(first, second)]
    return t.reviews.select("case_id", "candidate_id", F.least("first_relevance", "second_relevance").alias("relevance"), label.alias("label"), ((F.col("first_relevance") > 1) & (F.col("second_relevance") > 1)).alias("required"))


@query("M7_blind_assignment", """with own as (select distinct case_id, candidate_id from reviews), placed as (select *, count(*) over (partition by case_id) as n, row_number() over (partition by case_id order by sha256('r1:' || candidate_id), candidate_id) as first, row_number() over (partition by case_id order by sha256('r2:' || candidate_id), candidate_id) as other from own),
    same as (select case_id, bool_and(first = other) as same from placed group by case_id) select case_id, candidate_id, first as first_place, case when same and n > 1 then other % n + 1 else other end as second_place from placed join same using (case_id)""")
def m7(t: Store) -> DataFrame:
    """Each reviewer has an order of their own; where both are the same, the second is turned by one."""
    from pyspark.sql import Window

    order = lambda who: F.row_number().over(Window.partitionBy("case_id").orderBy(F.sha2(F.concat(F.lit(f"{who}:"), F.col("candidate_id").cast("string")), 256), "candidate_id"))
    case = Window.partitionBy("case_id")
    rows = t.reviews.select("case_id", "candidate_id").distinct().select("case_id", "candidate_id", order("r1").alias("first"), order("r2").alias("other"), F.count("*").over(case).alias("n"))
    rows = rows.withColumn("same", F.bool_and(F.col("first") == F.col("other")).over(case))
    second = F.when(F.col("same") & (F.col("n") > 1), F.col("other") % F.col("n") + 1).otherwise(F.col("other"))
    return rows.select("case_id", "candidate_id", F.col("first").cast("long").alias("first_place"), second.cast("long").alias("second_place"))


@query("M4_swap_agreement", f"with {JUDGES} select comparison_id, judge_id, count(*) as orders, count(distinct presentation) = 2 and min(preference) = max(preference) as agrees from votes group by comparison_id, judge_id")
def m4(t: Store) -> DataFrame:
    """A judge agrees with itself if it prefers the same when the two are shown the other way round."""
    agrees = (F.count_distinct("presentation") == 2) & (F.min("preference") == F.max("preference"))
    return votes(t).groupBy("comparison_id", "judge_id").agg(F.count("*").alias("orders"), agrees.alias("agrees"))


@query("L5_gates", "select provider, concat_ws(',', case when runs < 100 then 'enough_runs' end, case when rate < 0.3 then 'success_rate' end, case when missing > 0.2 then 'missing_share' end, case when slow > 100 then 'latency' end, case when phases < 2 then 'both_phases' end) as failed from (select provider, count(*) as runs, avg(success::int) as rate, avg((cache_hit_tokens is null)::int) as missing, quantile_disc(latency_seconds, 0.5) as slow, count(distinct cache_phase) as phases from usage group by provider)")
def l5(t: Store) -> DataFrame:
    rows = t.usage.groupBy("provider").agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("rate"), F.avg(F.col("cache_hit_tokens").isNull().cast("int")).alias("missing"), F.expr("percentile_disc(0.5) within group (order by latency_seconds)").alias("slow"), F.count_distinct("cache_phase").alias("phases")
    )
    rules = {"enough_runs": F.col("runs") >= 100, "success_rate": F.col("rate") >= 0.3, "missing_share": F.col("missing") <= 0.2, "latency": F.col("slow") <= 100, "both_phases": F.col("phases") >= 2}
    return metrics.gate(rows, rules).select("provider", "failed")


@query("M12_before_after", "select cache_phase, provider, count(*) filter (condition = 'baseline') as runs_before, count(*) filter (condition = 'treatment') as runs_after, count(*) filter (cache_hit_tokens is null) as missing, cast(sum(input_tokens) filter (condition = 'baseline') as bigint) as before, cast(sum(input_tokens) filter (condition = 'treatment') as bigint) as after, round(sum(input_tokens) filter (condition = 'treatment') / sum(input_tokens) filter (condition = 'baseline') - 1, 6) as change from usage group by cache_phase, provider")
def m12(t: Store) -> DataFrame:
    """Tokens before and after for each phase and provider, with how many runs each side has and how many lack a figure."""
    side = lambda c: F.sum(F.when(F.col("condition") == c, F.col("input_tokens")))
    runs = lambda c: F.count_if(F.col("condition") == c)
    out = t.usage.groupBy("cache_phase", "provider").agg(runs("baseline").alias("runs_before"), runs("treatment").alias("runs_after"), F.count_if(F.col("cache_hit_tokens").isNull()).alias("missing"), side("baseline").alias("before"), side("treatment").alias("after"))
    return out.withColumn("change", F.round(F.try_divide("after", "before") - 1, 6))


@query("M14_rank_direction", f"with {RANKED}, other as (select query_id, memory_id, row_number() over (partition by query_id order by sha256('new:' || memory_id), memory_id) as place from judged) select r.query_id, r.memory_id, cast(sign(rank - place) as int) as direction from ranked r join other o on o.query_id = r.query_id and o.memory_id = r.memory_id where toxic = 1")
def m14(t: Store) -> DataFrame:
    """Whether a marked row rises (1), falls (-1) or stays from one ranking of its query to another."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.sha2(F.concat(F.lit("new:"), F.col("memory_id").cast("string")), 256), "memory_id"))
    other = t.judged.select("query_id", "memory_id", place.alias("place"))
    return ranked(t).where("toxic = 1").join(other, ["query_id", "memory_id"]).select("query_id", "memory_id", F.signum(F.col("rank") - F.col("place")).cast("int").alias("direction"))


def resampling_sql(stratum: str, value: str = "latency_seconds") -> str:
    """Resampling by places that follow from stratum, draw and round, as metrics.resampled does: for any number of pairs."""
    p, (a, b, c, _) = metrics.PRIME, metrics.FACTORS
    fifth = lambda x: f"((({x} * {x}) % {p}) * (({x} * {x}) % {p}) % {p} * {x} % {p})"
    return f"""with pairs as (select task_id, {stratum} as stratum, t - b as difference from (select task_id, min(provider) as provider, avg({value}) filter (condition = 'baseline') as b, avg({value}) filter (condition = 'treatment') as t from usage group by task_id) where b is not null and t is not null),
    places as (select stratum, difference, row_number() over (partition by stratum order by task_id) - 1 as place, count(*) over (partition by stratum) as n, ('0x' || substr(md5(stratum), 1, 7))::bigint as salt from pairs),
    keys as (select stratum, n, (place * {a} + salt * {c} + 7) % {p} as x from places), numbers as (select stratum, n, number, ({fifth('x')} + number * {b}) % {p} as y from keys, (select unnest(range(1, 4001)) as number)),
    drawn as (select stratum, number, {fifth('y')} % n as place from numbers),
    means as (select number, avg(m) as mean from (select d.number, d.stratum, avg(difference) as m from drawn d join places p on p.stratum = d.stratum and p.place = d.place group by d.number, d.stratum) group by number),
    ordered as (select list_sort(list(mean)) as means, avg((mean > 0)::int) as improvement from means)
    select round((select avg(m) from (select avg(difference) as m from pairs group by stratum)), 6) as difference, round(means[101], 6) as low, round(means[3901], 6) as high, round(means[201], 6) as one_sided_low, round(improvement, 6) as improvement from ordered"""


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.round(c, 6).alias(c) for c in ("difference", "low", "high", "one_sided_low", "improvement")])


@query("A31_paired_bootstrap", resampling_sql("''"))
def a31(t: Store) -> DataFrame:
    pairs = metrics.paired(t.usage, "task_id", "condition", "latency_seconds", "baseline", "treatment")
    return rounded(metrics.resampled(pairs, "task_id", None, 7))


@query("A32_stratified_bootstrap", resampling_sql("provider"))
def a32(t: Store) -> DataFrame:
    """One interval of the mean over providers."""
    pairs = metrics.paired(t.usage, "task_id", "condition", "latency_seconds", "baseline", "treatment", "provider")
    return rounded(metrics.resampled(pairs, "task_id", "provider", 7))


@query("M11_complete_pairs", resampling_sql("''", "cache_hit_tokens").replace("select round((select", "select (select count(*) from pairs) as pairs, round((select"))
def m11(t: Store) -> DataFrame:
    """Tasks whose both arms have the figure, with the interval of their difference."""
    pairs = metrics.paired(t.usage, "task_id", "condition", "cache_hit_tokens", "baseline", "treatment")
    return rounded(metrics.resampled(pairs, "task_id", None, 7)).join(pairs.agg(F.count("*").alias("pairs")))


@query("A37_threshold_grid", "with pairs as (select task_id, t - b as difference from (select task_id, avg(latency_seconds) filter (condition = 'baseline') as b, avg(latency_seconds) filter (condition = 'treatment') as t from usage group by task_id) where b is not null and t is not null) select threshold, count(*) as pairs, count(*) filter (difference <= threshold) as within_threshold, round(avg((difference <= threshold)::int), 6) as share from pairs, (select unnest([-100.0, -20.0, 0.0, 20.0, 100.0])::double as threshold) group by threshold")
def a37(t: Store) -> DataFrame:
    """How many pairs stay within each threshold of the difference."""
    pairs = metrics.paired(t.usage, "task_id", "condition", "latency_seconds", "baseline", "treatment")
    grid = pairs.select("difference", F.explode(F.array(*[F.lit(x) for x in (-100.0, -20.0, 0.0, 20.0, 100.0)])).alias("threshold"))
    within = F.col("difference") <= F.col("threshold")
    return grid.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_if(within).alias("within_threshold"), F.round(F.avg(within.cast("int")), 6).alias("share"))
