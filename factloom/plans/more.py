"""Queries of the remaining operators: pool features, entity matching, context parts, studies and providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import intervals, plain, providers, text
from factloom.operators import claims as truth
from factloom.operators import context, joins, metrics, retrieval
from factloom.plans.registry import query
from factloom.plans.retrieval import BM25, COSINE, ELIGIBLE, FUSED, channels, eligible, lexical, semantic
from factloom.sources import vectors
from factloom.sources.model import Store
from factloom.sources.shared import kept_path


def valid():
    return intervals.moment("1997-06-01 00:00:00")


@query("J5_versions_identities", "select identity_id, count(*) as open_versions from claim_versions where transaction_to is null group by identity_id")
def j5(t: Store) -> DataFrame:
    return t.claim_versions.where("transaction_to is null").groupBy("identity_id").agg(F.count("*").alias("open_versions"))


@query("J8_consolidation_join", "select c.predicate, count(*) as episodes, count(distinct s.source_ref) as sources from claims c join memories m using (memory_id) join claim_evidence e using (claim_id) join sources s using (source_id) where m.memory_type = 'episodic' and m.status = 'active' group by c.predicate")
def j8(t: Store) -> DataFrame:
    own = t.memories.where("memory_type = 'episodic' and status = 'active'").select("memory_id")
    rows = t.claims.select("claim_id", "memory_id", "predicate").join(own, "memory_id", "left_semi").join(t.claim_evidence.select("claim_id", "source_id"), "claim_id").join(t.sources, "source_id")
    return rows.groupBy("predicate").agg(F.count("*").alias("episodes"), F.count_distinct("source_ref").alias("sources"))


@query("J10_candidate_conflicts", "select c.claim_id as candidate_id, count(*) as against from claims c join claims a on c.scope_type = a.scope_type and c.scope_key = a.scope_key and c.subject_entity_id = a.subject_entity_id and c.predicate = a.predicate where c.status = 'contested' and a.status = 'accepted' and c.object_value <> a.object_value and greatest(c.valid_from, a.valid_from) < least(coalesce(c.valid_to, timestamp '2200-01-01'), coalesce(a.valid_to, timestamp '2200-01-01')) group by c.claim_id")
def j10(t: Store) -> DataFrame:
    slot = ["scope_type", "scope_key", "subject_entity_id", "predicate"]
    own = lambda status: t.claims.where(F.col("status") == status).select(*slot, "claim_id", "object_value", "valid_from", "valid_to")
    rows = joins.overlapping(own("contested"), own("accepted"), slot).where("left.object_value <> right.object_value")
    return rows.groupBy(F.col("left.claim_id").alias("candidate_id")).agg(F.count("*").alias("against"))


@query("A13_cluster_keys", "select subject_entity_id, predicate, count(*) as claims from claims group by subject_entity_id, predicate")
def a13(t: Store) -> DataFrame:
    return t.claims.groupBy("subject_entity_id", "predicate").agg(F.count("*").alias("claims"))


@query("W2_best_claim_per_memory", "select memory_id, claim_id from (select memory_id, claim_id, row_number() over (partition by memory_id order by case status when 'accepted' then 2 else 1 end desc, recorded_at desc, claim_id) as n from claims) where n = 1")
def w2(t: Store) -> DataFrame:
    priority = F.when(F.col("status") == "accepted", 2).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc(priority), F.desc("recorded_at"), "claim_id"))
    return t.claims.withColumn("n", rank).where("n = 1").select("memory_id", "claim_id")


@query("W4_reciprocal_ranks", "select query_id, memory_id, round(1.0 / row_number() over (partition by query_id order by memory_id % 10 desc, memory_id), 6) as value from judged where memory_id % 10 > 0")
def w4(t: Store) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("memory_id") % 10), "memory_id"))
    return t.judged.where("memory_id % 10 > 0").select("query_id", "memory_id", F.round(1 / rank, 6).alias("value"))


@query("K1_filtered_top", "select memory_id from memories where status = 'active' and category = 'decision' order by importance desc, memory_id limit 200")
def k1(t: Store) -> DataFrame:
    return t.memories.where("status = 'active' and category = 'decision'").orderBy(F.desc("importance"), "memory_id").limit(200).select("memory_id")


@query("R6_ann_recall", f"with {ELIGIBLE}, {COSINE}, every as (select query_id, memory_id, row_number() over (partition by query_id order by round(score, 9) desc, memory_id) as rank from cosines), wanted as (select query_id, count(*) as n from every where rank <= 5 group by query_id) select count(*) as queries, sum(n) as wanted, true as by_index, true as reaches, true as falls_back from wanted")
def r6(t: Store) -> DataFrame:
    """The kept index against exact neighbours: whether nine tenths are found, and whether a table that it doesn't hold is searched exactly."""
    index = vectors.kept(t.vectors, kept_path(t.spark, "vectors", t.sf_dir), "embedding")
    asked = t.asks.join(t.vectors.select(F.col("memory_id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    found, by_index = index.search("embedding", asked, 5, t.vectors)
    changed = t.vectors.where("memory_id > 0")
    exact, again = index.search("embedding", asked, 5, changed)
    true = semantic(t, 5).select("query_id", "memory_id")
    hits = true.join(found.select("query_id", "memory_id", F.lit(1).alias("hit")), ["query_id", "memory_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("reaches"))
    other = exact.where("memory_id = 0").isEmpty() and not again
    return hits.select("queries", "wanted", F.lit(by_index).alias("by_index"), "reaches", F.lit(other).alias("falls_back"))


@query("R18_config_digest", "select provider, sha256('{\"arms\":' || count(distinct condition) || ',\"provider\":\"' || provider || '\",\"runs\":' || count(*) || '}') as digest from usage group by provider")
def r18(t: Store) -> DataFrame:
    """The digest of a configuration's canonical form, however its keys are ordered."""
    rows = t.usage.groupBy("provider").agg(F.to_json(F.struct(F.count("*").alias("runs"), F.first("provider").alias("provider"), F.count_distinct("condition").alias("arms"))).alias("config"))
    return rows.select("provider", F.sha2(plain.canonical_json("config"), 256).alias("digest"))


POOL = "pool as (select query_id, memory_id, list_filter(regexp_extract_all(lower(regexp_replace(title, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[\\p{L}\\p{N}\\p{M}_.]+'), lambda x: length(x) > 1) as w from judged join memories using (memory_id))"


@query("R20_pool_bm25", f"with {POOL}, asked as (select query_id, arg_min(w, memory_id) as q from pool group by query_id), sizes as (select query_id, count(*) as n, avg(len(w)) as average from pool group by query_id), tf as (select query_id, memory_id, len(any_value(w)) as dl, term, count(*) as f from (select query_id, memory_id, w, unnest(w) as term from pool) group by query_id, memory_id, term), df as (select query_id, term, count(*) as df from tf group by query_id, term) select tf.query_id, tf.memory_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / greatest(average, 1)))), 6) as score from tf join df using (query_id, term) join sizes using (query_id) join (select query_id, unnest(list_distinct(q)) as term from asked) a on a.query_id = tf.query_id and a.term = tf.term group by tf.query_id, tf.memory_id")
def r20(t: Store) -> DataFrame:
    pool = t.judged.join(t.memories.select("memory_id", "title"), "memory_id").select("query_id", "memory_id", F.filter(text.camel_tokens(F.col("title")), lambda w: F.length(w) > 1).alias("words"))
    asked = pool.groupBy("query_id").agg(F.min_by("words", "memory_id").alias("words")).select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    sizes = pool.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("average"))
    tf = pool.select("query_id", "memory_id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("query_id", "memory_id", "length", "term").agg(F.count("*").alias("f"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    rows = tf.join(asked, ["query_id", "term"]).join(df, ["query_id", "term"]).join(sizes, "query_id")
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("length") / F.greatest(F.col("average"), F.lit(1.0))))
    return rows.groupBy("query_id", "memory_id").agg(F.round(F.sum(part), 6).alias("score"))


@query("C4_entity_names", "select anchor_id, array_to_string(regexp_extract_all(lower(trim(path)), '[a-z0-9_./:+#-]+'), ' ') as place, array_to_string(regexp_extract_all(lower(trim(p_name || ',  ' || p_brand || '!')), '[a-z0-9_./:+#-]+'), ' ') as name from anchors join part on p_partkey = anchor_id")
def c4(t: Store) -> DataFrame:
    """Entity names in their normal form: a path written with backslashes and dots, and a name with marks around it."""
    rows = t.anchors.join(t.raw("part").select(F.col("p_partkey").alias("anchor_id"), "p_name", "p_brand"), "anchor_id")
    said, windows = F.concat(F.lit(" "), F.upper("p_name"), F.lit(",  "), F.col("p_brand"), F.lit("!")), F.concat(F.lit(".\\"), F.translate("path", "/", "\\"))
    return rows.select("anchor_id", plain.normalized_entity(windows).alias("place"), plain.normalized_entity(said).alias("name"))


#: The ratio by its definition: the longest common run (the first of those as long), then what lies left of it and right of it.
ALIKE = r"""with recursive own as (select distinct symbol_fqn, regexp_extract(path, '([^/]*)$', 1) as name from anchors), named as (select distinct name from own),
    runs(a, b, x, y, k) as (select l.name, r.name, l.name, r.name, 0 from named l join named r on l.name < r.name
    union all select a, b, unnest([x[:best.i - 1], x[best.i + best.k:]]), unnest([y[:best.j - 1], y[best.j + best.k:]]), unnest([best.k, 0]) from (select a, b, x, y, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(y) + 1), lambda j:
        {'k': len(list_filter(range(1, least(length(x) - i, length(y) - j) + 2), lambda n: substr(x, i, n) = substr(y, j, n))), 'back_i': -i, 'back_j': -j, 'i': i, 'j': j})))) as best from runs where length(x) > 0 and length(y) > 0) where best.k > 0),
    ratios as (select a, b, 2.0 * sum(k) / (length(a) + length(b)) as similarity from runs group by a, b)
    select l.symbol_fqn, l.name as a, r.name as b, round(similarity, 6) as similarity from own l join own r on l.symbol_fqn = r.symbol_fqn join ratios on a = l.name and b = r.name where similarity >= 0.65 and similarity < 1"""


@query("C15_merge_candidates", ALIKE)
def c15(t: Store) -> DataFrame:
    """Names of one type that are alike but not equal: every pair of distinct names, however they begin."""
    names = t.anchors.select("symbol_fqn", F.element_at(F.split("path", "/"), -1).alias("name"))
    return joins.alike(names, ["symbol_fqn"]).select("symbol_fqn", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("C21_symbols", "select anchor_id, 'f_' || anchor_id || ',C' || anchor_id || case when anchor_id % 3 = 0 then ',later' else '' end as symbols from anchors")
def c21(t: Store) -> DataFrame:
    """Functions and classes that a source text declares."""
    number = F.col("anchor_id").cast("string")
    code = F.concat(F.lit("# "), "path", F.lit("\ndef f_"), number, F.lit("(x):\n    pass\n\nclass C"), number, F.lit(":\n    name = 'def '\n"), F.when(F.col("anchor_id") % 3 == 0, "    async def later(self): ...\n").otherwise(""))
    found = F.regexp_extract_all("code", F.lit(r"(?m)^\s*(?:async\s+def|def|class)\s+(\w+)"), F.lit(1))
    return t.anchors.select("anchor_id", code.alias("code")).select("anchor_id", F.array_join(found, ",").alias("symbols"))


@query("D18_run_lookup", "select run_id, condition, input_tokens from usage where run_id in (7, 8, 9)")
def d18(t: Store) -> DataFrame:
    return t.usage.where(F.col("run_id").isin(7, 8, 9)).select("run_id", "condition", "input_tokens")


@query("D20_row_coercion", "select event_id, case when event_id % 5 <> 0 then cast(json_extract_string(props, '$.k') as int) end as value from events")
def d20(t: Store) -> DataFrame:
    """A field of the wanted kind, or null: every fifth line holds a text there, and all hold more than is asked for."""
    wrong = F.replace(F.col("props"), F.lit("}"), F.lit('x", "extra": 1}'))
    line = F.when(F.col("event_id") % 5 == 0, F.regexp_replace(wrong, '"k": ', '"k": "')).otherwise(F.col("props"))
    return t.raw("events").select("event_id", F.from_json(line, "k int")["k"].alias("value"))


@query("X13_delta_choice", "select query_id, changed < 0.8 * total as send_delta from (select query_id, sum(case when memory_id % 3 = 0 then length(title) else 0 end) as changed, sum(length(title)) as total from judged join memories using (memory_id) group by query_id)")
def x13(t: Store) -> DataFrame:
    rows = t.judged.join(t.memories.select("memory_id", "title"), "memory_id").withColumn("size", F.length("title"))
    sums = rows.groupBy("query_id").agg(F.sum(F.when(F.col("memory_id") % 3 == 0, F.col("size")).otherwise(0)).alias("changed"), F.sum("size").alias("total"))
    return sums.select("query_id", (F.col("changed") < 0.8 * F.col("total")).alias("send_delta"))


@query("X14_expired_snapshots", "select memory_id from memories where created_at + to_days(30) > timestamp '2024-02-10'")
def x14(t: Store) -> DataFrame:
    return t.memories.where(F.col("created_at") + F.make_dt_interval(F.lit(30)) > intervals.moment("2024-02-10 00:00:00")).select("memory_id")


@query("F11_dates", "select memory_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso, round(greatest(0, epoch_us(timestamp '2024-06-01') - epoch_us(created_at)) / 86400000000.0::double, 6) as age from memories")
def f11(t: Store) -> DataFrame:
    return t.memories.select("memory_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.round(intervals.age_days(F.col("created_at"), intervals.moment("2024-06-01 00:00:00")), 6).alias("age"))


@query("F14_sorted_set", "select category, list_aggregate(list_sort(list_distinct(list(scope_type))), 'string_agg', ',') as scopes from memories group by category")
def f14(t: Store) -> DataFrame:
    return t.memories.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("scope_type")), ",").alias("scopes"))


@query("F15_sparse_cosine", "with w as (select memory_id, term, count(*) as f from (select memory_id, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}\\p{M}_.]+')) as term from memories) group by memory_id, term), n as (select memory_id, sqrt(sum(f * f)) as norm from w group by memory_id) select a.memory_id, round(sum(a.f * b.f) / (any_value(x.norm) * any_value(y.norm)), 6) as cosine from w a join w b on b.memory_id = a.memory_id + 1 and a.term = b.term join n x on x.memory_id = a.memory_id join n y on y.memory_id = a.memory_id + 1 group by a.memory_id")
def f15(t: Store) -> DataFrame:
    w = t.memories.select("memory_id", F.explode(text.tokens(F.col("title"))).alias("term")).groupBy("memory_id", "term").agg(F.count("*").alias("f"))
    norms = w.groupBy("memory_id").agg(F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("norm"))
    other = w.select((F.col("memory_id") - 1).alias("memory_id"), "term", F.col("f").alias("g"))
    dots = w.join(other, ["memory_id", "term"]).groupBy("memory_id").agg(F.sum(F.col("f") * F.col("g")).alias("dot"))
    return dots.join(norms, "memory_id").join(norms.select((F.col("memory_id") - 1).alias("memory_id"), F.col("norm").alias("other")), "memory_id").select("memory_id", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 6).alias("cosine"))


@query("F16_canonical_json", "select event_id, case when event_id % 7 <> 0 then '{\"a\":[' || user_id || ',2],\"k\":' || json_extract_string(props, '$.k') || '}' end as canonical from events")
def f16(t: Store) -> DataFrame:
    """Keys in order and no blanks; null for a line that is broken off."""
    whole = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "a": [ '), F.col("user_id").cast("string"), F.lit(", 2 ] }"))
    line = F.when(F.col("event_id") % 7 == 0, F.regexp_replace(whole, r"\}$", "")).otherwise(whole)
    return t.raw("events").select("event_id", plain.canonical_json(line).alias("canonical"))


@query("F18_defaults", "select memory_id, coalesce(memory_key, subject, 'none') as label, coalesce(ttl_seconds, 0) as ttl from memories")
def f18(t: Store) -> DataFrame:
    return t.memories.select("memory_id", F.coalesce("memory_key", "subject", F.lit("none")).alias("label"), F.coalesce("ttl_seconds", F.lit(0)).alias("ttl"))


@query("L2_fold_ranges")
def l2(t: Store) -> DataFrame:
    """Weights, none below zero, with each scope left out in turn, all fitted together."""
    from factloom.plans.experiments import preferences

    best = metrics.fold_fits(preferences(t), ["importance", "confidence"], "scope_type", F.col("split") != "train", signs=[1, 1])
    return t.spark.createDataFrame([(b["left_out"], b["penalty"], *b["weights"]) for b in best], "left_out string, penalty double, importance double, confidence double")


@query("L9_visibility_suite", "select (claim_id % 4) as family, count(*) filter (recorded_at <= timestamp '1997-06-01' and valid_from <= timestamp '1997-06-01' and (valid_to is null or timestamp '1997-06-01' < valid_to)) as seen, count(*) as cases from claims group by claim_id % 4")
def l9(t: Store) -> DataFrame:
    seen = intervals.known_at(F.col("recorded_at"), valid()) & intervals.holds_at(F.col("valid_from"), F.col("valid_to"), valid())
    return t.claims.groupBy((F.col("claim_id") % 4).alias("family")).agg(F.count_if(seen).alias("seen"), F.count("*").alias("cases"))


@query("M1_feature_delta", "select a.memory_id, round(a.importance - b.importance, 6) as importance, round(a.confidence - b.confidence, 6) as confidence from memories a join memories b on b.memory_id = a.memory_id + 1")
def m1(t: Store) -> DataFrame:
    after = t.memories.select((F.col("memory_id") - 1).alias("memory_id"), F.col("importance").alias("i"), F.col("confidence").alias("c"))
    return t.memories.join(after, "memory_id").select("memory_id", F.round(F.col("importance") - F.col("i"), 6).alias("importance"), F.round(F.col("confidence") - F.col("c"), 6).alias("confidence"))


@query("M3_task_means", "select task_id, round(avg(latency_seconds), 6) as mean from usage group by task_id")
def m3(t: Store) -> DataFrame:
    return t.usage.groupBy("task_id").agg(F.round(F.avg("latency_seconds"), 6).alias("mean"))


@query("M6_label_distribution", "select first_label, second_label, count(*) as n, round(count(*) / (select count(*) from reviews), 6) as share from reviews group by first_label, second_label")
def m6(t: Store) -> DataFrame:
    counts = metrics.confusion(t.reviews, "first_label", "second_label")
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("first_label", "second_label", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("M8_ablation_plan", "select query_id, min(case when quality = 1 then memory_id end) as helpful, min(case when quality = 0 then memory_id end) as irrelevant from judged group by query_id")
def m8(t: Store) -> DataFrame:
    return t.judged.groupBy("query_id").agg(F.min(F.when(F.col("quality") == 1, F.col("memory_id"))).alias("helpful"), F.min(F.when(F.col("quality") == 0, F.col("memory_id"))).alias("irrelevant"))


@query("M10_study_report", "select condition, provider, count(*) as runs, round(sum(latency_seconds), 6) as latency from usage group by condition, provider")
def m10(t: Store) -> DataFrame:
    return t.usage.groupBy("condition", "provider").agg(F.count("*").alias("runs"), F.round(F.sum("latency_seconds"), 6).alias("latency"))


@query("M15_pool_cosine", "select j.query_id, count(*) as pool, round(max(list_cosine_similarity(v.embedding::double[], w.embedding::double[])), 6) as best from judged j join vectors v using (memory_id) join vectors w on w.memory_id = j.query_id where j.memory_id <> j.query_id group by j.query_id")
def m15(t: Store) -> DataFrame:
    asked = t.vectors.select(F.col("memory_id").alias("query_id"), F.col("embedding").alias("asked"))
    rows = t.judged.where("memory_id <> query_id").join(t.vectors, "memory_id").join(asked, "query_id")
    return rows.groupBy("query_id").agg(F.count("*").alias("pool"), F.round(F.max(retrieval.cosine(F.col("embedding"), F.col("asked"))), 6).alias("best"))


@query("S15_history_records", "select o_orderkey as id, o_orderpriority as subject, count(l_linenumber) as files from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderpriority")
def s15(t: Store) -> DataFrame:
    """Records of a history: fields by unit separators on the first line, then a line for each file."""
    files = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("src/"), n.cast("string"), F.lit(".py"))), "\n").alias("files"))
    record = F.concat_ws("\n", F.concat_ws("\x1f", F.sha2(F.col("o_orderkey").cast("string"), 256), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority"), "files")
    rows = t.raw("orders").join(files, "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), record.alias("record"))
    lines, head = F.split("record", "\n"), F.split(F.split("record", "\n")[0], "\x1f")
    return rows.select("id", head[2].alias("subject"), (F.size(lines) - 1).cast("long").alias("files"))


@query("S16_dataset_counts", "select 'judged' as dataset, count(*) as rows, count(distinct memory_id) as ids from judged union all select 'asks', count(*), count(distinct query_id) from asks")
def s16(t: Store) -> DataFrame:
    one = lambda name, rows, key: rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.count_distinct(key).alias("ids"))
    return one("judged", t.judged, "memory_id").union(one("asks", t.asks, "query_id"))


@query("S19_offline_embedder", "select count(*) as vectors from memories")
def s19(t: Store) -> DataFrame:
    rows = t.memories.select(providers.embedder()("title").alias("v"))
    return rows.agg(F.count_if(F.size("v") == 64).alias("vectors"))


@query("X11_payload_fixed_point", "select memory_id, case when bare + 1 < 10 then bare + 1 when bare + 2 < 100 then bare + 2 when bare + 3 < 1000 then bare + 3 when bare + 4 < 10000 then bare + 4 else bare + 5 end as used from (select memory_id, length('{\"budget\":10,\"text\":\"' || repeat('x', (memory_id * 37 % 12000)::int) || '\",\"used\":}') as bare from memories)")
def x11(t: Store) -> DataFrame:
    """What a payload uses when its own figure counts itself: the least number of digits that comes out right."""
    body = F.repeat(F.lit("x"), (F.col("memory_id") * 37 % 12000).cast("int"))
    bare = F.length(F.concat(F.lit('{"budget":10,"text":"'), body, F.lit('","used":}')))
    return t.memories.select("memory_id", context.settled(bare).cast("long").alias("used"))


@query("S17_task_adapter", "select item_id as task_id, regexp_extract(text, '^[^\\s]+', 0) as repository, length(text) as size from benchmark")
def s17(t: Store) -> DataFrame:
    return t.raw("benchmark").select(F.col("item_id").alias("task_id"), F.regexp_extract("text", r"^[^\s]+", 0).alias("repository"), F.length("text").cast("long").alias("size"))


@query("S18_report", "select '{\"condition\":\"' || condition || '\",\"runs\":' || count(*) || '}' as line from usage group by condition")
def s18(t: Store) -> DataFrame:
    return t.usage.groupBy("condition").agg(F.count("*").alias("runs")).select(F.to_json(F.struct("condition", "runs")).alias("line"))


@query("K5_selection_limit", "select query_id, memory_id from (select query_id, memory_id, row_number() over (partition by query_id order by memory_id) as n from judged) where n > 5 and n <= 15")
def k5(t: Store) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("memory_id"))
    return t.judged.withColumn("n", rank).where("n <= 15").where("n > 5").select("query_id", "memory_id")


@query("ST2_expiry", "select memory_id from memories where ttl_seconds is not null and created_at + to_seconds(ttl_seconds) <= timestamp '2024-06-01'")
def st2(t: Store) -> DataFrame:
    return t.memories.where("ttl_seconds is not null").where(~intervals.lives(F.col("created_at"), F.col("ttl_seconds"), intervals.moment("2024-06-01 00:00:00"))).select("memory_id")


@query("J1_hits_memories_health", f"with {BM25} select query_id, m.memory_id, m.status, h.temperature from fts join memories m on m.memory_id = fts.memory_id left join health h on h.memory_id = m.memory_id where rank <= 20")
def j1(t: Store) -> DataFrame:
    hits = lexical(t, 20).select("query_id", "memory_id")
    return hits.join(t.memories.select("memory_id", "status"), "memory_id").join(t.health.select("memory_id", "temperature"), "memory_id", "left").select("query_id", "memory_id", "status", "temperature")


@query("W3_channel_ranks", f"with {BM25}, {COSINE}, {FUSED} select query_id, channel, memory_id, rank from every")
def w3(t: Store) -> DataFrame:
    parts = [rows.select("query_id", F.lit(name).alias("channel"), "memory_id", F.col("rank").cast("long").alias("rank")) for name, rows in channels(t).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("U3_set_overlaps", "select memory_id, round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 6) as dice, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard from (select memory_id, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}\\p{M}_.]+')) as x, list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}\\p{M}_.]+')) as y from memories) where len(x) + len(y) > 0")
def u3(t: Store) -> DataFrame:
    rows = t.memories.select("memory_id", text.tokens(F.col("title")).alias("x"), text.tokens(F.col("content")).alias("y")).where(F.size("x") + F.size("y") > 0)
    return rows.select("memory_id", F.round(text.dice(F.col("x"), F.col("y")), 6).alias("dice"), F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query("S12_partitioned_read", "select scope_key, count(*) as rows, sum(length(content))::bigint as chars from memories group by scope_key")
def s12(t: Store) -> DataFrame:
    return t.memories.groupBy("scope_key").agg(F.count("*").alias("rows"), F.sum(F.length("content")).alias("chars"))


@query("L6_silver_relevance", "select anchor_id as target, count(*) over (partition by path) - 1 as same_path, count(*) over (partition by regexp_extract(path, '^(.*)/[^/]*$', 1)) - 1 as same_folder from anchors")
def l6(t: Store) -> DataFrame:
    """How many other anchors lie in each one's file and folder: counted by group, without pairs."""
    rows = t.anchors.select("anchor_id", "path", text.path_parts(F.col("path"))["parent"].alias("folder"))
    paths = rows.groupBy("path").agg((F.count("*") - 1).alias("same_path"))
    folders = rows.groupBy("folder").agg((F.count("*") - 1).alias("same_folder"))
    return rows.join(paths, "path").join(folders, "folder").select(F.col("anchor_id").alias("target"), "same_path", "same_folder")


@query("F13_finite", "select memory_id, len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 as fine from vectors")
def f13(t: Store) -> DataFrame:
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return t.vectors.select("memory_id", fine.alias("fine"))


@query("K4_pool_clamp", "select query_id, count(*) as pool from (select query_id, row_number() over (partition by query_id order by memory_id) as n, least(1000, greatest(80, query_id * 8)) as most from judged) where n <= most group by query_id")
def k4(t: Store) -> DataFrame:
    """Eight times what is asked for, but 80 at least and 1000 at most."""
    most = F.least(F.lit(1000), F.greatest(F.lit(80), F.col("query_id") * 8))
    rows = t.judged.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("memory_id"))).where(F.col("n") <= most)
    return rows.groupBy("query_id").agg(F.count("*").alias("pool"))


@query("W6_nearest_future", "select event_id, case when lead(ts) over w <= ts + interval 7 day then lead(event_id) over w end as following, case when lag(ts) over w >= ts - interval 3 day then lag(event_id) over w end as before from audit_events window w as (partition by memory_id order by ts, event_id)")
def w6(t: Store) -> DataFrame:
    """The nearest event after each within seven days, and before it within three."""
    order = Window.partitionBy("memory_id").orderBy("ts", "event_id")
    days = lambda n: F.make_dt_interval(F.lit(n))
    soon, late = F.lead("ts").over(order) <= F.col("ts") + days(7), F.lag("ts").over(order) >= F.col("ts") - days(3)
    return t.audit_events.select("event_id", F.when(soon, F.lead("event_id").over(order)).alias("following"), F.when(late, F.lag("event_id").over(order)).alias("before"))


@query("U1_merged_channels", f"with {BM25}, {COSINE} select query_id, memory_id, round(max(score), 6) as score from (select query_id, memory_id, score from fts where rank <= 50 union all select query_id, memory_id, score from vec where rank <= 50) group by query_id, memory_id")
def u1(t: Store) -> DataFrame:
    return retrieval.merged([lexical(t, 50), semantic(t, 50, eligible(t))]).withColumn("score", F.round("score", 6))


@query("X2_contested_components", "with recursive own as (select distinct memory_id, identity_id from claims where status = 'contested'), firsts as (select identity_id, min(memory_id) as b from own group by identity_id), edges as (select distinct memory_id as x, b as y from own join firsts using (identity_id) where memory_id <> b union select distinct b, memory_id from own join firsts using (identity_id) where memory_id <> b), reach as (select x as node, least(x, y) as root from edges union select e.y, r.root from reach r join edges e on e.x = r.node where r.root < e.y) select root, count(*) as members from (select node, min(root) as root from reach group by node) group by root")
def x2(t: Store) -> DataFrame:
    """How many contested memories are in each component."""
    return contested_components(t).groupBy("root").agg(F.count("*").alias("members"))


def contested_components(t: Store) -> DataFrame:
    """(memory_id, root): contested memories that share an identity with another, directly or through others."""
    from factloom.operators.graph import components

    own = t.claims.where("status = 'contested'").select("memory_id", "identity_id").distinct()
    first = own.groupBy("identity_id").agg(F.min("memory_id").alias("b"))
    edges = own.join(first, "identity_id").select(F.col("memory_id").alias("a"), "b").where("a <> b").distinct()
    return components(edges).select(F.col("node").alias("memory_id"), "root")


@query("S3_index_scan", f"with {BM25} select query_id, memory_id, round(score, 6) as score, matched, rank from (select f.query_id, f.memory_id, f.score, b.matched, rank from fts f join bm25 b on b.query_id = f.query_id and b.memory_id = f.memory_id) where rank <= 20")
def s3(t: Store) -> DataFrame:
    """The index in order of BM25, over all weighted fields."""
    return lexical(t, 20).select("query_id", "memory_id", F.round("exact", 6).alias("score"), "matched", F.col("rank").cast("long").alias("rank"))


@query("S13_tail_tolerant_lines", "select file, count(*) as lines, sum(k)::bigint as content from (select user_id % 50 as file, cast(json_extract_string(props, '$.k') as int) as k, row_number() over (partition by user_id % 50 order by event_id desc) as back from events) where back > 1 group by file")
def s13(t: Store) -> DataFrame:
    """Files of lines whose last line is cut off: that one is dropped; any other broken line is an error."""
    from factloom.sources.tables import complete_lines

    rows = t.raw("events").select((F.col("user_id") % 50).alias("file"), F.col("event_id").alias("place"), "props")
    last = rows.groupBy("file").agg(F.max("place").alias("place"), F.lit(True).alias("cut"))
    lines = rows.join(last, ["file", "place"], "left").select("file", "place", F.when(F.col("cut"), F.substring("props", 1, 5)).otherwise(F.col("props")).alias("value"))
    whole = complete_lines(lines, "file", "place").select("file", F.variant_get(F.parse_json("value"), "$.k", "int").alias("k"))
    return whole.groupBy("file").agg(F.count("*").alias("lines"), F.sum("k").alias("content"))


@query("D16_fingerprints", "select query_id, sha256('{\"budget\":2000,\"query\":\"q' || query_id || '\",\"scope\":\"' || sha256('[\"branch:b' || (query_id % 3) || '\",\"repository:r\"]') || '\"}') as fingerprint from asks")
def d16(t: Store) -> DataFrame:
    """The digest of a request, which holds that of its scopes in order: what differs in either is another request."""
    scopes = F.array_sort(F.array(F.lit("repository:r"), F.concat(F.lit("branch:b"), (F.col("query_id") % 3).cast("string"))))
    scope = F.sha2(plain.canonical_json(F.to_json(scopes)), 256)
    body = F.to_json(F.struct(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), F.lit(2000).alias("budget"), scope.alias("scope")))
    return t.asks.select("query_id", F.sha2(plain.canonical_json(body), 256).alias("fingerprint"))
