"""The memory store's tables, derived from the driver's tables; SQL holds the same derivations for DuckDB."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.graph import with_checkpoints

_SCOPE = "case {0} % 5 when 0 then 'task' when 1 then 'branch' when 2 then 'repository' when 3 then 'workspace' else 'user' end"
_CATEGORY = "case doc_id % 6 when 0 then 'decision' when 1 then 'constraint' when 2 then 'failure' when 3 then 'preference' when 4 then 'state' else 'note' end"
_TYPE = "case doc_id % 4 when 0 then 'episodic' when 1 then 'project' when 2 then 'procedural' else 'preference' end"
_STATUS = "case when doc_id % 11 = 0 then 'superseded' when doc_id % 17 = 0 then 'candidate' else 'active' end"
_PREDICATE = "case o_custkey % 6 when 0 then 'uses' when 1 then 'forbidden' when 2 then 'implemented_in' when 3 then 'prefers' when 4 then 'failed_because' else 'states' end"
#: Contests are rare, so that memories with and without one are met.
_CLAIM_STATUS = "case when o_orderstatus = 'O' then 'superseded' when o_orderstatus = 'P' and o_orderkey % 16 = 0 then 'contested' else 'accepted' end"
_STALE = "case o_orderkey % 4 when 0 then 'fresh' when 1 then 'unknown' when 2 then 'suspect' else 'stale' end"
#: What a query names besides its words: code, an entity, a type of entities and a time, or nothing.
_SUFFIX = "case item_id % 4 when 1 then ' see `economy` and red_widget.py' when 2 then ' for customer#00000' || lpad({0}, 4, '0') when 3 then ' about machinery as of then' else '' end"

_EVIDENCE = ["l_orderkey * 10 + l_linenumber as evidence_id", "l_orderkey as claim_id", "l_suppkey as source_id", "l_partkey as anchor_id", "1 - l_discount as support_weight", "l_shipdate as captured_at"]

#: Claims or parts that are copied to where the lines lie; more are joined by sort and merge.
_FEW = 500_000

#: DuckDB text of each model table, over the driver's views and earlier model tables.
SQL = {
    "memories": f"""select doc_id as memory_id, {_SCOPE.format('doc_id')} as scope_type, lang as scope_key, {_TYPE} as memory_type, {_CATEGORY} as category,
        source as subject, case when doc_id % 3 = 0 then 'key ' || (doc_id % 50) end as memory_key, substr(text, 1, 60) as title, text as content,
        {_STATUS} as status, 0.5 + (doc_id % 5) / 10.0::double as confidence, (doc_id % 10) / 10.0::double as importance,
        timestamp '2024-01-01' + to_hours(doc_id) as created_at, case when doc_id % 7 = 0 then 2592000 end as ttl_seconds,
        case when doc_id % 9 = 0 then timestamp '2024-01-01' + to_hours(doc_id) end as valid_from,
        case when doc_id % 13 = 0 then timestamp '2024-01-01' + to_hours(doc_id + 1440) end as valid_to from documents""",
    "health": """select doc_id as memory_id, case when doc_id % 19 = 0 then 'archived' when doc_id % 4 = 0 then 'hot' else 'warm' end as temperature, doc_id % 23 as retrieval_count,
        case when doc_id % 2 = 0 then timestamp '2024-01-01' + to_hours(doc_id + 240) end as last_retrieved_at from documents where doc_id % 3 <> 1""",
    "claims": f"""select o_orderkey as claim_id, o_custkey as identity_id, o_custkey as subject_entity_id, o_orderkey % (select count(*) from documents) as memory_id, {_PREDICATE} as predicate, lower(o_orderpriority) as object_value,
        case when o_orderkey % 7 = 0 then 'negative' else 'positive' end as polarity, {_CLAIM_STATUS} as status, {_STALE} as stale_state, {_SCOPE.format('o_custkey')} as scope_type, 'scope' || (o_custkey % 3) as scope_key,
        o_orderdate as valid_from, case when o_orderkey % 10 <> 0 then o_orderdate + to_days((o_orderkey % 60)::integer) end as valid_to, o_orderdate + to_days((o_orderkey % 5)::integer) as recorded_at,
        0.5 + (o_orderkey % 5) / 10.0::double as confidence from orders""",
    "claim_versions": """select claim_id, identity_id, memory_id, subject_entity_id, predicate, object_value, polarity, status, stale_state, scope_type, scope_key, valid_from, valid_to, recorded_at as transaction_from,
        lead(recorded_at) over (partition by identity_id order by recorded_at, claim_id) as transaction_to,
        row_number() over (partition by identity_id order by recorded_at, claim_id) as version_number from claims""",
    "entities": "select c_custkey as entity_id, c_name as canonical_name, lower(c_name) as normalized_name, lower(c_mktsegment) as entity_type, c_nationkey from customer",
    "claim_evidence": "select l_orderkey * 10 + l_linenumber as evidence_id, l_orderkey as claim_id, l_suppkey as source_id, l_partkey as anchor_id, 1 - l_discount as support_weight, l_shipdate as captured_at from lineitem",
    "sources": "select s_suppkey as source_id, s_name as source_ref, case s_nationkey % 3 when 0 then 'document' when 1 then 'conversation' else 'code' end as source_type from supplier",
    "anchors": "select p_partkey as anchor_id, 'src/' || lower(p_brand) || '/' || replace(lower(p_name), ' ', '_') || '.py' as path, replace(p_type, ' ', '.') as symbol_fqn, case p_size % 5 when 0 then 'fresh' when 1 then 'moved' when 2 then 'unknown' when 3 then 'suspect' else 'stale' end as freshness_state, p_size from part",
    "claim_relations": "select distinct from_id, to_id from (select l_orderkey as to_id, lag(l_orderkey) over (partition by l_partkey order by l_orderkey, l_linenumber) as from_id from lineitem) where from_id is not null and from_id <> to_id",
    "audit_events": "select event_id, user_id as memory_id, case event_type when 'signup' then 'health_archive' when 'purchase' then 'health_restore' else 'other' end as action, ts from events",
    "feedback": "select event_id, user_id as memory_id, case event_type when 'click' then 'yes' when 'error' then 'no' when 'view' then 'unknown' end as verdict, ts from events where event_type in ('click', 'error', 'view')",
    "asks": f"select item_id as query_id, text || {_SUFFIX.format('(item_id % 150)::varchar')} as query from benchmark",
    "judged": "select doc_id as memory_id, doc_id % 20 as query_id, quality, toxic from labels",
    "usage": "select o_orderkey as run_id, o_custkey as task_id, case o_orderkey % 2 when 0 then 'baseline' else 'treatment' end as condition, case o_orderkey % 3 when 0 then 'cold' else 'warm' end as cache_phase, case o_custkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as provider, cast(floor(o_totalprice) as bigint) as input_tokens, case when o_orderkey % 9 <> 0 then cast(floor(o_totalprice / 3) as bigint) end as cache_hit_tokens, cast(o_orderkey % 700 as bigint) as output_tokens, o_totalprice / 1000 as latency_seconds, o_orderstatus = 'F' as success from orders",
    "vectors": "select vec_id as memory_id, embedding, label from embeddings",
    "reviews": "select l_orderkey as case_id, l_linenumber as candidate_id, cast(l_quantity as bigint) % 4 as first_relevance, cast(floor(l_extendedprice / 100) as bigint) % 4 as second_relevance, l_returnflag as first_label, l_linestatus as second_label from lineitem",
}


def with_model(sql: str) -> str:
    """sql with the model tables that it names put before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed and SQL[name] is not text:
                need(SQL[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    head = ", ".join(f"{name} as ({SQL[name]})" for name in needed)
    body = sql.strip()
    if not head:
        return body
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"with {head} {body}"


class Store:
    """The model tables as DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def memories(self) -> DataFrame:
        hours = lambda n: f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast({n} as int))"
        return self.raw("documents").selectExpr(
            "doc_id as memory_id", f"{_SCOPE.format('doc_id')} as scope_type", "lang as scope_key", f"{_TYPE} as memory_type", f"{_CATEGORY} as category",
            "source as subject", "case when doc_id % 3 = 0 then 'key ' || (doc_id % 50) end as memory_key", "substr(text, 1, 60) as title", "text as content",
            f"{_STATUS} as status", "0.5D + (doc_id % 5) / 10D as confidence", "(doc_id % 10) / 10D as importance", f"{hours('doc_id')} as created_at",
            "case when doc_id % 7 = 0 then 2592000 end as ttl_seconds", f"case when doc_id % 9 = 0 then {hours('doc_id')} end as valid_from",
            f"case when doc_id % 13 = 0 then {hours('doc_id + 1440')} end as valid_to",
        )

    @cached_property
    def health(self) -> DataFrame:
        return self.raw("documents").where("doc_id % 3 <> 1").selectExpr(
            "doc_id as memory_id", "case when doc_id % 19 = 0 then 'archived' when doc_id % 4 = 0 then 'hot' else 'warm' end as temperature", "doc_id % 23 as retrieval_count",
            "case when doc_id % 2 = 0 then timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id + 240 as int)) end as last_retrieved_at",
        )

    @cached_property
    def size(self) -> int:
        """How many memories there are: claims are dealt to all of them."""
        return max(1, self.raw("documents").count())

    @cached_property
    def claims(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as claim_id", "o_custkey as identity_id", "o_custkey as subject_entity_id", f"o_orderkey % {self.size} as memory_id", f"{_PREDICATE} as predicate", "lower(o_orderpriority) as object_value",
            "case when o_orderkey % 7 = 0 then 'negative' else 'positive' end as polarity", f"{_CLAIM_STATUS} as status", f"{_STALE} as stale_state", f"{_SCOPE.format('o_custkey')} as scope_type", "'scope' || (o_custkey % 3) as scope_key",
            "o_orderdate as valid_from", "case when o_orderkey % 10 <> 0 then o_orderdate + make_dt_interval(cast(o_orderkey % 60 as int)) end as valid_to", "o_orderdate + make_dt_interval(cast(o_orderkey % 5 as int)) as recorded_at",
            "0.5D + (o_orderkey % 5) / 10D as confidence",
        )

    @cached_property
    def claim_versions(self) -> DataFrame:
        from factloom.operators.claims import version_chain

        return version_chain(self.claims)

    @cached_property
    def entities(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey as entity_id", "c_name as canonical_name", "lower(c_name) as normalized_name", "lower(c_mktsegment) as entity_type", "c_nationkey")

    @cached_property
    def claim_evidence(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(*_EVIDENCE)

    @cached_property
    def placed_evidence(self) -> DataFrame:
        """claim_evidence with its place in the table: by file, which a number stands for, then by row."""
        files = self.raw("lineitem").select(F.col("_metadata.file_path").alias("file")).distinct()
        files = files.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long"))  # one row a file
        rows = self.raw("lineitem").selectExpr(*_EVIDENCE, "_metadata.file_path as file", "_metadata.row_index as row")
        return rows.join(F.broadcast(files), "file").withColumn("place", F.shiftleft("number", 40) + F.col("row")).drop("file", "number", "row")

    @cached_property
    def sources(self) -> DataFrame:
        return self.raw("supplier").selectExpr("s_suppkey as source_id", "s_name as source_ref", "case s_nationkey % 3 when 0 then 'document' when 1 then 'conversation' else 'code' end as source_type")

    @cached_property
    def anchors(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey as anchor_id", "'src/' || lower(p_brand) || '/' || replace(lower(p_name), ' ', '_') || '.py' as path", "replace(p_type, ' ', '.') as symbol_fqn",
            "case p_size % 5 when 0 then 'fresh' when 1 then 'moved' when 2 then 'unknown' when 3 then 'suspect' else 'stale' end as freshness_state", "p_size",
        )

    @cached_property
    def claim_relations(self) -> DataFrame:
        return self._relations(self.raw("lineitem"))

    def _relations(self, lines: DataFrame) -> DataFrame:
        before = F.lag("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
        return lines.select(before.alias("from_id"), F.col("l_orderkey").alias("to_id")).where("from_id is not null and from_id <> to_id").distinct()

    def relations_of(self, claims: DataFrame) -> DataFrame:
        """The rows of claim_relations with a claim of these (claim_id, distinct) at either end.

        A relation is between neighbours in one part, so only parts of these claims are put in order. Few claims and their parts are
        copied to where the lines lie, so that lines don't move.
        """
        near = lambda keys: F.broadcast(keys) if keys.count() <= _FEW else keys.hint("merge")
        with_checkpoints(self.spark)
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
        asked = claims.select(F.col("claim_id").alias("l_orderkey"))
        parts = lines.join(near(asked), "l_orderkey", "left_semi").select("l_partkey").distinct().checkpoint()
        rows = self._relations(lines.join(near(parts), "l_partkey", "left_semi"))
        ends = asked.select(F.col("l_orderkey").alias("claim_id"))
        forward = rows.join(near(ends), rows["from_id"] == ends["claim_id"], "left_semi")
        return forward.union(rows.join(near(ends), rows["to_id"] == ends["claim_id"], "left_semi")).distinct()

    @cached_property
    def audit_events(self) -> DataFrame:
        return self.raw("events").selectExpr("event_id", "user_id as memory_id", "case event_type when 'signup' then 'health_archive' when 'purchase' then 'health_restore' else 'other' end as action", "ts")

    @cached_property
    def feedback(self) -> DataFrame:
        return self.raw("events").where("event_type in ('click', 'error', 'view')").selectExpr("event_id", "user_id as memory_id", "case event_type when 'click' then 'yes' when 'error' then 'no' else 'unknown' end as verdict", "ts")

    @cached_property
    def asks(self) -> DataFrame:
        return self.raw("benchmark").selectExpr("item_id as query_id", f"text || {_SUFFIX.format('cast(item_id % 150 as string)')} as query")

    @cached_property
    def judged(self) -> DataFrame:
        return self.raw("labels").selectExpr("doc_id as memory_id", "doc_id % 20 as query_id", "quality", "toxic")

    @cached_property
    def usage(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey as run_id", "o_custkey as task_id", "case o_orderkey % 2 when 0 then 'baseline' else 'treatment' end as condition", "case o_orderkey % 3 when 0 then 'cold' else 'warm' end as cache_phase",
            "case o_custkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as provider", "cast(floor(o_totalprice) as bigint) as input_tokens", "case when o_orderkey % 9 <> 0 then cast(floor(o_totalprice / 3) as bigint) end as cache_hit_tokens",
            "o_orderkey % 700 as output_tokens", "o_totalprice / 1000 as latency_seconds", "o_orderstatus = 'F' as success",
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").selectExpr("vec_id as memory_id", "embedding", "label")

    @cached_property
    def reviews(self) -> DataFrame:
        return self.raw("lineitem").selectExpr("l_orderkey as case_id", "l_linenumber as candidate_id", "cast(l_quantity as bigint) % 4 as first_relevance", "cast(floor(l_extendedprice / 100) as bigint) % 4 as second_relevance", "l_returnflag as first_label", "l_linestatus as second_label")
