"""The logs' windows and states; batch queries whose streaming twins are tested against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources.model import Store
from factloom.streaming import streams


def events(t: Store) -> DataFrame:
    return t.audit_events.withColumn("ts", F.col("ts").cast("timestamp"))


@query("ST1_usage_guard", "select task_id, coalesce(target > 1.3 * greatest(left_, right_) and left_ is not null and right_ is not null, false) as over from (select task_id % 40 as task_id, sum(input_tokens) filter (provider = 'alpha') as target, sum(input_tokens) filter (provider = 'beta') as left_, sum(input_tokens) filter (provider = 'gamma') as right_ from usage group by task_id % 40)")
def st1(t: Store) -> DataFrame:
    arm = F.when(F.col("provider") == "alpha", "target").when(F.col("provider") == "beta", "left").otherwise("right")
    return streams.usage_guard(t.usage.select((F.col("task_id") % 40).alias("task_id"), arm.alias("arm"), F.col("input_tokens").alias("tokens"))).select("task_id", "over")


@query("ST4_daily_windows", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, action, count(*) as n from audit_events group by all")
def st4(t: Store) -> DataFrame:
    rows = t.audit_events.groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "action").agg(F.count("*").alias("n"))
    return rows.select("day", "action", "n")


@query("ST4_sessions", "select memory_id, count(*) as sessions from (select memory_id, ts, lag(ts) over (partition by memory_id order by ts, event_id) as before from audit_events) where before is null or ts >= before + interval 30 minute group by memory_id")
def st4s(t: Store) -> DataFrame:
    return streams.sessions(t.audit_events, "ts", "30 minutes", "memory_id").groupBy("memory_id").agg(F.count("*").alias("sessions"))


@query("ST3_last_state", "select memory_id, arg_max(action, ts) as action from audit_events group by memory_id having count(*) filter (ts = (select max(ts) from audit_events)) >= 0")
def st3(t: Store) -> DataFrame:
    return streams.last_state(t.audit_events).select("memory_id", "action")
