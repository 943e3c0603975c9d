"""Record health, expiry, counts and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import intervals

#: Fixed values of the score.
PARTS = {"recency": 0.25, "usage": 0.2, "feedback": 0.2, "freshness": 0.15, "importance": 0.1, "confidence": 0.1}


def scored(memories: DataFrame, health: DataFrame, claims: DataFrame, feedback: DataFrame, at: Column) -> DataFrame:
    """memory_id, the six components, health_score, temperature, strongest and weakest component."""
    has = lambda value: F.bool_or(F.col("stale_state") == value)
    fresh = claims.groupBy("memory_id").agg(F.when(has("stale"), 0.0).when(has("suspect"), 0.3).when(has("fresh"), 1.0).otherwise(0.55).alias("freshness"))
    votes = feedback.groupBy("memory_id").agg(F.count_if(F.col("verdict") == "yes").alias("yes"), F.count_if(F.col("verdict") == "no").alias("no"))
    rows = memories.join(health, "memory_id", "left").join(fresh, "memory_id", "left").join(votes, "memory_id", "left").na.fill(0, ["yes", "no", "retrieval_count"])
    rows = rows.withColumns({
        "recency": F.exp(-intervals.age_days(F.col("created_at"), at) / 90),
        "usage": F.least(F.lit(1.0), F.log1p("retrieval_count") / F.log(F.lit(21.0))),
        "feedback": (F.col("yes") + 1) / (F.col("yes") + F.col("no") + 2),
        "freshness": F.coalesce("freshness", F.lit(0.55)),
    })
    # Rounded once: rounded parts would make exact halves of the last place.
    rows = rows.withColumn("health_score", F.round(sum((F.col(c) * w for c, w in PARTS.items()), F.lit(0.0)), 6))
    recent = F.col("last_retrieved_at").isNotNull() & (F.floor(intervals.age_days(F.col("last_retrieved_at"), at)) <= 7)
    warmth = F.when(F.col("temperature") == "archived", "archived").when((F.col("health_score") >= 0.75) | recent, "hot").when(F.col("health_score") >= 0.45, "warm").otherwise("cold")
    by = lambda sign: F.array_max(F.array(*[F.struct((sign * F.col(c)).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(PARTS)]))["name"]
    return rows.withColumn("temperature", warmth).withColumn("strongest", by(1)).withColumn("weakest", by(-1)).select("memory_id", *PARTS, "health_score", "temperature", "strongest", "weakest")


def due(memories: DataFrame, at: Column) -> DataFrame:
    """Memories to expire, with the reason: validity before time to live."""
    ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= at)
    dead = ~intervals.lives(F.col("created_at"), F.col("ttl_seconds"), at)
    return memories.where(F.col("status").isin("active", "candidate")).where(ended | dead).select("memory_id", F.when(ended, "valid_to").otherwise("ttl").alias("reason"))


def counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows of every value of the domain, zeros too."""
    names = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    return names.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def provenance_rate(memories: DataFrame, sourced: DataFrame) -> DataFrame:
    """Share of active memories that have a source; 1 when none is active."""
    active = memories.where("status = 'active'").select("memory_id")
    marked = active.join(sourced.select("memory_id").distinct().withColumn("has", F.lit(1)), "memory_id", "left")
    return marked.agg(F.coalesce(F.try_divide(F.count("has"), F.count("*")), F.lit(1.0)).alias("provenance_rate"), F.count("*").alias("active"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule does not hold."""
    one = rows.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])))
