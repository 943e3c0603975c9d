"""The life of claims and memories: extraction with evidence, activation, transitions, status folds and grounded proposals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Technologies, the words of each rule, subjects by word, and what each category claims.
TECHNOLOGY = r"(?i)\b(postgres(?:ql)?|sqlite3?|mysql|redis|fast\s*api|django|react|pnpm|npm|yarn)\b"
RULES = {
    "forbidden": r"(?i)\b(?:do not|don't|never|must not|forbid)\b|不要|不得|禁止",
    "prefers": r"(?i)\b(?:prefer|preferred|preference)\b|偏好",
    "uses": r"(?i)\b(?:use|uses|using|adopt|choose|chose|decided?)\b|使用|采用|决定|改为",
    "failed_because": r"(?i)\b(?:failed|failure|caused|because)\b|失败|因为|导致",
    "implemented_in": r"(?i)implement|located|moved",
}
CODE_PATH = r"(?<![\w.])(?:[\w.-]+/)+[\w.#+-]+"
SUBJECTS = [
    ("project.production_database", r"(?i)database|数据库|postgres|sqlite|mysql"), ("project.backend_framework", r"(?i)framework|框架|fastapi|django"),
    ("project.package_manager", r"(?i)package manager|包管理|pnpm|npm|yarn"), ("project.dependencies.redis", r"(?i)redis"),
]
BY_CATEGORY = {"decision": "uses", "constraint": "forbidden", "preference": "prefers", "failure": "failed_because", "implementation": "implemented_in"}
CONFIDENCE = {"technology": 0.88, "path": 0.82, "failure": 0.78, "whole": 0.65}
SEGMENT = r"[^\n.!?。！？;；]+[\n.!?。！？;；]?"


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("quote", T.StringType())])))
def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences with the places where they begin and end in the text, without the blanks around them."""
    import re

    cut = re.compile(SEGMENT)
    for batch in batches:
        rows = []
        for text in batch.fillna(""):
            found = []
            for m in cut.finditer(text):
                quote = m[0].strip()
                if quote:
                    start = m.start() + m[0].index(quote[0])
                    found.append({"start": start, "end": start + len(quote), "quote": quote})
            rows.append(found)
        yield pd.Series(rows)


def technology(name: Column) -> Column:
    """The normal name of a technology."""
    plain = F.regexp_replace(F.lower(name), r"\s+", "")
    return F.when(plain == "postgres", "postgresql").when(plain == "sqlite3", "sqlite").otherwise(plain)


def subject_of(text: Column, otherwise: Column) -> Column:
    out = otherwise
    for name, words in reversed(SUBJECTS):
        out = F.when(F.regexp_like(text, F.lit(words)), F.lit(name)).otherwise(out)
    return out


def extracted(texts: DataFrame) -> DataFrame:
    """memory_id, subject, predicate, object, start, end, confidence: claims of each text, each with the sentence that shows it.

    A sentence that forbids claims each technology it names, one that prefers the last, one that uses the first; it may also
    say where something is implemented, or why it failed. A text without a claim makes one claim of itself, by its category.
    texts: memory_id, text, category, subject.
    """
    own = texts.select("memory_id", "category", F.coalesce("subject", F.lit("project")).alias("owner"), F.trim("text").alias("source")).where("source <> ''")
    rows = own.select("memory_id", "owner", F.inline(segments("source")))
    says = {name: F.regexp_like("quote", F.lit(words)) for name, words in RULES.items()}
    named = F.transform(F.regexp_extract_all("quote", F.lit(TECHNOLOGY), F.lit(0)), technology)
    claim = lambda subject, predicate, value, kind: F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(CONFIDENCE[kind]).alias("confidence"))
    about = subject_of(F.col("quote"), F.col("owner"))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    path = F.regexp_extract("quote", CODE_PATH, 0)
    more = F.array_compact(F.array(
        F.when(says["uses"] & (F.size("named") > 0), claim(about, "uses", F.element_at("named", 1), "technology")),
        F.when(says["implemented_in"] & (path != ""), claim(F.col("owner"), "implemented_in", path, "path")),
        F.when(says["failed_because"], claim(about, "failed_because", F.col("quote"), "failure")),
    ))
    found = (
        F.when(says["forbidden"] & (F.size("named") > 0), F.transform("named", lambda n: claim(F.concat(F.lit("project.dependencies."), n), "forbidden", n, "technology")))
        .when(says["prefers"] & (F.size("named") > 0), F.array(claim(about, "prefers", F.element_at("named", -1), "technology")))
        .otherwise(F.coalesce(more, none))
    )
    shown = rows.withColumn("named", named).select("memory_id", "start", "end", F.inline(found))
    # The same claim said again counts once, with its last sentence.
    shown = shown.groupBy("memory_id", "subject", "predicate", "object").agg(F.max(F.struct("start", "end", "confidence")).alias("last")).select("memory_id", "subject", "predicate", "object", "last.*")
    predicate = F.lit("states")
    for category, name in BY_CATEGORY.items():
        predicate = F.when(F.col("category") == category, name).otherwise(predicate)
    whole = own.join(shown.select("memory_id").distinct(), "memory_id", "left_anti").select(
        "memory_id", subject_of(F.col("source"), F.col("owner")).alias("subject"), predicate.alias("predicate"), F.col("source").alias("object"), F.lit(0).alias("start"), F.length("source").alias("end"), F.lit(CONFIDENCE["whole"]).alias("confidence")
    )
    return shown.unionByName(whole)


def activated(claims: DataFrame, strategies: DataFrame) -> DataFrame:
    """(claim_id, status): what becomes of an identity's accepted claims when its latest is activated against others of another object.

    supersede ends the others, keep_both contests all, reject refuses the latest. strategies: identity_id, strategy.
    """
    order = Window.partitionBy("identity_id").orderBy(F.desc("recorded_at"), F.desc("claim_id"))
    own = claims.where("status = 'accepted'").withColumn("place", F.row_number().over(order)).withColumn("newest", F.first("object_value").over(order))
    rivals = own.where((F.col("place") > 1) & (F.col("object_value") != F.col("newest"))).select("identity_id", "claim_id")
    latest = own.where("place = 1").join(rivals.select("identity_id").distinct(), "identity_id", "left_semi").select("identity_id", "claim_id")
    both = rivals.withColumn("latest", F.lit(False)).unionByName(latest.withColumn("latest", F.lit(True))).join(strategies, "identity_id")
    status = F.when(F.col("strategy") == "keep_both", "contested").when((F.col("strategy") == "supersede") & ~F.col("latest"), "superseded").when((F.col("strategy") == "reject") & F.col("latest"), "rejected")
    return both.select("claim_id", status.alias("status")).where("status is not null")


#: The status that each event gives; the others leave it as it is. What is forgotten stays so.
STATUS_OF = {"propose": "candidate", "confirm": "active", "reject": "rejected", "forget": "forgotten"}


def folded(events: DataFrame) -> DataFrame:
    """(memory_id, status, updates): each memory's status after all its events. events: memory_id, event_id, ts, action."""
    status = F.lit(None).cast("string")
    for action, value in STATUS_OF.items():
        status = F.when(F.col("action") == action, value).otherwise(status)
    forgotten = F.bool_or(F.col("action") == "forget")
    last = F.max_by("gives", F.when(F.col("gives").isNotNull(), F.struct("ts", "event_id")))
    out = events.withColumn("gives", status).groupBy("memory_id").agg(forgotten.alias("gone"), last.alias("last"), F.count_if(F.col("action") == "update").alias("updates"))
    return out.select("memory_id", F.when(F.col("gone"), "forgotten").otherwise(F.coalesce("last", F.lit("candidate"))).alias("status"), "updates")


def contested(pairs: DataFrame, claims: DataFrame, memories: DataFrame) -> DataFrame:
    """pairs (left_claim_id, right_claim_id) with outcome: contested only if both claims are accepted and both memories active."""
    live = claims.where("status = 'accepted'").join(memories.where("status = 'active'").select("memory_id"), "memory_id", "left_semi").select("claim_id")
    left, right = live.select(F.col("claim_id").alias("left_claim_id"), F.lit(True).alias("l")), live.select(F.col("claim_id").alias("right_claim_id"), F.lit(True).alias("r"))
    both = pairs.join(left, "left_claim_id", "left").join(right, "right_claim_id", "left")
    return both.select("left_claim_id", "right_claim_id", F.when(F.col("l") & F.col("r"), "contested").otherwise("unchanged").alias("outcome"))


def grounded(episodes: DataFrame, proposals: DataFrame, minimum_sources: int = 3, minimum_days: float = 7) -> DataFrame:
    """(subject_entity_id, predicate, verdict) of a judge's proposals, checked against the episodes that it was given.

    foreign: an id that the cluster doesn't have; overlap: an id for and against; assertion: the support isn't just the dominant
    assertion; thin: too few independent sources or days; else contested or candidate.
    episodes: subject_entity_id, predicate, claim_id, memory_id, object_value, polarity, source_ref, captured_at;
    proposals: subject_entity_id, predicate, role (for or against), memory_id.
    """
    slot = ["subject_entity_id", "predicate"]
    counted = episodes.groupBy(*slot, "object_value", "polarity").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"))
    place = F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc("n"), "first", "object_value", "polarity"))
    dominant = counted.withColumn("place", place).where("place = 1").select(*slot, F.col("object_value").alias("main"), F.col("polarity").alias("side"))
    sides = counted.groupBy(*slot).agg((F.count("*") > 1).alias("divided"))
    named = proposals.groupBy(*slot, "memory_id").agg(F.bool_or(F.col("role") == "for").alias("supports"), F.bool_or(F.col("role") == "against").alias("counters"))
    known = episodes.select(*slot, "memory_id").distinct().withColumn("known", F.lit(True))
    ids = named.join(known, [*slot, "memory_id"], "left").groupBy(*slot).agg(F.bool_or(F.col("known").isNull()).alias("foreign"), F.bool_or(F.col("supports") & F.col("counters")).alias("overlap"), F.bool_or("counters").alias("against"))
    support = episodes.join(named.where("supports").select(*slot, "memory_id"), [*slot, "memory_id"], "left_semi").join(dominant, slot)
    pure = support.groupBy(*slot).agg(F.bool_and((F.col("object_value") == F.col("main")) & (F.col("polarity") == F.col("side"))).alias("pure"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    first = support.groupBy(*slot, "source_ref").agg(F.min("captured_at").alias("captured_at"))
    span = first.groupBy(*slot).agg(F.count("*").alias("sources"), ((micros(F.max("captured_at")) - micros(F.min("captured_at"))) / 86_400_000_000.0).alias("days"))
    out = ids.join(pure, slot, "left").join(span, slot, "left").join(sides, slot, "left")
    verdict = (
        F.when(F.col("foreign"), "foreign").when(F.col("overlap"), "overlap").when(~F.coalesce("pure", F.lit(False)), "assertion").when((F.col("sources") < minimum_sources) | (F.col("days") < minimum_days), "thin")
        .when(F.col("against") | F.col("divided"), "contested").otherwise("candidate")
    )
    return out.select(*slot, verdict.alias("verdict"))


def refused(claims: DataFrame) -> DataFrame:
    """claims (source, start, end, quote, predicate) with the first reason against each, or null."""
    exact = F.substring(F.col("source"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")
    reason = F.when(F.col("end") > F.length("source"), "evidence_out_of_bounds").when(~exact, "evidence_quote_mismatch").when(F.trim("predicate") == "", "empty_predicate")
    return claims.withColumn("reason", reason)
