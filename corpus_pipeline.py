"""Corpus preparation: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the shared folder and
reads it again for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import op1_substring_dedup, op2_pii, op3_near_dedup, op4_packing, op10_language
from factloom.llm.common import fresh, stored, tune
from factloom.llm.queries import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model accepts; texts without a letter and outliers of every language go."""
    tune(spark)
    models = op10_language.fit(docs)
    return docs.where(op10_language.language(models, spark)["accepted"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): that of least id, and least text hash.

    Groups are decided by id and text, as an id may have several texts. Rows without an id stay; of rows that repeat id and
    text one stays.
    """
    found = stored(op3_near_dedup.by_text(docs, size=5, percent=80), "groups")
    of, key = fresh(docs, "of", "of_text")
    keys = [F.col("doc_id").alias(of), F.col("text_key").alias(key)]
    same = (F.col("doc_id").cast("long") == F.col(of)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(key))
    # Always a sort-merge join: what goes grows with the corpus, so it is never broadcast.
    kept = docs.join(found.where("not least and doc_id is not null").select(*keys).distinct().hint("merge"), same, "left_anti").select(*docs.columns)
    twice = found.where("doc_id is not null").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(of, key)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, same, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").select(*docs.columns).unionByName(again)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages stay in one document only."""
    return _counted(op1_substring_dedup.without_repeats(docs))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by marks of its kind."""
    return _counted(op2_pii.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, as few as found."""
    return op4_packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: SQL expresses none of the stages fully; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
