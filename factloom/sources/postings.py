"""A lexical index that is kept, changed in place of its rows and read by the asked terms.

Every change is a segment: postings by term, documents with their terms by id, the places of the rows that it makes void
(dead), and by how much it changes each term's document frequency. A line in the manifest, written last, makes it part of
the index, with the change of the number of documents and of their length. So a change costs what it touches: frequencies and
the average length are sums over segments, void postings are left out when read, and compaction writes all live rows as one
segment that replaces the others. A change that broke off left no line and is written again; one that is repeated under its
name is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import text
from factloom.operators.retrieval import FIELD_WEIGHTS, postings
from factloom.sources.shared import exists, segment

#: Folders of postings by hash of their term, of which a search reads those of its terms.
BUCKETS = 32
POSTINGS, DOCUMENTS, DEAD, CHANGES = "memory_id long, term string, tf double, length int, bucket int", "memory_id long, length int, terms array<string>", "memory_id long, dead_seg string", "term string, change long, bucket int"
MANIFEST = "n long, length long, dead long, replaces array<string>"


def bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, weights: dict[str, float] | None = None):
        self.spark, self.path, self.weights = spark, path, weights or FIELD_WEIGHTS

    # --- what is there -----------------------------------------------------------------------------------------------

    def lines(self) -> dict[str, dict]:
        """The manifest: live segments with what they changed. Its size is the number of changes since compaction."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return {}
        rows = {r["seg"]: r.asDict() for r in self.spark.read.schema(f"{MANIFEST}, seg string").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest").collect()}
        gone = {name for r in rows.values() for name in r["replaces"] or []}
        return {name: r for name, r in rows.items() if name not in gone}

    def _read(self, kind: str, schema: str, lines: dict) -> DataFrame:
        return segment(self.spark, f"{self.path}/{kind}", sorted(lines), schema)

    def count(self) -> int:
        return sum(r["n"] for r in self.lines().values())

    def _live(self, rows: DataFrame, lines: dict) -> DataFrame:
        if not sum(r["dead"] for r in lines.values()):
            return rows
        dead = self._read("dead", DEAD, lines).select("memory_id", F.col("dead_seg").alias("seg")).distinct()
        return rows.join(dead, ["memory_id", "seg"], "left_anti")

    def asked(self, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of the asked terms (column term): live postings (memory_id, term, tf, length) and df (term, df); and the row (n, average)."""
        lines, wanted = self.lines(), terms.select("term").distinct()
        places = [r["bucket"] for r in wanted.select(bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
        pick = lambda rows: rows.where(F.col("bucket").isin(places)).join(wanted, "term", "left_semi")
        rows = self._live(pick(self._read("postings", POSTINGS, lines)), lines).select("memory_id", "term", "tf", "length")
        df = pick(self._read("changes", CHANGES, lines)).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
        n, length = (sum(r[c] for r in lines.values()) for c in ("n", "length"))
        whole = self.spark.createDataFrame([(n, length / n if n else None)], "n long, average double")
        return rows, df, whole

    # --- changes -----------------------------------------------------------------------------------------------------

    def _put(self, rows: DataFrame, kind: str, name: str, by: list[str] | None = None) -> None:
        path = f"{self.path}/{kind}/seg={name}"
        if by:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            # By range, so that a term of very many documents is written by many tasks.
            rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).write.mode("overwrite").partitionBy("bucket").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(path)

    def _line(self, name: str, n: int, length: int, dead: int, replaces: list[str]) -> None:
        self.spark.createDataFrame([(n, length, dead, replaces)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/seg={name}")

    def rebuild(self, memories: DataFrame, name: str) -> None:
        """One segment of these memories in place of all that is there."""
        before = sorted(self.lines())
        self._put(postings(memories, weights=self.weights).withColumn("bucket", bucket()).select("memory_id", "term", "tf", F.col("length").cast("int").alias("length"), "bucket"), "postings", name, ["bucket", "term", "memory_id"])
        self._put(self._documents(memories), "documents", name)
        self._put(self.spark.createDataFrame([], DEAD), "dead", name)
        mine = segment(self.spark, f"{self.path}/documents", [name], DOCUMENTS)
        changes = mine.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("change"))
        self._put(changes.withColumn("bucket", bucket()), "changes", name, ["bucket", "term"])
        t = mine.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        self._line(name, t["n"], t["length"], 0, before)

    def _documents(self, rows: DataFrame) -> DataFrame:
        fields = F.flatten(F.array(*[text.terms(F.coalesce(F.col(f), F.lit(""))) for f in self.weights]))
        return rows.select(F.col("memory_id").cast("long").alias("memory_id"), F.size(fields).alias("length"), F.array_distinct(fields).alias("terms"))

    def change(self, rows: DataFrame, name: str, deleted: str | None = None, order: str | None = None) -> None:
        """Puts memories in, in place of those of equal id; where the column `deleted` is true the memory goes.

        Of several rows of an id the last by `order` counts. name: of the segment, such as a batch's number.
        """
        lines = self.lines()
        if name in lines or exists(self.spark, f"{self.path}/manifest/seg={name}"):
            return
        if order:
            rows = rows.withColumn("place_", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc(order)))).where("place_ = 1").drop("place_")
        goes = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        new, ids = rows.where(~goes), rows.select(F.col("memory_id").cast("long").alias("memory_id")).distinct()
        self._put(postings(new, weights=self.weights).withColumn("bucket", bucket()).select("memory_id", "term", "tf", F.col("length").cast("int").alias("length"), "bucket"), "postings", name, ["bucket", "term", "memory_id"])
        self._put(self._documents(new), "documents", name)
        mine = segment(self.spark, f"{self.path}/documents", [name], DOCUMENTS)
        was = self._live(self._read("documents", DOCUMENTS, lines), lines).join(ids, "memory_id", "left_semi") if lines else mine.where(F.lit(False))
        self._put(was.select("memory_id", F.col("seg").alias("dead_seg")), "dead", name)
        moved = mine.select(F.explode("terms").alias("term"), F.lit(1).alias("by")).unionByName(was.select(F.explode("terms").alias("term"), F.lit(-1).alias("by")))
        changes = moved.groupBy("term").agg(F.sum("by").alias("change")).where("change <> 0")
        self._put(changes.withColumn("bucket", bucket()), "changes", name, ["bucket", "term"])
        total = mine.select("length", F.lit(1).alias("n"), F.lit(0).alias("dead")).unionByName(was.select((-F.col("length")).alias("length"), F.lit(-1).alias("n"), F.lit(1).alias("dead")))
        t = total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "length", "dead")]).first()
        self._line(name, t["n"], t["length"], t["dead"], [])

    def compact(self, name: str) -> None:
        """All live rows as one segment in place of all others."""
        lines = self.lines()
        if name in lines or not lines:
            return
        self._put(self._live(self._read("postings", POSTINGS, lines), lines).drop("seg"), "postings", name, ["bucket", "term", "memory_id"])
        self._put(self._live(self._read("documents", DOCUMENTS, lines), lines).drop("seg"), "documents", name)
        self._put(self.spark.createDataFrame([], DEAD), "dead", name)
        self._put(self._read("changes", CHANGES, lines).groupBy("term", "bucket").agg(F.sum("change").alias("change")).where("change <> 0"), "changes", name, ["bucket", "term"])
        self._line(name, *(sum(r[c] for r in lines.values()) for c in ("n", "length")), 0, sorted(lines))

    def missing(self, memories: DataFrame) -> DataFrame:
        """Memories that the index doesn't hold."""
        lines = self.lines()
        held = self._live(self._read("documents", DOCUMENTS, lines), lines).select("memory_id")
        return memories.join(held, "memory_id", "left_anti")

    def keep(self, changes: DataFrame, checkpoint: str, deleted: str | None = None, order: str | None = None, compact_after: int = 20) -> StreamingQuery:
        """Follows a stream of memories: each batch is a change; when so many have gathered they are compacted."""

        def write(batch: DataFrame, number: int) -> None:
            self.change(batch, f"batch{number}", deleted, order)
            if len(self.lines()) > compact_after:
                self.compact(f"compact{number}")

        return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(memories: DataFrame, path: str, weights: dict[str, float] | None = None) -> PostingIndex:
    """The index of these memories: the one that is there, unless it holds another number of them: then it is made anew."""
    index = PostingIndex(memories.sparkSession, path, weights)
    lines = index.lines()
    if not lines or sum(r["n"] for r in lines.values()) != memories.count():
        index.rebuild(memories, f"all{uuid.uuid4().hex[:8]}")
    return index
