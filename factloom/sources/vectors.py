"""A vector index that is kept by namespace: coarse cells in Parquet, probed by partition, checked against its table.

A namespace's vectors are dealt to cells by their nearest centroid. Centroids are fitted on a bounded sample (SAMPLE vectors,
taken by hash); every vector is in the index. A search scores the vectors of each query's nearest cells exactly. How many
cells that are is measured when the index is made: as few as find RECALL of the true neighbours of PROBED sample vectors.
A version is written whole beside the older ones and a line in the manifest, written last, makes it the namespace's current
one; other namespaces aren't touched. Where the index holds not the rows that the table has, a search is exact instead.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.sources.shared import exists, segment
from factloom.sources.tables import upsert

#: Vectors that centroids are fitted on, rounds of fitting, sample queries that probes are measured with, the wanted share found.
SAMPLE, ROUNDS, PROBED, RECALL = 20_000, 8, 200, 0.95
#: Vectors of a cell that one task scores.
PART = 4096
ROWS, MANIFEST = "memory_id long, embedding array<double>, cell int", "namespace string, version long, items long, checksum string, dimensions int, probes int, centroids array<array<double>>"


def checksum(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a sum that changes with any id or vector and with repeats, in whatever order."""
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("memory_id", F.transform("embedding", lambda x: x.cast("double"))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return one["n"], one["sum"]


def _normal(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64).reshape(len(rows), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by spherical k-means, from evenly spread starts."""
    found = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (sample @ found.T).argmax(axis=1)
        for c in range(cells):
            own = sample[near == c]
            if len(own):
                found[c] = own.mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def status(self) -> dict[str, dict]:
        """The current version of every namespace."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return {}
        rows = self.spark.read.schema(f"{MANIFEST}, seg string").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest").collect()
        out: dict[str, dict] = {}
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["version"]):
            out[r["namespace"]] = r
        return out

    def _line(self, namespace: str, items: int, total: str, dimensions: int | None, probes: int, centroids: np.ndarray, seg: str) -> None:
        version = 1 + max((r["version"] for r in self.status().values()), default=0)
        row = (namespace, version, items, total, dimensions, probes, centroids.tolist())
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/seg={seg}")

    def rows(self, namespace: str, cells: list[int] | None = None) -> DataFrame:
        """memory_id, embedding, cell of a namespace, or of some of its cells only."""
        line = self.status().get(namespace)
        found = segment(self.spark, f"{self.path}/rows", [line["seg"]] if line and line["items"] else [], ROWS).drop("seg")
        return found if cells is None else found.where(F.col("cell").isin(cells))

    def rebuild(self, namespace: str, vectors: DataFrame) -> None:
        """A new version of these vectors (memory_id, embedding); rows with null, non-finite or zero vectors are not found by cosine and stay out."""
        own = searchable(vectors)
        items, total = checksum(own)
        seg = uuid.uuid4().hex
        if not items:
            self._line(namespace, 0, total, None, 0, np.zeros((0, 0)), seg)
            return
        sample = own.orderBy(F.xxhash64("memory_id"), "memory_id").limit(SAMPLE).collect()  # bounded
        dimensions = len(sample[0]["embedding"])
        same = _normal([r["embedding"] for r in sample if len(r["embedding"]) == dimensions])
        centroids = fitted(same, max(1, min(4096, int(items**0.5), len(same))))

        def nearest(batches):
            for frame in batches:
                fit = frame.embedding.map(len) == dimensions
                cell = np.full(len(frame), -1, np.int32)  # of another size: a cell that every search of that size reads
                if fit.any():
                    cell[fit.to_numpy()] = (np.stack(frame.embedding[fit].to_numpy()) @ centroids.T).argmax(axis=1)
                yield frame.assign(cell=cell)

        dealt = own.select("memory_id", "embedding").mapInPandas(nearest, ROWS)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt.repartitionByRange(parts, "cell", "memory_id").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/seg={seg}")
        probes = self._probes(seg, same, centroids)
        self._line(namespace, items, total, dimensions, probes, centroids, seg)

    def _probes(self, seg: str, sample: np.ndarray, centroids: np.ndarray, k: int = 5) -> int:
        """As few cells as find RECALL of the k nearest of some sample vectors among all rows."""
        asked = sample[:: max(1, len(sample) // PROBED)][:PROBED]
        rows = segment(self.spark, f"{self.path}/rows", [seg], ROWS)
        queries = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>")
        true = retrieval.cosine_top(rows, queries, k).join(rows.select("memory_id", "cell"), "memory_id").select("query_id", "cell").collect()  # k rows a sample query
        order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # place of each cell for each query
        places = np.sort([order[r["query_id"], r["cell"]] if r["cell"] >= 0 else 0 for r in true])
        return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))))]) + 1 if len(places) else len(centroids)

    def upsert(self, namespace: str, vectors: DataFrame) -> None:
        """Puts vectors in, in place of those of equal id."""
        self.rebuild(namespace, upsert(self.rows(namespace).select("memory_id", "embedding"), _plain(vectors), ["memory_id"]))

    def clear(self, namespace: str) -> None:
        self._line(namespace, 0, "0", None, 0, np.zeros((0, 0)), uuid.uuid4().hex)

    def fits(self, namespace: str, table: DataFrame) -> bool:
        """Whether the namespace holds just the table's vectors."""
        line = self.status().get(namespace)
        return bool(line) and (line["items"], line["checksum"]) == checksum(searchable(table))

    def search(self, namespace: str, asked: DataFrame, k: int, table: DataFrame) -> tuple[DataFrame, bool]:
        """(query_id, memory_id, score): the k best found, and whether the index gave them; if it doesn't fit the table, they are exact.

        asked: query_id, embedding.
        """
        if not self.fits(namespace, table):
            return retrieval.cosine_top(table, asked, k), False
        line = self.status()[namespace]
        centroids, probes = np.array(line["centroids"]), line["probes"]

        def cells(batches):
            for frame in batches:
                own = [np.argsort(-(centroids @ np.asarray(v)), kind="stable")[:probes].tolist() if len(v) == line["dimensions"] else [] for v in frame.embedding]
                yield frame.assign(cell=[[*c, -1] for c in own]).explode("cell").astype({"cell": "int32"})

        dealt = searchable(asked, "query_id").mapInPandas(cells, "query_id long, embedding array<double>, cell int")
        wanted = [r["cell"] for r in dealt.select("cell").distinct().collect()]  # cells, at most 4097
        rows = self.rows(namespace, wanted)
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        left = dealt.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("memory_id"), F.col("parts")).cast("int")).drop("parts")

        def score(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"query_id": [], "memory_id": [], "score": []}).astype({"query_id": "int64", "memory_id": "int64", "score": "float64"})]
            for size, own in queries.groupby(queries.embedding.map(len)):
                fit = rows[rows.embedding.map(len) == size].sort_values("memory_id")
                if len(fit):
                    scores = np.round((_normal(own.embedding.tolist()) @ _normal(fit.embedding.tolist()).T + 1) / 2, 12)
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    found.append(pd.DataFrame({"query_id": np.repeat(own.query_id.to_numpy(), best.shape[1]), "memory_id": fit.memory_id.to_numpy()[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
            return pd.concat(found, ignore_index=True)

        scored = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(score, "query_id long, memory_id long, score double")
        return retrieval.best(scored, k).select("query_id", "memory_id", "score"), True


def _plain(rows: DataFrame, key: str = "memory_id") -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


def searchable(rows: DataFrame, key: str = "memory_id") -> DataFrame:
    """key and embedding in double, of the rows that have a direction."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return _plain(rows, key).where(F.coalesce(fine, F.lit(False)))


def kept(vectors: DataFrame, path: str, namespace: str) -> VectorIndex:
    """The index of these vectors: the one that is there if it holds them, else one made anew."""
    index = VectorIndex(vectors.sparkSession, path)
    if not index.fits(namespace, vectors):
        index.rebuild(namespace, vectors)
    return index
