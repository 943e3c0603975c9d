"""Exact top-k search by inner product with paged M-trees.

Inner products are no metric, so every vector gets one more component that gives all vectors the norm of the longest; with a
query's extra component zero, the Euclidean distance falls as the inner product rises. Vectors are dealt into shards by hash;
each shard is an M-tree of a routing page and leaf pages of about LEAF vectors: routing objects are vectors far from each other,
with the covering radius of their page, and each vector keeps its distance to its page's object. A query opens pages best
first. The triangle inequality bounds a page's scores by radius and a vector's by its stored distance, and whatever lies below
the k-th best score so far is not computed. Queries of a block that open the same page do so together, by one matrix product.
Scores are integers and exact; bounds have a slack for rounding, and nothing is left out at equality.

The query set is a stated part of all rows. Blocks of queries meet every shard, and each meeting is one task's work, bounded by
SHARD vectors and BLOCK queries.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; vectors of fewer
components count as zero beyond them; a query does not find rows of its own id; of repeated rows each is found, and they ask once; ties go to
the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard, queries of a block, entries of a leaf page.
SHARD, BLOCK, LEAF = 8192, 4096, 128
#: Score and id of a place that is not taken yet.
NOTHING, NO_ID = -(1 << 62), (1 << 63) - 1


class MTree:
    """vectors: rows of integers. computed counts the vectors whose score was computed, summed over queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.computed = ids[order], vectors[order], 0
        self.real = self.vectors.astype(np.float64)
        self.limit = float(np.abs(self.real).max(initial=0))
        norms = (self.real**2).sum(axis=1)
        self.longest = float(norms.max(initial=0))
        full = np.concatenate((self.real, np.sqrt(self.longest - norms)[:, None]), axis=1)
        # Routing objects: each the vector farthest from those before it.
        fan = max(1, -(-len(ids) // leaf))
        objects, part, near = [], np.zeros(len(ids), int), np.full(len(ids), np.inf)
        while len(objects) < fan and len(ids):
            place = int(near.argmax()) if objects else 0
            if objects and near[place] == 0:
                break
            away = np.sqrt(((full - full[place]) ** 2).sum(axis=1))
            part[away < near] = len(objects)
            near = np.minimum(near, away)
            objects.append(place)
        self.objects, self.pages = [], []
        for j, place in enumerate(objects):
            rows = np.flatnonzero(part == j)
            rows = rows[np.argsort(near[rows], kind="stable")]
            for piece in np.array_split(rows, max(1, len(rows) // (2 * leaf))):  # a page of many vectors is split by distance
                self.objects.append(place)
                self.pages.append(piece)
        self.to_object = [near[p] for p in self.pages]
        self.radii = np.array([d.max(initial=0) for d in self.to_object])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best scores and ids of each query, best first, without rows of its own id; NOTHING and NO_ID if there are fewer."""
        best, found = np.full((len(queries), k), NOTHING, np.int64), np.full((len(queries), k), NO_ID, np.int64)
        if not self.pages or not len(queries):
            return best, found
        q = queries.astype(np.float64)
        exact = self.limit * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**52
        total = (q**2).sum(axis=1) + self.longest
        slack = 1e-9 * total + 1e-6
        most = lambda least, i: (total[i, None] - np.maximum(least - slack[i, None], 0) ** 2) / 2 + slack[i, None]  # noqa: E731  score at this distance or beyond
        away = np.sqrt(np.maximum(total[:, None] - 2 * q @ self.real[self.objects].T, 0))
        bounds = most(away - self.radii, np.arange(len(q)))
        order = np.argsort(-bounds, axis=1, kind="stable")
        alive = np.arange(len(q))
        for turn in range(len(self.pages)):
            page = order[alive, turn]
            more = bounds[alive, page] >= best[alive, -1]  # pages come best first, so whoever stops here is done
            alive, page = alive[more], page[more]
            if not len(alive):
                break
            for p in np.unique(page).tolist():
                self._open(p, alive[page == p], queries, q, own, exact, away, most, best, found)
        return best, found

    def _open(self, p, who, queries, q, own, exact, away, most, best, found) -> None:
        floor = best[who, -1]
        hopeful = most(np.abs(away[who, p, None] - self.to_object[p]), who) >= floor[:, None]
        rows = self.pages[p][hopeful.any(axis=0)]
        if not len(rows):
            return
        self.computed += len(who) * len(rows)
        if exact:
            scores = (q[who] @ self.real[rows].T).astype(np.int64)
        else:
            scores = (queries[who].astype(object) @ self.vectors[rows].T.astype(object)).astype(np.int64)
        scores[self.ids[rows] == own[who, None]] = NOTHING
        gain = np.flatnonzero((scores >= floor[:, None]).any(axis=1))
        if not len(gain):
            return
        all_scores = np.concatenate((best[who[gain]], scores[gain]), axis=1)
        all_ids = np.concatenate((found[who[gain]], np.broadcast_to(self.ids[rows], (len(gain), len(rows)))), axis=1)
        all_ids = np.where(all_scores == NOTHING, NO_ID, all_ids)
        top = np.lexsort((all_ids, -all_scores), axis=1)[:, : best.shape[1]]
        best[who[gain]], found[who[gain]] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(table: DataFrame, queries: Column, k: int = 5, scale: int = 256, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` selects, its k best other rows.

    table: vec_id, embedding. Components are floor(scale * x), in double.
    """
    whole = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is not less
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"), F.xxhash64("vec_id", "embedding").alias("place"), queries.alias("asks"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, -(-size["n"] // shard)), max(1, -(-size["q"] // block))
    data = rows.select("vec_id", "vector", F.pmod("place", F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    # Rows that repeat id and vector ask once; rows of one id with different vectors ask each.
    asked = rows.where("asks").dropDuplicates(["vec_id", "place"]).select(F.col("vec_id").alias("query_id"), F.col("place").alias("asked"), "vector", F.pmod("place", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def run(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: dict | list = []
        if len(data) and len(asked):
            width = max(data.vector.map(len).max(), asked.vector.map(len).max())
            tree = MTree(data.vec_id.to_numpy(), _matrix(data.vector, width))
            scores, ids = tree.search(_matrix(asked.vector, width), asked.query_id.to_numpy(), k)
            i, j = np.nonzero(ids != NO_ID)
            found = {"query_id": asked.query_id.to_numpy()[i], "asked": asked.asked.to_numpy()[i], "vec_id": ids[i, j], "score": scores[i, j]}
        return pd.DataFrame(found, columns=["query_id", "asked", "vec_id", "score"]).astype("int64")

    part = data.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(run, "query_id long, asked long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
