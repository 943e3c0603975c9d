"""What filters remove, lose and repeat, in every order of application, from packed bitmaps.

Each row's failures are decided once, from its whole text, and kept as a narrow table beside its part and labels. Each
partition then builds a bitmap index of it: a bitset for every filter and label, with the rows of a part side by side, so
that a part is a run of whole bytes. For every set of filters that may come before (a prefix, in any order) one OR gives the
rows that are gone, and AND-NOT with each filter not in the set, with and without the labels' bitsets, is counted by
popcount. Counts are added up over partitions; the rows of an order's steps are those of their prefix and filter.

The index is held for BLOCK rows at a time, and all that leaves a partition is counts: filters x prefixes rows a part.

Failures: words: fewer than 50; variety: 100 * distinct words < 65 * words; capitals: 100 * [A-Z] > 5 * code points;
symbols: any of #$%&*|; copy: the text of a smaller id. Copies are found by the SHA-256 of texts: one aggregation gives the
smallest id of each repeated text (map-side first, so that copies in plenty are few rows), and the join that brings it back
deals hot texts to many tasks.

Defined results: a null text is empty, a null part the empty string; a row without an id has no labels, is nobody's copy and
nobody is its; rows that repeat an id and text are each counted and are no copies of each other; of several label rows of an
id any 1 counts; empty texts fail words only, and copy; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch, documents, salted_left_join, stored

FILTERS = "ABCDE"
#: Rows that a task indexes at once; parts whose counts it holds before it passes them on.
BLOCK, PARTS = 1 << 18, 4096
#: Bits of a row's byte: a filter's failure at its place, then the labels.
GOOD, TOXIC = 5, 6
COUNTS = ["n", "failing", "removed", "good_lost", "toxic_lost", "unique_fails", "gone"]

#: Runs of whitespace, as the words of a text are cut by.
SPACES = "[ \\x09-\\x0D]+"


def failures(text: Column) -> list[Column]:
    """Of filters A to D, from the text alone."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > 5 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def _bits(columns: list[Column], first: int = 0) -> Column:
    out = F.lit(0)
    for place, column in enumerate(columns, first):
        out = out + F.when(column, F.lit(1 << place)).otherwise(0)
    return out


def flagged(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part and flags (failures, good, toxic, as bits) of every row."""
    rows = documents(docs, F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")).select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(failures(F.col("text"))).alias("flags"))
    rows = scratch.stored(rows, "filter-rows")
    known = rows.where("doc_id is not null")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) * (1 << GOOD) + F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)) * (1 << TOXIC)).alias("marks")
    )
    dealt = salted_left_join(known, first, ["digest"]).select("doc_id", "part", (F.col("flags") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)).alias("flags"))
    dealt = scratch.stored(dealt, "filter-copies")
    labelled = salted_left_join(dealt, marked, ["doc_id"]).select("part", (F.col("flags") + F.coalesce("marks", F.lit(0))).alias("flags"))
    return labelled.unionByName(rows.where("doc_id is null").select("part", "flags"))


def bitmap_counts(flags: np.ndarray) -> np.ndarray:
    """COUNTS for each prefix (a set of filters as bits) and filter of the rows of one part: prefixes x filters x counts."""
    k = len(FILTERS)
    sets = [np.packbits(flags >> bit & 1) for bit in range(7)]
    fails, good, toxic = sets[:k], sets[GOOD], sets[TOXIC]
    count = lambda bits: int(np.bitwise_count(bits).sum())
    out = np.zeros((1 << k, k, len(COUNTS)), np.int64)
    covered = [np.zeros_like(good)]
    for prefix in range(1, 1 << k):
        low = (prefix & -prefix).bit_length() - 1
        covered.append(covered[prefix & (prefix - 1)] | fails[low])
    gone = [count(bits) for bits in covered]
    for prefix in range(1 << k):
        for f in range(k):
            if not prefix >> f & 1:
                hit = fails[f] & ~covered[prefix]
                alone = fails[f] & ~covered[(1 << k) - 1 - (1 << f)]
                out[prefix, f] = len(flags), count(fails[f]), count(hit), count(hit & good), count(hit & toxic), count(alone), gone[prefix | 1 << f]
    return out


def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition's rows by part, prefix and filter."""
    places = [(prefix, f) for prefix in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not prefix >> f & 1]
    held: list[pd.DataFrame] = []
    totals: dict[str, np.ndarray] = {}

    def index() -> None:
        if held:
            rows = pd.concat(held)
            held.clear()
            codes, names = pd.factorize(rows["part"])
            order = np.argsort(codes, kind="stable")
            flags = rows["flags"].to_numpy().astype(np.uint8)[order]
            ends = np.cumsum(np.bincount(codes))
            for name, start, end in zip(names, [0, *ends[:-1]], ends, strict=True):
                totals[name] = totals.get(name, 0) + bitmap_counts(flags[start:end])

    def told() -> pd.DataFrame:
        out = pd.DataFrame([(part, prefix, f, *t[prefix, f].tolist()) for part, t in totals.items() for prefix, f in places], columns=["part", "prefix", "filter", *COUNTS])
        totals.clear()
        return out

    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size >= BLOCK:
            index()
            size = 0
            if len(totals) >= PARTS:
                yield told()
    index()
    yield told()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs: doc_id, text, source. labels: doc_id, quality, toxic.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = flagged(docs, labels, scratch).select("part", F.col("flags").cast("int").alias("flags"))
        counts = rows.mapInPandas(indexed, "part string, prefix int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
        counts = stored(counts.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS]), "filter-counts")
    k = len(FILTERS)
    before = F.bit_count("prefix")
    weight = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), before + 1)
    shapley = counts.groupBy(F.col("part").alias("of_part"), F.col("filter").alias("of_filter")).agg(F.sum(weight * F.col("removed")).alias("shapley"))
    steps = [("".join(order), i + 1, sum(1 << FILTERS.index(c) for c in order[:i]), FILTERS.index(order[i])) for order in permutations(FILTERS) for i in range(k)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, prefix int, filter int")
    every = counts.join(shapley, (F.col("part") == F.col("of_part")) & (F.col("filter") == F.col("of_filter"))).join(F.broadcast(orders), ["prefix", "filter"])
    return every.select("part", "filter_order", "step", (F.col("n") - F.col("gone")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
