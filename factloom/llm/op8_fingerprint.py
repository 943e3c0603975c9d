"""MinHash fingerprints of documents.

A fingerprint is the MinHash signature of a text's five-word shingles under PERMUTATIONS universal hash functions; the share of
equal entries estimates the Jaccard similarity of the shingle sets. Bands of signatures are joined in Spark, and the Jaccard
similarity of those that meet is verified on the full sets: near_class is the smallest doc_id that such links reach. Texts of
equal sets are one node, and nodes that meet one head are compared with each other too, as near-duplicate groups are (op3). A
pair at the threshold itself shares no band with a probability of (1 - 0.8**5)**25, about 5e-5. `edited` also fingerprints each
text with its second half taken from its successor.

Successors are found without a global sort in one task: documents are dealt in ranges of doc_id, and the first document of every
range is also sent to the range before it. Texts travel deflated, as they are most of what this moves. A document's class
travels to the same range as a row of its own, right before it.

Defined results: a null text counts as empty; all texts without a word share one fingerprint, and likeness is the share of equal
entries, so it is 1 between them, though they are linked with nothing and are classes of their own; rows of one doc_id follow
one another in order of a hash of their texts, and null ids come last (their near_class is null unless linked with others); a
single document is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from factloom.llm.common import Marks, documents, partitions, tune
from factloom.llm.op3_near_dedup import by_text
from factloom.llm.shingles import shingle_hashes, signatures

SHINGLE, PERMUTATIONS = 5, 128
#: Bands and hash functions in each, and the percentage of Jaccard similarity from which texts are linked.
BANDS, WIDE = 25, 5
SIMILAR = 80
#: Ranges of doc_id for each shuffle partition.
RANGES = 3
WINDOW_CHARS = 500_000


def fingerprints(texts: list[str], size: int = SHINGLE, number: int = PERMUTATIONS) -> np.ndarray:
    return signatures(*shingle_hashes(texts, size), number)


def _hex(signature: np.ndarray) -> list[str]:
    spelled, width = signature.astype(">u2").tobytes().hex(), signature.shape[1] * 4
    return [spelled[i : i + width] for i in range(0, len(spelled), width)]


def _classed(frames):
    """The rows with a text as doc_id, halo, text, near_class: the class is that of the row without a text before."""
    near = None
    for frame in frames:
        classes = frame.near_class.astype(object).where(frame.near_class.notna(), None)
        for doc, halo, packed, found in zip(frame.doc_id, frame.halo, frame.packed, classes, strict=True):
            if packed is None:
                near = found
            else:
                yield doc, halo, zlib.decompress(packed).decode("utf-8", "surrogatepass"), near


def _windows(rows):
    """Rows in order, in groups of about WINDOW_CHARS code points, each with the first row of the next at its end."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[2])
        if chars > WINDOW_CHARS and len(held) > 1:
            yield held
            held, chars = [row], len(row[2])
    if len(held) > 1:
        yield held


@F.pandas_udf(BinaryType())
def _deflated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: zlib.compress(t.encode("utf-8", "surrogatepass"), 1))


def near_classes(docs: DataFrame, percent: int = SIMILAR, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text) and near_class of every row: bands joined, similarities verified."""
    return by_text(docs, size, percent, BANDS, WIDE).select("doc_id", "text_key", F.col("component_id").alias("near_class"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, digest of the edited text, both fingerprints, likeness to the edited text and to the successor, near_class."""
    spark = docs.sparkSession
    tune(spark)
    low = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(low))
    rows = documents(docs).select(key.alias("key"), "doc_id", Marks.key().alias("text_key"), "text")
    ids = rows.select("key")
    ranges = RANGES * partitions(spark)
    # As many bounds as there are ranges, whatever the input.
    bounds = np.unique(np.array(ids.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) or [0.0]))
    shared = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(len(shared.value) - np.searchsorted(shared.value, keys.to_numpy().astype(float), side="left")).astype("int32")

    heads = {r["range"]: r["head"] for r in ids.groupBy(placed("key").alias("range")).agg(F.max("key").alias("head")).collect()}  # a row a range
    order = sorted(heads)
    before = {order[i]: order[i - 1] for i in range(len(order))}
    first = spark.createDataFrame([(h, before[r]) for r, h in heads.items()], "head long, to_range int")
    own, halo = (F.struct(F.lit(again).alias("halo"), F.col(column).alias("range")) for again, column in ((False, "range"), (True, "to_range")))
    whole = (
        rows.withColumn("range", placed("key"))
        .join(F.broadcast(first), F.col("key") == F.col("head"), "left")
        .withColumn("to", F.when(F.col("to_range").isNull(), F.array(own)).otherwise(F.array(own, halo)))
        .select("doc_id", _deflated("text").alias("packed"), "key", "text_key", F.lit(None).cast("long").alias("near_class"), F.inline("to"))
    )
    classes = near_classes(docs).select("doc_id", F.lit(None).cast("binary").alias("packed"), key.alias("key"), "text_key", "near_class", F.lit(False).alias("halo"))
    dealt = (
        whole.unionByName(classes.withColumn("range", placed("key")))
        .repartition(partitions(spark), "range")
        .sortWithinPartitions("range", "halo", F.desc("key"), "text_key", F.asc_nulls_first("packed"))
        .select("doc_id", "halo", "packed", "near_class")
    )

    def run(frames):
        for window in _windows(_classed(frames)):
            ids, halo, texts, near = zip(*window, strict=True)
            made = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:], strict=False)]
            own, new = fingerprints(list(texts)), fingerprints(made)
            out = pd.DataFrame({
                "doc_id": pd.array(ids[:-1], dtype="Int64"),
                "n_chars": [len(t) for t in texts[:-1]],
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in made],
                "fingerprint": _hex(own[:-1]),
                "edited_fingerprint": _hex(new),
                "near_edited": (own[:-1] == new).mean(axis=1),
                "near_next": (own[:-1] == own[1:]).mean(axis=1),
                "near_class": pd.array(near[:-1], dtype="Int64"),
            })
            yield out[~np.array(halo[:-1])]

    return dealt.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long")
