"""What the corpus operators share: shared folders, batches of texts, ragged arrays and hashed lookups."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; whole texts make larger batches heavy.
ARROW_ROWS = 256
#: Code points that a Python step holds as arrays at once; one longer text is still taken whole.
BATCH_CHARS = 400_000


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_stored: list[str] = []


#: Whether Spark removes the shuffle files of an execution when it ends (from Spark 4.1; without effect before).
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder, and where. Its shuffle files go with the write: what comes after reads the table alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def _deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors.

    For what a returned DataFrame still reads; `clear` removes it. What is done with before a function returns is a Scratch's.
    """
    out, path = _written(df, name)
    _stored.append(path)
    return out


def clear(spark: SparkSession) -> int:
    """Removes the tables that this process stored, once their results are written; how many there were."""
    made = len(_stored)
    while _stored:
        _deleted(spark, _stored.pop())
    return made


def swept(spark: SparkSession) -> None:
    """Frees the disk of finished steps: Spark keeps their shuffle files until the driver has collected the plans that wrote them."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Stored tables that go at the end of a with block, or before by `drop`; nothing returned may read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _written(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _deleted(self.spark, self.paths.pop(id(table))[1])

    def __exit__(self, *_) -> None:
        for _, path in self.paths.values():
            _deleted(self.spark, path)
        self.paths = {}
        swept(self.spark)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text (null: empty) and the named further columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key counts as hot from this share of the rows on; so there are at most as many hot keys. Parts that each is dealt to.
HOT, SALTS = 200, 64


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left.join(right, keys, "left") by sort-merge, where hot keys of left are dealt to SALTS parts and right's rows of them repeated.

    right has few rows of each key. At most HOT keys are broadcast, whatever the input.
    """
    total = left.count()
    hot_name, salt = fresh(left, "hot", "salt")
    hot = left.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * HOT > total).select(*keys, F.lit(True).alias(hot_name)).limit(HOT)
    hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)  # at most HOT rows
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(F.col(hot_name), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop(hot_name)
    copies = F.when(F.col(hot_name), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(copies)).drop(hot_name)
    return dealt.join(repeated.hint("merge"), [*keys, salt], "left").drop(salt)


#: Bits of the bitmap that a Marks holds.
MARK_BITS = 1 << 26


class Marks:
    """A bitmap of fixed size, broadcast, that marks the texts of some keys: tells a scan which texts may be meant.

    A text that isn't marked is surely not meant; whoever needs to be sure of the others joins on the key.
    """

    def __init__(self, keys: DataFrame):
        """keys: one column of longs, hashes of texts as `key` gives them."""
        bit = keys.select(F.pmod(F.col(keys.columns[0]), F.lit(MARK_BITS)).alias("bit"))
        pages = bit.groupBy((F.col("bit") / 32768).cast("long").alias("page")).agg(F.expr("bitmap_construct_agg(cast(bit % 32768 as int))").alias("bits"))
        held = np.zeros(MARK_BITS // 8, np.uint8)
        for row in pages.collect():  # at most MARK_BITS / 8 bytes, whatever the input
            held[row["page"] * 4096 : row["page"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(held)

    @staticmethod
    def key() -> Column:
        return F.xxhash64("text")

    @staticmethod
    def within(shared, keys: np.ndarray) -> np.ndarray:
        place = keys.astype(np.int64) & (MARK_BITS - 1)
        return (shared.value[place >> 3] >> (place & 7) & 1).astype(bool)


def parts(frames: Iterator[pd.DataFrame], column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The rows in pieces whose texts hold about so many code points."""
    for frame in frames:
        if not len(frame):
            continue
        group = frame[column].str.len().to_numpy().cumsum() // chars
        if group[-1] == group[0]:
            yield frame
        else:
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group)) + 1):
                yield frame.iloc[at]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, and where each begins (with the end as last entry)."""
    joined = "".join(texts)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges start..start+length, one after another."""
    lengths = lengths.astype(np.int64, copy=False)
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    out += np.repeat(starts.astype(np.int64, copy=False) - (ends - lengths), lengths)
    return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between starts[i] and starts[i + 1]; empty ranges give 0. A range's sum doesn't depend on the others."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0, dtype=out.dtype)
    return out


#: Base of the polynomial hashes (odd, so that its powers have inverses modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each range of values; equal ranges have equal hashes, wherever they lie."""
    up, down = powers(len(values) + 1)
    sums_ = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums_[1:])
    return (sums_[ends] - sums_[starts]) * down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class HashedKeys:
    """Distinct 64-bit keys as one sorted array of their hashes, with a directory by the hashes' top bits."""

    def __init__(self, keys: np.ndarray):
        hashes = keys.astype(np.uint64) * np.uint64(BASE)
        self.order = np.argsort(hashes, kind="stable")
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        ordered = hashes[self.order]
        self.first = np.searchsorted(ordered >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))
        self.hashes = np.concatenate((ordered, np.zeros(1, np.uint64)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the order of sorted hashes, or -1. The hash is a bijection, so equal hashes are equal keys."""
        hashes = keys.astype(np.uint64, copy=False) * np.uint64(BASE)
        bucket = (hashes >> self.shift).astype(np.int64)
        at = self.first[bucket]
        last = self.first[bucket + 1]
        out = np.full(len(keys), -1, np.int32)
        full = at < last
        hit = full & (self.hashes[at] == hashes)
        out[hit] = at[hit]
        rest = np.flatnonzero(full & ~hit & (at + 1 < last))
        step = 1
        while len(rest):
            place = at[rest] + step
            found = self.hashes[place] == hashes[rest]
            out[rest[found]] = place[found]
            rest = rest[~found & (place + 1 < last[rest])]
            step += 1
        return out
