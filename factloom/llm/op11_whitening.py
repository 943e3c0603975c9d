"""Whitening of embeddings from an exact scatter matrix, in residue numbers.

Every entry c becomes the integer floor(scale * c). The fit list is each distinct integer vector once. A first pass gives its
dimensions and a bound of its entries, hence of every entry of the scatter matrix; as many primes are taken as that bound
needs. Each partition then multiplies its block of vectors (with a leading one, so that count and sums come along) by itself
modulo every prime: residues are centred and blocks are short enough that a double-precision product is exact. Residues of
all partitions are added up by Spark, modulo the prime, row of the matrix by row, in two levels; the driver sees one matrix
a prime and puts the integers together by Chinese remaindering. So n, sums S and scatter Q are exact whatever the order of
rows and however many there are, and so is n * Q - S S', which is n * n times the covariance, centred before any rounding.
Its quotient is rounded once, and a double-precision eigendecomposition gives the components.

What is bounded by dimensions only, never by rows, is held by the driver and sent to tasks: one matrix for each prime, and
the components. How far the whitened fit list is from unit covariance is measured on that list by a pass of its own.

Defined results: rows whose vector is null or holds a null or non-finite entry take no part; a null id is kept; vectors of
fewer entries count as zero beyond them; entries that leave the range of a long end at its borders; repeated rows fit once
and are each returned; a deviation beyond a long is null; components whose eigenvalue is nothing but rounding are left out,
so one distinct vector alone, or an empty table, gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Scratch

#: Vectors multiplied at once. Centred residues of a 20-bit prime are below 2**19, so a block's sums stay below 2**51.
BLOCK = 8192
PRIME_BITS = 20
#: Partitions whose residues one task of the first level adds up.
FAN_IN = 256
#: Eigenvalues below this share of the largest, times the dimensions, are rounding.
ROUNDING = 1e-14


def primes(bound: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product is above twice the bound, so that residues tell signed values apart."""
    found, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= 2 * bound:
        if all(n % d for d in range(3, int(n**0.5) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues between -prime / 2 and prime / 2, as doubles."""
    out = np.remainder(values, prime)
    return (out - prime * (out > prime // 2)).astype(np.float64)


def residue_scatter(x: np.ndarray, of: list[int]) -> np.ndarray:
    """x' x modulo each prime, for integers x of any size in a long: primes x columns x columns."""
    out = np.zeros((len(of), x.shape[1], x.shape[1]), np.int64)
    for at in range(0, len(x), BLOCK):
        for k, prime in enumerate(of):
            r = centred(x[at : at + BLOCK], prime)
            out[k] = np.remainder(out[k] + np.remainder((r.T @ r).astype(np.int64), prime), prime)
    return out


def reconstructed(residues: list[np.ndarray], of: list[int]) -> np.ndarray:
    """The integers of least absolute value with these residues, by Chinese remaindering; Python integers."""
    product = 1
    for prime in of:
        product *= prime
    total = np.zeros(residues[0].shape, object)
    for r, prime in zip(residues, of, strict=True):
        rest = product // prime
        total = total + r.astype(object) * (rest * pow(rest, -1, prime))
    total = total % product
    return np.where(total > product // 2, total - product, total)


@dataclass
class Whitening:
    """What the fit gives; components is one row for each, deviations are of n * x."""

    n: int
    sums: list[int]
    largest: int
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where all of them fit, else Python integers."""
        if 2 * self.n * self.largest < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """vec_id and x, the integer vector, of the rows that take part."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is not less
    return table.where(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(scale * c.cast("double")) + F.lit(0).cast("long")).alias("x"))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches and their vectors as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _added(rows: DataFrame, of: list[int], keys: list[str]) -> DataFrame:
    """Residues (arrays of longs in column r) added modulo their prime over rows that agree in the keys, among them k and i."""

    def add(key: tuple, frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prime, total = of[key[0].as_py()], 0
        for batch, r in blocks(frames, "r"):
            total = np.remainder(total + r.sum(axis=0), prime)  # at most 2**20 a residue, so a batch can't leave a long
        yield pa.RecordBatch.from_pydict({**{name: [value.as_py()] for name, value in zip(keys, key, strict=True)}, "r": [total]}, pa.schema([*[(name, pa.int32()) for name in keys], ("r", pa.list_(pa.int64()))]))

    return rows.groupBy(*keys).applyInArrow(add, ", ".join(f"{k} int" for k in keys) + ", r array<long>")


def scatter(vectors: DataFrame, dims: int, largest: int, rows: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums and sums of products of the vectors, exact. largest bounds the entries, rows the number of vectors."""
    of = primes(rows * max(largest, 1) ** 2)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((len(of), dims + 1, dims + 1), np.int64), []

        def take() -> None:
            if held:
                x = np.concatenate(held)
                held.clear()
                total[:] = np.remainder(total + residue_scatter(np.concatenate((np.ones((len(x), 1), np.int64), x), axis=1), of), np.array(of)[:, None, None])

        for _, x in blocks(batches):
            held.append(x)
            if sum(map(len, held)) >= BLOCK:
                take()
        take()
        if total.any():
            k, i = np.divmod(np.arange(len(of) * (dims + 1), dtype=np.int32), dims + 1)
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "i": i.astype(np.int32), "r": list(total.reshape(-1, dims + 1))}, pa.schema([("k", pa.int32()), ("i", pa.int32()), ("r", pa.list_(pa.int64()))]))

    part = vectors.select("x").mapInArrow(multiply, "k int, i int, r array<long>").withColumn("part", F.floor(F.spark_partition_id() / FAN_IN).cast("int"))
    found = _added(_added(part, of, ["k", "i", "part"]).select("k", "i", "r"), of, ["k", "i"]).collect()  # primes x dimensions rows
    residues = np.zeros((len(of), dims + 1, dims + 1), np.int64)
    for row in found:
        residues[row["k"], row["i"]] = row["r"]
    whole = reconstructed(list(residues), of)
    return int(whole[0, 0]), whole[0, 1:].tolist(), whole[1:, 1:]


def components(n: int, sums: list[int], products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components (rows), eigenvalues and shares of the trace, largest first."""
    s = np.array(sums, object)
    exact = n * products - np.outer(s, s)
    covariance = np.array([[value / (n * n) for value in row] for row in exact.tolist()])  # one rounding each
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > ROUNDING * len(values) * max(values.max(), 0)]
    trace = sum(exact.diagonal().tolist()) / (n * n)
    return vectors.T[order], values[order], values[order] / trace if len(order) else values[order]


def fit(vectors: DataFrame, most: int) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of column x, and the rows with their vectors made equally long; None without spread."""
    low, high = F.array_min("x"), F.array_max("x")
    seen = vectors.agg(F.count("*").alias("rows"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("dims"), F.min(low).alias("low"), F.max(high).alias("high")).first()
    if not seen["dims"]:
        return None, vectors
    if seen["least"] < seen["dims"]:
        vectors = vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(seen["dims"]) - F.size("x"))))
    largest = max(abs(seen["low"]), abs(seen["high"]))
    with Scratch(vectors.sparkSession) as scratch:
        distinct = scratch.stored(vectors.select("x").distinct(), "whitening-fit")
        n, sums, products = scatter(distinct, seen["dims"], largest, seen["rows"])
        found = Whitening(n, sums, largest, *components(n, sums, products, most))
        if not len(found.components):
            return None, vectors
        found.identity_error = identity_error(distinct, found)
    return found, vectors


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over these vectors."""
    k = len(model.components)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in blocks(batches):
            w = model.whitened(model.deviations(x))
            total += np.concatenate((w.sum(axis=0)[None], w.T @ w))
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    values = np.zeros((k + 1) * k)
    for row in vectors.select("x").mapInArrow(gather, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect():  # (k + 1) * k rows
        values[row["i"]] = row["value"]
    mean, second = values[:k] / model.n, values[k:].reshape(k, k) / model.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """A row for each row that takes part and each of the first components: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error. table: vec_id, embedding."""
    model, vectors = fit(whole_vectors(table, scale), most)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, wide = len(model.components), len(model.sums) * (2 * model.n * model.largest) ** 2 >= 2**63
        for batch, x in blocks(batches):
            apart = model.deviations(x)
            squares = (apart.astype(object) ** 2 if wide else apart**2).sum(axis=1)
            deviation = pa.array([v if v < 2**63 else None for v in squares.tolist()], pa.int64())
            rows = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(rows), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": np.full(len(rows), model.n), "deviation": deviation.take(rows),
                "whitened": model.whitened(apart).ravel(), "explained": np.tile(model.explained, len(x)), "identity_error": np.full(len(rows), model.identity_error),
            })

    return vectors.mapInArrow(apply, RESULT)
