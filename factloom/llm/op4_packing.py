"""Best-fit packing of token sequences by bin completion.

Texts become token ids, and only texts beyond the capacity are cut. What is packed are counts of lengths: at most
`capacity` of them, however many texts there are, so the search runs on the driver at any scale. Best-fit decreasing gives
the first incumbent. Branch and bound then looks for one sequence less: around the largest length left it enumerates
undominated fillings, least waste first, applies one as often as the counts allow or once, and prunes when the waste so far
exceeds what one sequence less leaves. A search that ends without a packing goes on with more fillings at each node. It ends
at the lower bound, or after WORK steps with the incumbent: that is its only limit, whatever the lengths and their counts.
Fillings are lengths with counts, so that a thousand equal pieces are one choice.

Each piece then finds its place by its rank among the pieces of its length: ranks come from counts by task, without a
shuffle of a length to one task.

Defined results: a null text counts as empty and is a piece of one token; equal texts are packed each; rows with null ids
and repeated ids keep all their pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import documents, parts, stored, tune

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
#: Steps of all searches for one packing less: states of fillings, tests of dominance, nodes. Less than twenty seconds of one core.
WORK = 2_000_000
#: Fillings of a node and steps to find them in the first search (later ones have more).
FILLINGS, STEPS = 4, 400
#: Counts of one length below the most that fit, which a filling tries.
MULTIPLES = 64
Run = tuple[tuple[int, ...], int]


@dataclass
class Budget:
    steps: int


# --- the packing of counts -------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over counts of equal lengths: (lengths of a bin, number of such bins)."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = {}  # space left -> bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in open_bins if s >= length):
            fits = space // length
            for items, bins in list(open_bins[space].items()):
                if not left:
                    break
                use = min(bins, left // fits)
                placed = [(use, fits)] if use else []
                left -= use * fits
                if use < bins and left:
                    placed.append((1, min(left, fits)))
                    left -= placed[-1][1]
                for number, each in placed:
                    open_bins[space][items] -= number
                    if not open_bins[space][items]:
                        del open_bins[space][items]
                    target = open_bins.setdefault(space - each * length, {})
                    key = items + (length,) * each
                    target[key] = target.get(key, 0) + number
            if not left:
                break
        fits = capacity // length
        for each, number in ((fits, left // fits), (left % fits, 1)):
            if each and number:
                target = open_bins.setdefault(capacity - each * length, {})
                target[(length,) * each] = target.get((length,) * each, 0) + number
    return [(items, bins) for group in open_bins.values() for items, bins in group.items()]


Filling = tuple[tuple[int, int], ...]


def fillings(counts: dict[int, int], space: int, most_waste: int, budget: Budget, steps: int, keep: int) -> list[tuple[int, Filling]]:
    """Undominated fillings of the space as (length, count), least waste first, at most keep, found within so many steps.

    A filling is dominated if its waste has room for a length left, or lets one or two of its lengths be put out for a longer one.
    """
    rising = sorted(x for x, n in counts.items() if n and x <= space)
    lengths = rising[::-1]
    found: list[tuple[int, Filling]] = []
    steps = min(steps, budget.steps)
    spent = len(lengths) // 8  # for the list itself

    def dominated(items: Filling, waste: int) -> bool:
        nonlocal spent
        used = dict(items)

        def free(above: int) -> bool:
            nonlocal spent
            spent += 1
            return any(counts[x] > used.get(x, 0) for x in rising[bisect_right(rising, above) : bisect_right(rising, above + waste)])

        twice = (2 * x for x, n in items if n > 1)
        return waste > 0 and (free(0) or any(free(x) for x in used) or any(free(x) for x in twice) or any(free(x + y) for x, y in combinations(used, 2)))

    # A state: where to go on among the lengths, room left, what is in. The last is taken first: longest lengths, as often as fits.
    stack: list[tuple[int, int, Filling]] = [(0, space, ())]
    while stack and spent < steps:
        at, room, items = stack.pop()
        spent += 1
        if room <= most_waste and not dominated(items, room):
            found.append((room, items))
            if not room or len(found) >= 4 * keep:
                break
        at = max(at, len(lengths) - bisect_right(rising, room))
        if not room or at >= len(lengths):
            continue
        if lengths[at] == room:  # one length fills the rest
            stack.append((at + 1, 0, (*items, (room, 1))))
            continue
        # Another length in place of this one comes after all that hold it.
        stack.append((at + 1, room, items)) if at + 1 < len(lengths) else None
        x = lengths[at]
        stack.extend((at + 1, room - x * n, (*items, (x, n))) for n in range(max(1, min(counts[x], room // x) - MULTIPLES), min(counts[x], room // x) + 1))
    budget.steps -= spent
    return sorted(set(found))[:keep]


def complete(counts: dict[int, int], capacity: int, most_waste: int, budget: Budget, keep: int = FILLINGS, steps: int = STEPS) -> list[Run] | None:
    """Bin completion with at most so much waste in all; None if none was found."""
    counts = dict(counts)

    def options(waste: int) -> list[tuple[int, Filling, bool]]:
        """Fillings, the best last; each as often as the counts allow (True) before once (False)."""
        largest = max(x for x, n in counts.items() if n)
        counts[largest] -= 1
        out = []
        for w, items in fillings(counts, capacity - largest, most_waste - waste, budget, steps, keep):
            more = dict(items)
            out.append((w, ((largest, 1 + more.pop(largest, 0)), *more.items())))
        counts[largest] += 1
        return [(w, items, often) for w, items in out[::-1] for often in (False, True)]

    total = sum(counts.values())
    if not total:
        return []
    path: list[tuple[Filling, int]] = []
    stack = [(options(0), 0)]
    while stack and budget.steps > 0:
        choices, waste = stack[-1]
        if not choices:
            stack.pop()
            if path:
                items, times = path.pop()
                for x, n in items:
                    counts[x] += times * n
                    total += times * n
            continue
        budget.steps -= 1
        w, items, often = choices.pop()
        times = min(counts[x] // n for x, n in items)
        if w:
            times = min(times, (most_waste - waste) // w)
        if not often:
            if times == 1:  # tried already
                continue
            times = 1
        for x, n in items:
            counts[x] -= times * n
            total -= times * n
        path.append((items, times))
        if not total:
            return [(tuple(x for x, n in items for _ in range(n)), times) for items, times in path]
        stack.append((options(waste + w * times), waste + w * times))
    return None


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound, the best of two kinds.

    For every k, lengths beyond capacity - k stand alone among those of k or more, and the others of more than half need a bin
    each, whose room the lengths from k to half may not exceed. And for the k of every length (as many as fit), lengths rounded down to capacity / k where
    k + 1 of them don't fill it whole: k such pieces fit into no bin with a k + 1st, so that their sum still needs the bins.
    """
    number = np.zeros(capacity + 2, np.int64)
    for x, n in counts.items():
        number[x] += n
    upto, weight = np.cumsum(number), np.cumsum(number * np.arange(capacity + 2))
    best, half = -(-int(weight[-1]) // capacity), capacity // 2
    for k in range(half + 1):
        alone, large = int(upto[capacity] - upto[capacity - k]), int(upto[capacity - k] - upto[half])
        room = large * capacity - int(weight[capacity - k] - weight[half])
        small = int(weight[half] - (weight[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    lengths = np.array(sorted(counts), np.int64)
    each = [counts[x] for x in lengths.tolist()]
    for k in sorted({*range(1, 65), *(capacity // lengths).tolist()}):
        shares, whole = np.divmod((k + 1) * lengths, capacity)
        # In units of 1 / (k * capacity) of a bin.
        units = np.where(whole == 0, k * lengths, shares * capacity).tolist()
        best = max(best, -(-sum(u * n for u, n in zip(units, each, strict=True)) // (k * capacity)))
    return best


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY, steps: int = WORK) -> list[Run]:
    """As few bins as found for so many pieces of each length."""
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    best, lower, budget = best_fit(counts, capacity), least_bins(counts, capacity), Budget(steps)
    while (bins := sum(n for _, n in best)) > lower:
        better, keep = None, FILLINGS
        while better is None and budget.steps > 0:
            better = complete(counts, capacity, (bins - 1) * capacity - total, budget, keep, STEPS * keep // FILLINGS)
            if better is None and keep > capacity:
                break
            keep *= 4
        if better is None:
            break
        best = better
    return best


# --- Spark -----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.located(path))


def token_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and where each text's begin. Texts that spell a special token go to the library itself."""
    vocabulary = bpe.word_vocabulary(path)
    ids, at = bpe.encode(["" if "<|" in t else bpe.word_form(t) for t in texts], vocabulary)
    if any("<|" in t for t in texts):
        rows = [np.array(_library(path).encode(t, add_special_tokens=False).ids, np.int32) if "<|" in t else ids[a:b] for t, a, b in zip(texts, at, at[1:], strict=False)]
        ids, at = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    return ids, at


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; nth: its number among the pieces of its length that this task makes."""

    def run(frames):
        seen: Counter = Counter()
        for frame in parts(frames):
            ids, at = token_ids(frame.text.tolist(), path)
            rows = []
            for doc, a, b in zip(frame.doc_id, at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], END_ID).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                    seen[len(part)] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth"]).astype({"doc_id": "Int64"})

    return documents(docs).mapInPandas(run, PIECES)


def slots(runs: list[Run]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, by rank: (length, first rank, end, pieces a bin, first bin, offset)."""
    out, used, first_bin = [], Counter(), 0
    for items, times in runs:
        offset = 0
        for length, each in sorted(Counter(items).items(), reverse=True):
            out.append((length, used[length], used[length] + each * times, each, first_bin, offset))
            used[length] += each * times
            offset += each * length
        first_bin += times
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    spark = docs.sparkSession
    tune(spark)
    made = stored(pieces(docs, path, capacity).withColumn("task", F.spark_partition_id()), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most `capacity` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # A few rows for each length and each run of equal bins: their number is bounded by the capacity.
    place = spark.createDataFrame(slots(pack_counts(counts, capacity)), "slot_length long, low long, high long, each long, bin long, at long")
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = made.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = ranked.join(F.broadcast(place), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(step / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("at") + (step % F.col("each")) * F.col("length")).alias("offset"),
    )
