"""Substring deduplication by content-defined chunks.

A gear hash (h = 2 h + gear[c] modulo 2**16, so of the last 16 code points) rolls over every text; a chunk ends where its top
bits are zero, unless another such place lies shortly before. Chunk borders so depend on nearby content only, and an insertion
moves them no further. In chunks beyond LONG, as in text that repeats itself with a short period, more borders lie where the
hash is the least of the places before it, so that they too depend on content only.

Chunks are compared by 64-bit digests. A digest that several documents have is a repeat, held by the document of least id.
Runs of adjacent repeats are then extended: the chunks on either side of a run are compared, character by character, with
those beside the same chunk in its holder, so that a repeated passage is known to its first and last code point. Passages of
at least WORDS words count, and every document but the holder loses them.

A passage of more than 50 words has a whole chunk of its own almost surely (all but about one in a thousand); shorter repeats
(single lines, common phrases) stay. Repeats within one document only are left alone.

Defined results: null, empty and one-chunk texts without a repeat are left alone, null texts stay null; rows without an id are
left alone; rows that repeat id and text are one in `repeats` and all lose the same in `without_repeats`; ties go to the least
id; an empty table gives an empty result; other columns are kept by `without_repeats` and ignored by `repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from factloom.llm.common import BASE, Marks, Scratch, code_points, documents, fresh, mixed, parts, range_hashes, salted_left_join, stored, tune

#: Top bits that are zero at a border (one place in 32), and code points before a border that must hold no other.
BORDER_BITS, CLEAR = 5, 8
#: Code points of the window of the gear hash: as many as the hash has bits.
WINDOW = 16
#: Code points from which a chunk gets more borders, places that compete for one, and code points between two at least.
LONG, RIVALS, APART = 512, 64, 32
#: Code points of the shortest run of repeated chunks that is looked at, and words of the shortest repeated passage.
CORE, WORDS = 48, 45
GEAR = (mixed(np.arange(1 << 16, dtype=np.uint64) * np.uint64(BASE) + np.uint64(1)) >> np.uint64(17)).astype(np.uint16)
ASKS = "holder long, digest long, side int, doc_id long, text_key long, run int, near string, words int"
SPANS = "array<struct<start:int,end:int,holder:long>>"


def _more_borders(hashes: np.ndarray) -> list[int]:
    """Places within a long chunk where the hash is the least of the RIVALS places before, APART from each other."""
    if len(hashes) <= RIVALS:
        return []
    least = np.lib.stride_tricks.sliding_window_view(hashes, RIVALS).min(axis=1)
    out, last = [], 0
    for at in (np.flatnonzero(hashes[RIVALS - 1 :] == least) + RIVALS).tolist():
        if at - last >= APART:
            out.append(at)
            last = at
    return out


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests and lengths of all chunks, and where each text's chunks begin (with the end as last entry)."""
    codes, starts = code_points(texts)
    n = len(codes)
    gear = GEAR[codes & np.uint32(0xFFFF)]
    step = 1
    while step < WINDOW:  # the sum over twice as many places
        longer = gear.copy()
        longer[step:] += gear[:-step] << np.uint16(step)
        gear, step = longer, 2 * step
    raw = gear >> np.uint16(16 - BORDER_BITS) == 0
    heads = starts[:-1][np.diff(starts) > 0]
    for k in range(WINDOW - 1):  # the window isn't full there
        raw[heads[heads + k < n] + k] = False
    ends = np.flatnonzero(raw) + 1
    lonely = np.ones(len(ends), bool)
    lonely[1:] = np.diff(ends) > CLEAR
    first = np.zeros(n + 1, bool)
    first[ends[lonely]] = True
    first[starts] = True
    first[n] = False
    begin = np.flatnonzero(first)
    for at, size in zip(begin.tolist(), np.diff(np.append(begin, n)).tolist(), strict=True):
        if size > LONG:
            first[[at + WINDOW + k for k in _more_borders(gear[at + WINDOW : at + size - 1])]] = True
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], n) if len(begin) else begin
    size = end - begin
    return mixed(range_hashes(codes, begin, end) + size.astype(np.uint64)).view(np.int64), size, np.searchsorted(begin, starts)


def _chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text, as rows of one id may differ), digests, sizes."""

    def run(frames):
        for frame in parts(frames):
            digest, size, at = chunks(frame.text.tolist())
            cut = at[1:-1]
            yield pd.DataFrame({"doc_id": frame.doc_id, "text_key": frame.text_key, "digests": np.split(digest, cut), "sizes": np.split(size.astype(np.int32), cut)})

    rows = documents(docs).where("doc_id is not null and text <> ''").withColumn("text_key", Marks.key())
    return rows.select("doc_id", "text", "text_key").mapInPandas(run, "doc_id long, text_key long, digests array<long>, sizes array<int>")


def passages(digests: np.ndarray, sizes: np.ndarray, holders: dict[int, int], least: int) -> list[list[dict]]:
    """Runs of adjacent chunks that have a holder, at least so many code points each in all, as lists of chunks.

    A chunk has start, end, holder, digest, where the texts beside it begin and end (before, after), and the run's number.
    """
    ends = np.cumsum(sizes).tolist()
    rows = [{"start": b - n, "end": b, "holder": holders.get(d), "digest": d, "before": b - n, "after": b} for d, n, b in zip(digests.tolist(), sizes.tolist(), ends, strict=True)]
    for one, other in zip(rows, rows[1:], strict=False):
        # Where texts differ, borders may do so for one window more: the holder's chunk may begin as much later.
        one["after"], other["before"] = other["end"], max(0, one["start"] - WINDOW - CLEAR)
    out: list[list[dict]] = [[]]
    for row in rows:
        if row["holder"] is None:
            out.append([])
        else:
            out[-1].append(row)
    out = [run for run in out if run and run[-1]["end"] - run[0]["start"] >= least]
    return [[c | {"run": number} for c in run] for number, run in enumerate(out)]


def _by_run(rows) -> list[list[dict]]:
    """The runs of chunks that come as one list."""
    out: list[list[dict]] = []
    for row in rows:
        if row["run"] == len(out):
            out.append([])
        out[-1].append(row)
    return out


def _joined(run: list[dict]) -> list[dict]:
    """Chunks side by side with one holder as one span."""
    out: list[dict] = []
    for c in run:
        if out and out[-1]["holder"] == c["holder"]:
            out[-1] = out[-1] | {"end": c["end"]}
        else:
            out.append({k: c[k] for k in ("start", "end", "holder")})
    return out


def _common_head(a: str, b: str) -> int:
    """How many first characters are the same."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _neighbours(frames):
    """From rows of doc_id, text_key, text and runs: what each run asks of its holders, and what each holder offers.

    side 0 is before the run and 1 after it; near is the chunk there. An offer has no run.
    """
    for frame in frames:
        out = []
        for doc, key, text, runs in zip(frame.doc_id, frame.text_key, frame.text, frame.runs, strict=True):
            offered = set()
            for number, run in enumerate(_by_run(runs)):
                words = len(text[run[0]["start"] : run[-1]["end"]].split())
                for side, chunk in enumerate((run[0], run[-1])):
                    near = text[chunk["end"] : chunk["after"]] if side else text[chunk["before"] : chunk["start"]]
                    out.append((chunk["holder"], chunk["digest"], side, doc, key, number, near, words))
                for chunk in run:
                    if chunk["holder"] == doc and chunk["digest"] not in offered:
                        offered.add(chunk["digest"])
                        out += [(doc, chunk["digest"], 0, doc, key, -1, text[chunk["before"] : chunk["start"]], 0), (doc, chunk["digest"], 1, doc, key, -1, text[chunk["end"] : chunk["after"]], 0)]
        yield pd.DataFrame(out, columns=["holder", "digest", "side", "doc_id", "text_key", "run", "near", "words"])


@F.pandas_udf(StructType([StructField("chars", IntegerType()), StructField("more", IntegerType())]))
def _extension(side: pd.Series, near: pd.Series, offered: pd.Series) -> pd.DataFrame:
    """Characters and words by which a run goes on beyond its end in both texts."""
    out = []
    for s, a, b in zip(side, near, offered, strict=True):
        if b is None:
            out.append((0, 0))
        elif s:
            out.append((n := _common_head(a, b), len(a[:n].split())))
        else:
            out.append((n := _common_head(a[::-1], b[::-1]), len(a[len(a) - n :].split())))
    return pd.DataFrame(out, columns=["chars", "more"])


def repeats(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """Texts with repeated passages of so many words: doc_id, text_key, spans as array of (start, end, holder)."""
    spark = docs.sparkSession
    tune(spark)
    chunk = "struct<start:int,end:int,holder:long,digest:long,before:int,after:int,run:int>"
    with Scratch(spark) as held:
        made = held.stored(_chunked(docs), "chunks")
        pairs = made.select("doc_id", F.explode(F.array_distinct("digests")).alias("digest"))
        shared = pairs.groupBy("digest").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last")).where("holder < last").select("digest", "holder")
        own = pairs.join(shared, "digest").groupBy("doc_id").agg(F.collect_list("digest").alias("held"), F.collect_list("holder").alias("holders"))

        def marked(frames):
            for frame in frames:
                runs = [passages(d, s, dict(zip(h.tolist(), o.tolist(), strict=True)), CORE) for d, s, h, o in zip(frame.digests, frame.sizes, frame.held, frame.holders, strict=True)]
                yield frame[["doc_id", "text_key"]].assign(runs=[[c for run in r for c in run] for r in runs])[[bool(r) for r in runs]]

        runs = made.join(own, "doc_id").mapInPandas(marked, f"doc_id long, text_key long, runs array<{chunk}>").dropDuplicates(["doc_id", "text_key"])
        runs = held.stored(runs, "runs")
        shared_marks = Marks(runs.select("text_key")).shared

        def meant(frames):
            for frame in frames:
                yield frame[Marks.within(shared_marks, frame.text_key.to_numpy())]

        rows = documents(docs).where("doc_id is not null").select("doc_id", Marks.key().alias("text_key"), "text")
        texts = rows.mapInPandas(meant, rows.schema).dropDuplicates(["doc_id", "text_key"])
        # Always sort-merge joins: all sides grow with the corpus.
        asks = held.stored(texts.join(runs.hint("merge"), ["doc_id", "text_key"]).mapInPandas(_neighbours, ASKS), "asks")
        offers = asks.where("run < 0").groupBy("holder", "digest", "side").agg(F.min("near").alias("offered"))
        other = salted_left_join(asks.where("run >= 0 and doc_id <> holder"), offers, ["holder", "digest", "side"])
        other = held.stored(other.withColumn("extension", _extension("side", "near", "offered")).select(*asks.columns, "extension.*"), "ends")
        # A holder's own passage reaches as far as those of the others.
        most = other.groupBy("holder", "digest", "side").agg(F.max("chars").alias("chars"), F.max("more").alias("more"))
        mine = asks.where("run >= 0 and doc_id = holder").join(most.hint("merge"), ["holder", "digest", "side"], "left")
        ends = other.unionByName(mine.select(*other.columns)).groupBy("doc_id", "text_key", "run").agg(
            F.max(F.when(F.col("side") == 0, F.col("chars"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("chars"))).alias("right"), (F.max("words") + F.sum(F.coalesce("more", F.lit(0)))).alias("words")
        ).where(F.col("words") >= least)
        ends = ends.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("run", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"))).alias("ends"))

        def extended(frames):
            for frame in frames:
                spans = []
                for runs, ends in zip(frame.runs, frame.ends, strict=True):
                    row, runs = [], _by_run(runs)
                    for end in sorted(ends, key=lambda e: e["run"]):
                        found = _joined(runs[end["run"]])
                        found[0]["start"] -= end["left"]
                        found[-1]["end"] += end["right"]
                        if row:  # two passages may reach into the chunk between them
                            found[0]["start"] = max(found[0]["start"], row[-1]["end"])
                        row += found
                    spans.append(row)
                yield frame[["doc_id", "text_key"]].assign(spans=spans)

        return stored(runs.join(ends.hint("merge"), ["doc_id", "text_key"]).mapInPandas(extended, f"doc_id long, text_key long, spans {SPANS}"), "repeats")


def summary(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """A row for each text with a repeated passage: its spans, and what it would lose."""
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    lost = F.filter("spans", lambda s: s["holder"] != F.col("doc_id"))
    spelled = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["holder"])), ",")
    return repeats(docs, least).select("doc_id", F.size("spans").alias("n_spans"), size("spans").alias("repeated_chars"), size(lost).alias("removed_chars"), spelled.alias("spans"))


def without_repeats(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """docs with every repeated passage taken out of all documents but its holder."""
    of, key, starts, ends = fresh(docs, "of", "of_text", "starts", "ends")
    lost = repeats(docs, least).select("doc_id", "text_key", F.filter("spans", lambda s: s["holder"] != F.col("doc_id")).alias("lost")).where(F.size("lost") > 0)
    lost = lost.select(F.col("doc_id").alias(of), F.col("text_key").alias(key), F.transform("lost", lambda s: s["start"]).alias(starts), F.transform("lost", lambda s: s["end"]).alias(ends))

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, starts, ends in batches:
            out = []
            for text, a, b in zip(texts, starts, ends, strict=True):
                out.append(text if a is None else "".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)))
            yield pd.Series(out, dtype=object)

    # Always a sort-merge join: what is lost grows with the corpus, so it is never broadcast.
    joined = docs.join(lost.hint("merge"), (docs["doc_id"].cast("long") == F.col(of)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key)), "left")
    return joined.withColumn("text", cut(F.col("text").cast("string"), starts, ends)).select(*docs.columns)
