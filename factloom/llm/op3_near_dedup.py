"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a digest of the set, and a MinHash signature. Texts of equal sets are one node.
2. Nodes that agree on a whole band of the signature are candidates. Each node is first paired with the least node of its
   bucket only.
3. Pairs compare their signatures batch by batch; a pair goes as soon as the posterior probability (uniform prior on the
   similarity) that it reaches the threshold falls below MISS. Survivors are confirmed on the full sets.
4. Components of the links are found. Two nodes that meet in a bucket may be similar though one misses the head. Around heads
   with such nodes, and only there, the nodes meet in blocks bounded by rows and by members of their sets: pairs of different
   components compare signatures as in step 3, survivors their full sets, and a block gives one link at most for two
   components (see _around_heads). No pair within a bucket is left undecided, and no pairs of a bucket are made as rows.

A pair at the threshold itself shares no band with a probability of (1 - 0.8**6)**40, about 5e-6, and less beyond it.
Full sets are made anew for the nodes that need them; a bitmap of fixed size tells the scan which texts those are.

Defined results: null and empty texts, and texts without a word, have an empty set and are linked with nothing; a null id
is nobody's smallest id, and its row links others like any row; it is its own component (null) unless linked with others;
rows of one id are nodes of their own by content; ties go to the smallest id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Marks, Scratch, documents, mixed, parts, ragged, salted_left_join, stored, swept, tune
from factloom.llm.components import components
from factloom.llm.shingles import distinct_shingles, signatures

#: Bands and hash functions in each.
BANDS, WIDE = 40, 6
#: Hash functions that are compared before each decision, and the probability of losing a true pair at a decision.
BATCH, MISS = 24, 1e-7
#: Nodes on either side that meet in one block around a head, and members of their sets in all.
BLOCK, MEMBERS = 1024, 500_000
#: Pairs of signatures that are compared at once.
PAIRS = 100_000
#: Nodes that meet one copy of their head's set.
STAR = 512


@lru_cache(maxsize=64)
def least_matches(compared: int, percent: int, miss: float) -> int:
    """Matches below which the posterior P(similarity >= percent / 100 | matches of compared) is under miss.

    With a uniform prior the posterior is Beta(1 + matches, 1 + compared - matches).
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    for matches in range(compared + 1):
        a, b = 1 + matches, 1 + compared - matches
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) + lgamma(a + b) - lgamma(a) - lgamma(b))
        if density[x >= percent / 100].mean() * (1 - percent / 100) >= miss:
            return matches
    return compared


def survive(left: np.ndarray, right: np.ndarray, percent: int, miss: float = MISS, batch: int = BATCH, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of signature rows (i of left with j of right; by default row by row) outlast all batches."""
    i = np.arange(len(left)) if i is None else i
    j = np.arange(len(right)) if j is None else j
    out = []
    for first in range(0, len(i), PAIRS):
        alive = np.arange(first, min(first + PAIRS, len(i)))
        matches = np.zeros(len(alive), np.int64)
        for end in range(batch, left.shape[1] + 1, batch):
            matches += (left[i[alive], end - batch : end] == right[j[alive], end - batch : end]).sum(axis=1)
            keep = matches >= least_matches(end, percent, miss)
            alive, matches = alive[keep], matches[keep]
        out.append(alive)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sets(docs: DataFrame, size: int, number: int) -> DataFrame:
    """doc_id, text_key (a hash of the text, as rows of one id may differ), n (shingles), node (digest of the set; null if empty) and signature."""

    def run(frames):
        for frame in parts(frames):
            hashes, at = distinct_shingles(frame.text.tolist(), size)
            n = np.diff(at)
            signature = signatures(hashes, at, number)
            yield pd.DataFrame({"doc_id": frame.doc_id.astype("Int64"), "text_key": frame.text_key, "n": n, "node": pd.array(np.where(n > 0, nodes(hashes, at), 0), dtype="Int64").astype(object), "signature": [s.tobytes() for s in signature]}).assign(node=lambda f: f.node.where(f.n > 0, None))

    return documents(docs).withColumn("text_key", F.xxhash64("text")).mapInPandas(run, "doc_id long, text_key long, n long, node long, signature binary")


def nodes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: two sums over its mixed members and its size, mixed."""
    total = np.zeros((2, len(hashes) + 1), np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[0, 1:])
    np.cumsum(mixed(hashes + np.uint64(0x14057B7EF767814F)), out=total[1, 1:])
    first, second = (t[at[1:]] - t[at[:-1]] for t in total)
    return mixed(first ^ mixed(second + np.diff(at).astype(np.uint64))).view(np.int64)


def _kept_by_signature(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that outlast the comparison of signatures."""

    def run(frames):
        for frame in frames:
            left, right = (np.frombuffer(b"".join(frame[c]), np.uint16).reshape(len(frame), -1) for c in ("left", "right"))
            yield frame[["a", "b"]].iloc[survive(left, right, percent)]

    left = known.select(F.col("node").alias("a"), F.col("signature").alias("left"))
    right = known.select(F.col("node").alias("b"), F.col("signature").alias("right"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


def _full_sets(ends: DataFrame, known: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the nodes of ends, made anew from their texts."""
    shared = Marks(ends.join(known.select("node", "text_key"), "node").select("text_key")).shared

    def run(frames):
        for frame in frames:
            for part in parts([frame[Marks.within(shared, frame.text_key.to_numpy())]]):
                hashes, at = distinct_shingles(part.text.tolist(), size)
                yield pd.DataFrame({"node": nodes(hashes, at), "shingles": np.split(hashes.view(np.int64), at[1:-1])})[np.diff(at) > 0]

    rows = documents(docs).select("text", Marks.key().alias("text_key"))
    return rows.mapInPandas(run, "node long, shingles array<long>").join(ends, "node", "left_semi").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar. A head b of many pairs is repeated once for each STAR of them."""
    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("copies"))
    dealt = pairs.join(copies, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), "copies").cast("int").alias("copy"))
    # Both sides join sets by the same column, so that Spark deals the sets by it only once.
    heads = copies.withColumnRenamed("b", "node").join(sets, "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("others"))
    own = dealt.join(sets, "node").select(F.col("node").alias("a"), "b", "copy", F.col("shingles").alias("own"))
    both = F.size(F.array_intersect("own", "others")).cast("long")
    found = own.join(heads, ["b", "copy"]).select("a", "b", F.size("own").alias("n"), F.size("others").alias("m"), both.alias("both"))
    return found.where(100 * F.col("both") >= percent * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b")


def _flat(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The members of all sets side by side, and how many each set has."""
    sets = [np.asarray(r, np.int64) for r in rows]
    return np.concatenate(sets), np.array([len(r) for r in sets])


def meet(s: pd.DataFrame, x: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the components of s and x (columns node, root, signature, shingles): similar nodes, at most one pair for two
    components that hang together otherwise."""
    left, right = (np.frombuffer(b"".join(f.signature), np.uint16).reshape(len(f), -1) for f in (s, x))
    _, root = np.unique(np.concatenate((s.root.to_numpy(), x.root.to_numpy())), return_inverse=True)
    left_root, right_root = root[: len(s)], root[len(s) :]
    (own, n), (other, m) = _flat(s.shingles), _flat(x.shingles)
    order = np.argsort(other, kind="stable")
    row = np.repeat(np.arange(len(x)), m)[order]
    other = other[order]
    own_at = np.cumsum(n) - n
    parent = np.arange(root.max() + 1)

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    links = []
    for i in range(len(s)):
        now = find(left_root[i])
        top = np.array([find(k) for k in range(len(parent))]) if i % 64 == 0 else top
        j = np.flatnonzero((top[right_root] != now) & (100 * np.minimum(n[i], m) >= percent * np.maximum(n[i], m)))
        j = j[survive(left, right, percent, i=np.full(len(j), i), j=j)]
        if not len(j):
            continue
        mine = own[own_at[i] : own_at[i] + n[i]]
        low, high = np.searchsorted(other, mine, "left"), np.searchsorted(other, mine, "right")
        both = np.bincount(row[ragged(low, high - low)], minlength=len(x))[j]
        for k in j[100 * both >= percent * (n[i] + m[j] - both)].tolist():
            a, b = find(left_root[i]), find(right_root[k])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(s.node.iloc[i]), int(x.node.iloc[k])))
    return links


def _around_heads(star: DataFrame, links: DataFrame, roots: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, of nodes that met one head and of which one at least is not similar to it.

    star: all pairs (a, b) of a node and a head. Nodes around a head meet in blocks, whatever their number.
    """
    near = links.withColumn("similar", F.lit(True))
    rooted = star.select("a", "b").join(near, ["a", "b"], "left").join(roots.withColumnRenamed("node", "a"), "a", "left").join(known.select(F.col("node").alias("a"), "n"), "a")
    rooted = rooted.select("a", "b", "n", F.col("similar").isNull().alias("far"), F.coalesce("root", "a").alias("root"))
    weight = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    # Without two components around it, a head has nothing to add.
    heads = rooted.groupBy("b").agg(
        F.count("*").alias("around"), weight(F.lit(True)).alias("members"), F.count_if("far").alias("n_far"), weight(F.col("far")).alias("far_members"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("n_far > 0 and around > 1 and low < high")
    blocks = lambda rows, members: F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(members) / MEMBERS)).cast("int")
    own = rooted.join(heads.select("b", blocks("around", "members").alias("x_blocks"), blocks("n_far", "far_members").alias("s_blocks")), "b")
    own = own.join(known.select(F.col("node").alias("a"), "signature"), "a").join(sets.withColumnRenamed("node", "a"), "a")
    far = own.where("far").withColumns({"s_block": F.pmod(F.xxhash64("a"), "s_blocks").cast("int"), "x_block": F.explode(F.sequence(F.lit(0), F.col("x_blocks") - 1))})
    every = own.withColumns({"x_block": F.pmod(F.xxhash64("a"), "x_blocks").cast("int"), "s_block": F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))})
    keys = ["b", "s_block", "x_block"]
    columns = [*keys, F.col("a").alias("node"), "root", "signature", "shingles"]

    def run(s: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(meet(s, x, percent) if len(s) and len(x) else [], columns=["a", "b"]).astype("int64")

    names = [*keys, "node", "root", "signature", "shingles"]
    left, right = (side.select(*columns).toDF(*names).groupBy(*keys) for side in (far, every))
    return left.cogroup(right).applyInPandas(run, "a long, b long")


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    return by_text(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def by_text(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, wide: int = WIDE) -> DataFrame:
    """As `groups`, with text_key (xxhash64 of the text), and least: whether no row of the group has a smaller (doc_id, text_key).

    Signatures have so many bands of so many hash functions each. Each group whose rows have ids so has a least text, though its id may have others. Rows without an id are never least
    among rows with one; texts without a word are least of their own.
    """
    tune(docs.sparkSession)
    with Scratch(docs.sparkSession) as held:
        made = held.stored(_sets(docs, size, bands * wide), "sets")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "n", "signature")).alias("first")
        known = held.stored(made.where("node is not null").groupBy("node").agg(first).select("node", "first.*"), "nodes")
        # From here on nodes alone need signatures, which are most of what a row holds.
        rows = held.stored(made.select("doc_id", "text_key", "n", "node"), "rows")
        held.drop(made)
        # Bands: two nodes of sizes below percent of each other can't be similar.
        width = 2 * wide
        banded = known.select("node", "n", F.explode(F.array(*[F.xxhash64(F.lit(b), F.substring("signature", width * b + 1, width)) for b in range(bands)])).alias("key"))
        near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
        heads = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
        fits = near(F.col("n"), F.col("head.n"))
        met = banded.join(heads, "key").where(F.col("node") != F.col("head.node")).where(fits | (F.col("members") > 2))
        star = met.groupBy(F.col("node").alias("a"), F.col("head.node").alias("b")).agg(F.max(F.col("members") > 2).alias("more"), F.max(fits).alias("fits"))
        star = held.stored(star, "pairs")
        swept(docs.sparkSession)
        close = held.stored(_kept_by_signature(star.where("fits"), known, percent), "close")
        ends = star.where("more").select("a", "b").union(close.select("a", "b"))
        sets = held.stored(_full_sets(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct(), known, docs, size), "sets")
        links = held.stored(_confirmed(close, sets, percent), "links")
        swept(docs.sparkSession)
        roots = components(links)
        more = held.stored(_around_heads(star.where("more"), links, roots, sets, known, percent), "links")
        if not more.isEmpty():
            roots = components(links.union(more))
        own_row = F.when(~F.col("no_id"), F.struct("doc_id", "text_key"))
        labels = roots.join(known.select("node", own_row.alias("own_row")), "node")
        labels = labels.join(labels.groupBy("root").agg(F.min("own_row").alias("least_row")), "root").select("node", "least_row")
        own = known.select("node", own_row.alias("own_row")).join(labels, "node", "left").select("node", F.coalesce("least_row", "own_row").alias("least_row"))
        out = salted_left_join(rows, own, ["node"]).select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_row.doc_id")).alias("component_id"), "text_key",
            F.coalesce((F.col("doc_id") == F.col("least_row.doc_id")) & (F.col("text_key") == F.col("least_row.text_key")), F.col("least_row").isNull()).alias("least"),
        )
        return stored(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), "groups")
