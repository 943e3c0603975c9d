"""Joins that have no equal key: overlapping intervals, contained terms and alike names, each by keys that lose no pair.

None of them makes all pairs of a group. Intervals meet in nodes of a tree over time, so that what meets but for the borders
overlaps; a term meets the texts that hold its rarest word or gram; names meet by rare letters that they must share. What a
join must check beyond its key, it checks on the pairs that met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import plain

# --- intervals -------------------------------------------------------------------------------------------------------

#: Children of a node, points of one slot in one block, and points up to which a slot is one node: its pairs cost less than nodes do.
FAN, SLOT_POINTS, SMALL_SLOT = 16, 50_000, 64


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp_ntz").cast("timestamp"))


def _timed(rows: DataFrame, slot: list[str], start: str, end: str) -> DataFrame:
    """slot, row (all columns as a struct), and start_us and end_us; null where unbounded. Empty intervals overlap nothing and go."""
    out = rows.select(*slot, F.struct("*").alias("row"), _micros(start).alias("start_us"), _micros(end).alias("end_us"))
    return out.where("start_us is null or end_us is null or start_us < end_us")


class Tree:
    """Nodes over time: leaves of the median interval's length from the first start on, FAN nodes of a level in one above."""

    def __init__(self, *sides: DataFrame):
        every = sides[0].select("start_us", "end_us")
        for side in sides[1:]:
            every = every.union(side.select("start_us", "end_us"))
        seen = every.agg(F.min("start_us").alias("first"), F.max("start_us").alias("last"), F.percentile_approx(F.col("end_us") - F.col("start_us"), 0.5).alias("length")).first()
        self.first, self.last = seen["first"] or 0, seen["last"] or 0
        self.width, self.levels = max(1, int(seen["length"] or 0)), 1
        while (self.last - self.first) // self.width >= FAN**self.levels:
            self.levels += 1

    def leaf(self, micros: Column) -> Column:
        return F.floor((F.greatest(micros, F.lit(self.first)) - self.first) / F.lit(self.width)).cast("long")

    def above(self, micros: Column) -> Column:
        """The nodes of all levels over a moment; before the first start is with the first leaf."""
        leaf = self.leaf(F.coalesce(micros, F.lit(self.first)))
        return F.array(*[F.struct(F.lit(level).alias("level"), F.floor(leaf / FAN**level).cast("long").alias("node")) for level in range(self.levels)])

    def cover(self, start: Column, end: Column) -> Column:
        """As few nodes as cover the interval's leaves up to the last start: each of these leaves lies under exactly one."""
        low = self.leaf(F.coalesce(start, F.lit(self.first)))
        high = self.leaf(F.least(F.coalesce(end - 1, F.lit(self.last)), F.lit(self.last)))
        nodes, none = [], F.array().cast("array<struct<level:int,node:bigint>>")
        listed = lambda a, b, level: F.when(a <= b, F.transform(F.sequence(a, b), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))).otherwise(none)
        for level in range(self.levels):
            if level == self.levels - 1:
                nodes.append(listed(low, high, level))
                break
            next_low, next_high = F.floor((low + FAN - 1) / FAN).cast("long"), F.floor((high + 1) / FAN).cast("long") - 1
            whole = next_low <= next_high  # some node of the next level lies within
            nodes.append(F.when(whole, F.concat(listed(low, next_low * FAN - 1, level), listed((next_high + 1) * FAN, high, level))).otherwise(listed(low, high, level)))
            low, high = F.when(whole, next_low).otherwise(F.lit(1).cast("long")), F.when(whole, next_high).otherwise(F.lit(0).cast("long"))
        return F.concat(*nodes)


def met(outer: DataFrame, inner: DataFrame, slot: list[str], tree: Tree) -> DataFrame:
    """Rows of inner whose start lies in or near a row of outer: by slot and node, points of large slots dealt to blocks.

    A start before the first is in the first leaf. What met is checked by the caller; only a first or last leaf may hold more.
    """
    sizes = inner.groupBy(*slot).agg(F.ceil(F.count("*") / SLOT_POINTS).cast("int").alias("blocks"), (F.count("*") <= SMALL_SLOT).alias("small"))
    whole = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node")))
    nodes = lambda own: F.inline(F.when(F.col("small"), whole).otherwise(own))
    points = inner.join(sizes, slot).select(*slot, F.col("row").alias("inner"), F.col("start_us").alias("inner_start"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), nodes(tree.above(F.col("start_us"))))
    spans = outer.join(sizes, slot).select(*slot, F.col("row").alias("outer"), F.col("start_us").alias("outer_start"), F.col("end_us").alias("outer_end"), "blocks", nodes(tree.cover(F.col("start_us"), F.col("end_us"))))
    spans = spans.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return spans.join(points, [*slot, "level", "node", "block"])


def _within(pairs: DataFrame) -> DataFrame:
    late = F.coalesce("inner_start", F.lit(-(1 << 63)).cast("long"))
    return pairs.where((late >= F.coalesce("outer_start", F.lit(-(1 << 63)).cast("long"))) & (F.col("outer_end").isNull() | (late < F.col("outer_end"))))


def overlapping(left: DataFrame, right: DataFrame, slot: list[str], start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """slot, left and right (structs): rows of one slot whose intervals share a moment, each pair once.

    A pair is found where its later start lies: in the other's interval. Null starts and ends are unbounded.
    """
    a, b = _timed(left, slot, start, end), _timed(right, slot, start, end)
    tree = Tree(a, b)
    first = _within(met(a, b, slot, tree)).select(*slot, F.col("outer").alias("left"), F.col("inner").alias("right"))
    # The left side starts later: not at the same time, which the other half has.
    second = _within(met(b, a, slot, tree)).where(~F.equal_null("inner_start", "outer_start")).select(*slot, F.col("inner").alias("left"), F.col("outer").alias("right"))
    return first.unionByName(second)


def overlapping_within(rows: DataFrame, slot: list[str], key: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """As overlapping, of one table with itself: left has the smaller key. Keys are unique."""
    own = _timed(rows, slot, start, end)
    pairs = _within(met(own, own, slot, Tree(own)))
    earlier = F.when(F.equal_null("inner_start", "outer_start"), F.col(f"outer.{key}") < F.col(f"inner.{key}")).otherwise(True)
    swap = F.col(f"outer.{key}") < F.col(f"inner.{key}")
    pairs = pairs.where(earlier & (F.col(f"outer.{key}") != F.col(f"inner.{key}")))
    return pairs.select(*slot, F.when(swap, F.col("outer")).otherwise(F.col("inner")).alias("left"), F.when(swap, F.col("inner")).otherwise(F.col("outer")).alias("right"))


# --- containment -----------------------------------------------------------------------------------------------------

#: Code points of a gram; terms that are copied to every task, beyond which their keys are joined by sort and merge.
GRAM, TERMS = 3, 100_000
WORD = r"[\p{L}\p{N}]+"


def _grams(text: Column, size: int) -> Column:
    """Distinct grams, from an array of code points, so that a long text is cut in one pass."""
    points = F.filter(F.split(text, ""), lambda c: c != "")
    at = F.sequence(F.lit(0), F.size(points) - size)
    return F.when(F.size(points) >= size, F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(points, i + k) for k in range(size)])))).otherwise(F.array().cast("array<string>"))


def _inner_words(term: Column) -> Column:
    """Words with something else at both ends within the term: whoever holds the term holds them as whole words."""
    return F.array_distinct(F.regexp_extract_all(term, F.lit(rf"(?<=[^\p{{L}}\p{{N}}])({WORD})(?=[^\p{{L}}\p{{N}}])"), F.lit(1)))


def _marked(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(kind), k))


def containing(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term): every distinct term and the texts that hold it. texts: text_id, text; terms: term (null and empty: nowhere).

    A term's key is the rarest in these texts of its inner words, or of its grams if it has none, or itself if it is shorter
    than a gram. Texts give their words and the grams of the lengths that some term needs; a text then meets the terms whose key
    it has, and is searched for them. Terms that are few are copied to where the texts lie, so that texts don't move.
    """
    own = terms.select("term").where("term <> ''").distinct()
    keys = F.when(F.size(_inner_words(F.col("term"))) > 0, _marked("w", _inner_words(F.col("term")))).when(F.length("term") >= GRAM, _marked(str(GRAM), _grams(F.col("term"), GRAM))).otherwise(F.array(F.concat(F.length("term").cast("string"), F.col("term"))))
    own = own.select("term", F.explode(keys).alias("key"))
    shapes = sorted(r["kind"] for r in own.select(F.substring("key", 1, 1).alias("kind")).distinct().collect())  # w, 1, 2 or 3
    if not shapes:
        return texts.select("text_id", F.lit("").alias("term")).where(F.lit(False))
    held = F.concat(*[_marked("w", F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))) if s == "w" else _marked(s, _grams(F.col("text"), int(s))) for s in shapes])
    found = texts.where("text is not null").select("text_id", "text", F.explode(held).alias("key"))
    wanted, few = own.select("key").distinct(), own.count() <= TERMS * GRAM
    near = (lambda rows: F.broadcast(rows)) if few else (lambda rows: rows.hint("merge"))
    counts = found.select("key").join(near(wanted), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    # A key that no text has leads nowhere, and so does its term.
    rarest = own.join(counts, "key", "left").groupBy("term").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    if few:
        return found.join(F.broadcast(rarest), "key").where(F.contains("text", "term")).select("text_id", "term")
    met_ = found.select("text_id", "key").join(rarest.hint("merge"), "key").select("text_id", "term")
    return met_.join(texts, "text_id").where(F.contains("text", "term")).select("text_id", "term")


# --- alike names -----------------------------------------------------------------------------------------------------

#: Names of one group and key in a block; blocks meet two by two.
BLOCK = 500


def alike(names: DataFrame, group: list[str], least: float = 0.65) -> DataFrame:
    """group, a, b, similarity: distinct names a < b of a group whose sequence ratio (of a to b) is at least `least`, below 1.

    names: group columns and name. The ratio is twice the matched characters by all characters, and no more characters can
    match than two names have in common. So a pair at `least` has 2 * common >= least * (n + m), hence lengths near each other,
    and shares a character among the first few of each name in order of rareness (repeats of a character count as further
    ones). Names meet by such a character, in blocks of bounded size; a pair counts where its rarest shared one is. Then
    lengths and common characters are compared, and only what passes is measured.
    """
    own = names.where("name is not null").select(*group, "name").distinct()
    points = F.filter(F.split("name", ""), lambda c: c != "")
    # The k-th of equal characters is another one than the first.
    seen = own.select(*group, "name", F.posexplode(F.array_sort(points)).alias("place", "char"))
    each = seen.groupBy(*group, "name", "char").agg(F.count("*").alias("times"))
    each = each.select(*group, "name", "char", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    rank = each.groupBy("char", "nth").agg(F.count("*").alias("n"))
    lists = each.join(rank, ["char", "nth"]).groupBy(*group, "name").agg(F.array_sort(F.collect_list(F.struct("n", "char", "nth"))).alias("bag"))
    size = F.size("bag")
    # The shortest partner has least / (2 - least) of the length, and all of it must be common.
    prefix = F.slice("bag", 1, size - F.ceil(size * (least / (2 - least)) - 1e-9).cast("int") + 1)
    # A name without characters is alike nothing but itself.
    keyed = lists.withColumn("prefix", prefix).select(*group, "name", "bag", "prefix", F.explode("prefix").alias("key"))
    sizes = keyed.groupBy(*group, "key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    dealt = keyed.join(sizes, [*group, "key"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*group, "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "name", "bag", "prefix")
    cell = [*group, "key", "low", "high"]
    left = dealt.select(*cell, F.col("own").alias("a_block"), F.col("name").alias("a"), F.col("bag").alias("a_bag"), F.col("prefix").alias("a_prefix"))
    right = dealt.select(*cell, F.col("own").alias("b_block"), F.col("name").alias("b"), F.col("bag").alias("b_bag"), F.col("prefix").alias("b_prefix"))
    pairs = left.join(right, cell).where("a < b").where((F.col("low") == F.col("high")) | (F.col("a_block") != F.col("b_block")))
    total = F.size("a_bag") + F.size("b_bag")
    pairs = pairs.where(2 * F.least(F.size("a_bag"), F.size("b_bag")) >= least * total - 1e-9)
    pairs = pairs.where(F.array_min(F.array_intersect("a_prefix", "b_prefix")) == F.col("key"))
    pairs = pairs.where(2 * F.size(F.array_intersect("a_bag", "b_bag")) >= least * total - 1e-9).select(*group, "a", "b")
    measured = pairs.repartition(*group, "a", "b").withColumn("similarity", plain.sequence_ratio("a", "b"))
    return measured.where((F.col("similarity") >= least) & (F.col("similarity") < 1))
