"""Evaluation: ranking, classification and agreement metrics, usage and cost, experiments, juries and fits."""

from __future__ import annotations

import hashlib
import math
import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import components, with_checkpoints

log2 = lambda c: F.log(c) / math.log(2)


def ranking(ranked: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """Per query: recall at k, reciprocal rank, NDCG at 10 (binary). ranked: query_id, memory_id, rank; gold: query_id, memory_id."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("gold").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / log2(i + 1))
    hit = ranked.join(gold.select("query_id", "memory_id").withColumn("hit", F.lit(1)), ["query_id", "memory_id"], "left")
    found = hit.groupBy("query_id").agg(
        F.count(F.when((F.col("rank") <= k) & F.col("hit").isNotNull(), 1)).alias("found"), F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("hit").isNotNull() & (F.col("rank") <= 10), 1 / log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    return size.join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("gold")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def graded(ranked: DataFrame, at: int = 10) -> DataFrame:
    """Per query: graded NDCG and the recall of required rows at 5. ranked: query_id, rank, relevance, required."""
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "rank"))
    gain = lambda place: F.when(place <= at, (F.pow(F.lit(2.0), F.col("relevance")) - 1) / log2(place + 1)).otherwise(0.0)
    rows = ranked.withColumn("ideal_rank", ideal_rank)
    out = rows.groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col("ideal_rank"))).alias("idcg"), F.count_if(F.col("required") & (F.col("rank") <= 5)).alias("got"), F.count_if("required").alias("required"))
    return out.select("query_id", F.coalesce(F.try_divide("dcg", "idcg"), F.lit(1.0)).alias("ndcg"), F.try_divide("got", "required").alias("required_recall"))


def classification(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per label: precision, recall, F1; 1 where nothing was predicted or expected."""
    labels = rows.select(F.explode(F.array(expected, predicted)).alias("label")).distinct()
    counts = rows.groupBy(F.col(expected).alias("e"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))  # labels squared at most
    joined = labels.join(counts, (F.col("label") == F.col("e")) | (F.col("label") == F.col("p")))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = joined.groupBy("label").agg(total((F.col("e") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), total((F.col("e") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"), total((F.col("e") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"))
    out = out.withColumns({"precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0)), "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(1.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def kappa(rows: DataFrame, left: str, right: str, by: list[str] | None = None, weight: str = "none", categories: int = 2) -> DataFrame:
    """Chance-corrected agreement, plain or with linear or quadratic weights over numbered categories."""
    by = by or []
    cells = rows.groupBy(*by, F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("n"))
    distance = (F.col("l") != F.col("r")).cast("double") if weight == "none" else F.pow(F.abs(F.col("l") - F.col("r")) / (categories - 1), F.lit(1.0 if weight == "linear" else 2.0))
    lefts = cells.groupBy(*by, "l").agg(F.sum("n").alias("nl"))
    rights = cells.groupBy(*by, "r").agg(F.sum("n").alias("nr"))
    observed = cells.groupBy(*by).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * distance) / F.sum("n")).alias("observed"))
    both = lefts.join(rights, by) if by else lefts.join(F.broadcast(rights))  # categories squared
    expected = both.groupBy(*by).agg(F.sum(F.col("nl") * F.col("nr") * distance).alias("crossed"))
    out = observed.join(expected, by) if by else observed.join(F.broadcast(expected))
    chance = F.col("crossed") / (F.col("total") * F.col("total"))
    return out.select(*by, "total", (1 - F.col("observed")).alias("agreement"), F.when(chance == 0, F.when(F.col("observed") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("observed") / chance).alias("kappa"))


def whole_sum(column: str) -> Column:
    """The sum, or null if any value is null."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.sum(column))


def usage_totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Requests and token sums per group; a missing cache split makes the group's split unknown."""
    return usage.groupBy(*by).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), whole_sum("cache_hit_tokens").alias("cache_hit_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("latency_seconds").alias("latency_seconds"))


def costed(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost_usd (decimal), null where the price or its cache split is unknown. prices: provider, miss, hit, output per million."""
    number = lambda c: F.col(c).cast("decimal(20,0)")
    million = F.lit(1_000_000).cast("decimal(10,0)")
    split = F.when(F.col("hit").isNotNull(), (number("input_tokens") - number("cache_hit_tokens")) * F.col("miss") + number("cache_hit_tokens") * F.col("hit"))
    whole = F.when(F.col("hit").isNull() | (F.col("hit") == F.col("miss")), number("input_tokens") * F.col("miss"))
    inputs = F.when(F.col("cache_hit_tokens").isNotNull(), split).otherwise(whole)
    return usage.join(F.broadcast(prices), "provider", "left").withColumn("cost_usd", ((inputs + number("output_tokens") * F.col("output")) / million).cast("decimal(38,12)"))


def paired(rows: DataFrame, task: str, arm: str, value: str, baseline: str, treatment: str, *more: str) -> DataFrame:
    """Tasks (with more columns that a task determines) with both arms: means of each and their difference."""
    out = rows.groupBy(task, *more).agg(F.avg(F.when(F.col(arm) == baseline, F.col(value))).alias("baseline"), F.avg(F.when(F.col(arm) == treatment, F.col(value))).alias("treatment"))
    return out.where("baseline is not null and treatment is not null").withColumn("difference", F.col("treatment") - F.col("baseline"))


#: Modulus and factors of the numbers that resampling draws: the fifth power is a permutation modulo this prime.
PRIME, FACTORS = (1 << 31) - 1, (48271, 69621, 16807, 39373)
#: Pairs of a slice of draws and how many slices there are at most, pairs of a row and of a table that a task looks up, and numbers
#: drawn at a time, which a processor's cache holds.
BLOCK, SLICES, PACK, HELD, DRAWN = 65536, 32, 1 << 16, 1 << 23, 1 << 16


def _fifth(x: np.ndarray) -> np.ndarray:
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _splits(path: list[int], name: str, rounds: int, seed: int, block: int) -> np.ndarray:
    """How many of its stratum's draws a block has in each round. path: pairs of its ancestors in the tree of blocks and of itself,
    the whole first. Each node deals its draws to its two children by a binomial number, which both make alike from the node's seed.
    `resampled` draws by place instead, which SQL can state for any number of pairs."""
    counts = np.full(rounds, path[0], dtype=np.int64)
    depth = len(path) - 1
    for level in range(depth):
        node, right = block >> (depth - level), block >> (depth - level - 1) & 1
        left_share = (path[level + 1] if not right else path[level] - path[level + 1]) / path[level]
        drawn = np.random.default_rng([seed, zlib.crc32(name.encode()), level, node]).binomial(counts, left_share)
        counts = counts - drawn if right else drawn
    return counts


def resampled(pairs: DataFrame, task: str, stratum: str | None, seed: int, rounds: int = 4000, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row by resampling with replacement: difference (the mean), low and high (its 95 % interval), one_sided_low (5 %) and
    improvement (the share of rounds above zero). pairs: task (long, one row each), difference; null differences take no part.

    Each round draws as many pairs as a stratum has; with strata, a round and the mean itself are means over strata of the means
    within them. A draw takes the pair at a place, in order of tasks, that follows from stratum, draw and round alone: lost tasks
    draw the same again, and neither `block` nor `held` changes a result. Draws of all rounds are dealt to slices of about `block`
    pairs, SLICES at most, and pairs to tables of at most `held`; a task draws one slice, looks up what lies in one table and gives
    one sum a round. So the pairs are copied once a slice, and beyond `held` pairs each table draws again. Of nothing, all columns
    are null.
    """
    with_checkpoints(pairs.sparkSession)
    rows = pairs.select(F.col(task).cast("long").alias("task"), F.col("difference").cast("double").alias("difference"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("stratum")).where("difference is not null")
    # Sorted by all tasks and kept, so that the numbers below are those of one order.
    ordered = rows.orderBy("stratum", "task", "difference").select("stratum", "difference", F.monotonically_increasing_id().alias("id")).withColumn("part", F.shiftright("id", 33)).checkpoint()
    sizes = ordered.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("difference").alias("mean"))
    # A row for each stratum of a partition: where it begins, and how many of the stratum come before.
    whole = Window.partitionBy("stratum")
    starts = ordered.groupBy("stratum", "part").agg(F.min("id").alias("first"), F.count("*").alias("own"))
    starts = starts.select("stratum", "part", (F.sum("own").over(whole.orderBy("part")) - F.col("own") - F.col("first")).alias("shift"), F.sum("own").over(whole).alias("n"))
    placed = ordered.join(starts, ["stratum", "part"]).select("stratum", "n", "difference", (F.col("id") + F.col("shift")).alias("place"))
    size = min(PACK, held)
    packs = placed.groupBy("stratum", "n", F.floor(F.col("place") / size).alias("pack")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "difference"))), lambda x: x["difference"]).alias("values"))
    slices = F.least(F.lit(SLICES), F.ceil(F.col("n") / block)).cast("int")
    dealt = packs.withColumns({"slices": slices, "table": F.floor(F.col("pack") / (held // size))}).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name, own = key[0], int(key[2])
        frame = frame.sort_values("pack")
        values, low, n, parts = np.concatenate(frame["values"].to_numpy()), int(frame.pack.iloc[0]) * size, int(frame.n.iloc[0]), int(frame.slices.iloc[0])
        a, b, c, _ = FACTORS
        salt = int(hashlib.md5(name.encode()).hexdigest()[:7], 16)
        draws = _fifth((np.arange(n * own // parts, n * (own + 1) // parts, dtype=np.int64) * a + salt * c + seed) % PRIME)
        sums = np.zeros(rounds)
        for first in range(0, len(draws), DRAWN):
            part = draws[first : first + DRAWN]
            step = max(1, DRAWN // len(part))
            for start in range(0, rounds, step):
                number = np.arange(start + 1, min(rounds, start + step) + 1, dtype=np.int64)[:, None]
                places = _fifth((part + number * b) % PRIME) % n - low
                if len(values) < n:
                    here = (places >= 0) & (places < len(values))
                    taken = np.where(here, values[np.where(here, places, 0)], 0.0)
                else:
                    taken = values[places]
                sums[start : start + step] += taken.sum(axis=1)
        return pd.DataFrame({"stratum": name, "number": np.arange(1, rounds + 1), "total": sums})

    # As many tasks as the session shuffles to: the tables are small, what is drawn from them is not.
    cell = ["stratum", "table", "slice"]
    drawn = dealt.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell).groupBy(*cell).applyInPandas(draw, "stratum string, number long, total double")
    within = drawn.groupBy("number", "stratum").agg(F.sum("total").alias("total"))
    means = within.join(sizes.select("stratum", "n"), "stratum").groupBy("number").agg(F.avg(F.col("total") / F.col("n")).alias("mean"))
    ordered_means = means.agg(F.array_sort(F.collect_list("mean")).alias("means"), F.avg((F.col("mean") > 0).cast("int")).alias("improvement"))  # as many as rounds
    at = lambda place, name: F.try_element_at("means", F.lit(place + 1)).alias(name)
    interval = ordered_means.select(at(int(rounds * 0.025), "low"), at(min(rounds - 1, int(rounds * 0.975)), "high"), at(int(rounds * 0.05), "one_sided_low"), "improvement")
    return sizes.agg(F.avg("mean").alias("difference")).join(interval)  # one row each


def sample_size(effect: float, deviation: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs needed to see such an effect."""
    z = NormalDist().inv_cdf
    return math.ceil(((z(1 - alpha / 2) + z(power)) * deviation / effect) ** 2)


def sample_sizes(effect: Column, deviation: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """As sample_size, of columns; rounded to six places before it is rounded up."""
    z = NormalDist().inv_cdf
    return F.ceil(F.round(F.pow((z(1 - alpha / 2) + z(power)) * deviation / effect, 2), 6))


def nearest_rank(values: DataFrame, by: list[str], column: str, share: float) -> DataFrame:
    """The value at place ceil(share * n) of each group."""
    return values.groupBy(*by).agg(F.expr(f"percentile_disc({share}) within group (order by {column})").alias("value"))


def jury(votes: DataFrame, alpha: float = 0.25, floor: float = 0.05) -> DataFrame:
    """Per comparison: smoothed probabilities of a, b and tie, entropy and complete pairs.

    votes: comparison_id, judge_id, family, presentation, preference (a, b, tie, abstain), confidence. A judge counts if both
    orders were shown and agree.
    """
    judges = votes.groupBy("comparison_id", "judge_id", "family").agg(F.count("*").alias("n"), F.count_distinct("presentation").alias("orders"), F.min("preference").alias("low"), F.max("preference").alias("high"), F.bool_or(F.col("preference") == "abstain").alias("abstains"), F.min("confidence").alias("confidence"))
    judges = judges.withColumn("complete", (F.col("n") == 2) & (F.col("orders") == 2)).withColumn("counts", F.col("complete") & ~F.col("abstains") & (F.col("low") == F.col("high")))
    weight = F.greatest(F.col("confidence"), F.lit(floor))
    share = lambda p: (F.sum(F.when(F.col("low") == p, weight).otherwise(0.0)) / F.sum(weight)).alias(p)
    families = judges.where("counts").groupBy("comparison_id", "family").agg(share("a"), share("b"), share("tie"))
    sums = families.groupBy("comparison_id").agg(*[F.sum(p).alias(p) for p in ("a", "b", "tie")], F.count("*").alias("families"))
    every = judges.groupBy("comparison_id").agg(F.count("*").alias("judges"), F.count_if("complete").alias("complete"))
    out = every.join(sums, "comparison_id", "left").na.fill(0.0, ["a", "b", "tie"]).na.fill(0, ["families"])
    total = F.col("a") + F.col("b") + F.col("tie") + 3 * alpha
    out = out.withColumns({f"p_{p}": (F.col(p) + alpha) / total for p in ("a", "b", "tie")})
    entropy = -sum((F.col(f"p_{p}") * F.log(f"p_{p}") for p in ("a", "b", "tie")), F.lit(0.0)) / math.log(3)
    return out.select("comparison_id", "judges", "complete", "families", "p_a", "p_b", "p_tie", entropy.alias("entropy"))


#: Penalty of utilities, least change that goes on, and pairs of a query, or of queries together, that one task fits.
RIDGE, SETTLED, FITTED = 0.08, 1e-9, 50_000


def _speed(reach: Column | np.ndarray, sqrt) -> Column | np.ndarray:
    """Momentum of a fit whose curvature lies within the ridge and `reach`."""
    root = sqrt(reach / RIDGE)
    return (root - 1) / (root + 1)


def _utilities(frame: pd.DataFrame) -> pd.DataFrame:
    """Utilities of whole queries, all of them in one array: no query's step depends on another's."""
    ends = pd.MultiIndex.from_arrays([np.tile(frame.query_id.to_numpy(), 2), np.concatenate((frame.a_id, frame.b_id))])
    place, names = pd.factorize(ends)
    a, b = np.split(place, 2)
    target, w, n = frame.p_a.to_numpy(), frame.weight.to_numpy(), len(names)
    queries = np.array([name[0] for name in names], dtype=np.int64)
    group = pd.factorize(queries)[0]
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    if len(np.unique(root)) > group.max(initial=-1) + 1:
        raise ValueError("comparisons must connect every candidate of a query")
    bound = (np.bincount(a, w, n) + np.bincount(b, w, n)) / 2 + RIDGE  # a pair's curvature is at most a quarter of its weight, on a difference
    reach = np.zeros(group.max(initial=-1) + 1)
    np.maximum.at(reach, group, bound)
    pace = _speed(reach, np.sqrt)[group]
    u, ahead = np.zeros(n), np.zeros(n)
    for _ in range(100_000):
        error = w * (target - 1 / (1 + np.exp(ahead[b] - ahead[a])))
        now = ahead + (np.bincount(a, error, n) - np.bincount(b, error, n) - RIDGE * ahead) / bound
        change = np.abs(now - u).max(initial=0)
        ahead, u = now + pace * (now - u), now
        if change < SETTLED:
            break
    return pd.DataFrame({"query_id": queries, "candidate_id": np.array([name[1] for name in names], dtype=np.int64), "utility": u})


def _wide_utilities(pairs: DataFrame, rounds: int, settled: float) -> DataFrame:
    """The same steps as Spark jobs, for queries of more pairs than a task may hold: a step joins the pairs with both ends' utilities
    and adds up by candidate. Pairs are written by query and end once; utilities are cut from their lineage in every step."""
    with_checkpoints(pairs.sparkSession)
    both = pairs.select("query_id", F.col("a_id").alias("own"), F.col("b_id").alias("other"), F.col("p_a").alias("target"), "weight")
    both = both.unionByName(pairs.select("query_id", F.col("b_id").alias("own"), F.col("a_id").alias("other"), (1 - F.col("p_a")).alias("target"), "weight")).checkpoint()
    name = lambda end: F.concat_ws(":", F.col("query_id").cast("string"), F.col(end).cast("string")).alias(end)
    roots = components(both.select(name("own"), name("other")).toDF("a", "b"))
    apart = roots.select(F.substring_index("node", ":", 1).alias("query_id"), "root").groupBy("query_id").agg(F.count_distinct("root").alias("n")).where("n > 1")
    if not apart.isEmpty():
        raise ValueError("comparisons must connect every candidate of a query")
    bounds = both.groupBy("query_id", "own").agg((F.sum("weight") / 2 + RIDGE).alias("bound"))
    pace = bounds.groupBy("query_id").agg(_speed(F.max("bound"), F.sqrt).alias("pace"))
    state = bounds.join(pace, "query_id").withColumns({"u": F.lit(0.0), "ahead": F.lit(0.0)}).checkpoint()
    for _ in range(rounds):
        ends = state.select("query_id", F.col("own").alias("other"), F.col("ahead").alias("there"))
        # Each end's pairs are summed by its own utility later: the slope needs both, so the near end is joined as well.
        met = both.join(ends, ["query_id", "other"]).join(state.select("query_id", "own", F.col("ahead").alias("here")), ["query_id", "own"])
        slopes = met.groupBy("query_id", "own").agg(F.sum(F.col("weight") * (F.col("target") - 1 / (1 + F.exp(F.col("there") - F.col("here"))))).alias("slope"))
        now = F.col("ahead") + (F.col("slope") - RIDGE * F.col("ahead")) / F.col("bound")
        moved = state.join(slopes, ["query_id", "own"]).withColumn("now", now)
        state = moved.select("query_id", "own", "bound", "pace", F.col("now").alias("u"), (F.col("now") + F.col("pace") * (F.col("now") - F.col("u"))).alias("ahead"), F.abs(F.col("now") - F.col("u")).alias("change")).checkpoint()
        if (state.agg(F.max("change")).first()[0] or 0) < settled:
            return state.select("query_id", F.col("own").alias("candidate_id"), F.col("u").alias("utility"))
    raise RuntimeError(f"utilities did not settle in {rounds} steps")


def bradley_terry(results: DataFrame, fitted: int = FITTED, rounds: int = 500, settled: float = 1e-6) -> DataFrame:
    """(query_id, candidate_id, utility, rank, comparisons) by maximum likelihood under a ridge of 0.08; rank from 1, ties to the
    smaller id. results: query_id, a_id, b_id (longs), p_a, optionally p_tie (half a win for either), weight.

    Results without a weight above zero, with a null or of a candidate with itself take no part. A query's candidates must hang
    together by comparisons: else it is an error. Both fits take accelerated steps that a bound of the curvature scales, which raise
    the likelihood. Queries of at most `fitted` pairs are fitted in tasks, many of them in one array; larger ones by Spark jobs,
    until no utility moves by `settled`.
    """
    tie = F.coalesce(F.col("p_tie"), F.lit(0.0)) / 2 if "p_tie" in results.columns else F.lit(0.0)
    used = results.where("weight > 0 and a_id <> b_id and query_id is not null and p_a is not null").withColumn("p", F.col("p_a") + tie)
    # Results of one pair are one row, in the order of ids, so that a query has as many rows as pairs of candidates.
    turned = F.col("a_id") > F.col("b_id")
    ordered = used.select(F.col("query_id").cast("long").alias("query_id"), F.least("a_id", "b_id").cast("long").alias("a_id"), F.greatest("a_id", "b_id").cast("long").alias("b_id"), F.when(turned, 1 - F.col("p")).otherwise(F.col("p")).cast("double").alias("p"), F.col("weight").cast("double").alias("weight"))
    pairs = ordered.groupBy("query_id", "a_id", "b_id").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p_a"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    with_checkpoints(results.sparkSession)
    pairs = pairs.checkpoint()
    sizes = pairs.groupBy("query_id").agg(F.count("*").alias("size"))
    small, total = sizes.where(F.col("size") <= fitted), pairs.count()
    tasks = max(1, -(-total // fitted))
    placed = pairs.join(small.select("query_id"), "query_id").withColumn("task", F.pmod(F.xxhash64("query_id"), F.lit(tasks)))
    fits = placed.groupBy("task").applyInPandas(_utilities, "query_id long, candidate_id long, utility double")
    large = sizes.where(F.col("size") > fitted).select("query_id")
    if not large.isEmpty():
        fits = fits.unionByName(_wide_utilities(pairs.join(large, "query_id"), rounds, settled))
    ends = pairs.select("query_id", F.explode(F.array("a_id", "b_id")).alias("candidate_id"), "n")
    counts = ends.groupBy("query_id", "candidate_id").agg(F.sum("n").alias("comparisons"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("utility", 10)), "candidate_id")).cast("long")
    return fits.join(counts, ["query_id", "candidate_id"]).withColumn("rank", rank)


#: Penalties that a fit tries; steps of all its models together, each of which is one pass over the pairs.
PENALTIES, STEPS = (0.01, 0.1, 1.0, 10.0), 20


def fold_fits(pairs: DataFrame, features: list[str], fold: str | None = None, dev: Column | None = None, penalties: tuple[float, ...] = PENALTIES, signs: list[int] | None = None, steps: int = STEPS) -> list[dict]:
    """Logistic models of feature differences (label 1 if the left one is preferred): for each fold left out, the weights at the
    penalty of least log loss on its dev rows (column dev; none: on its own rows). One dict each: left_out, penalty, weights, loss.

    Newton's steps are taken for all folds and penalties together: every pass makes the sums of each fold for all models, and a
    model adds up the folds that it doesn't leave out. So the number of jobs is that of steps, not of models. A weight with a sign
    is kept at zero while its slope points the wrong way (an active set). Folds are few: their sums come to the driver. Rows with a
    null feature, label or fold take no part; without rows there is no model.
    """
    with_checkpoints(pairs.sparkSession)
    key = F.col(fold).cast("string") if fold else F.lit("all")
    rows = pairs.select(key.alias("fold"), F.col("label").cast("double").alias("label"), F.coalesce(dev, F.lit(False)).alias("dev") if dev is not None else F.lit(False).alias("dev"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).where(" and ".join(f"x{i} is not null" for i in range(len(features))) + " and label is not null").checkpoint()
    folds = sorted(r["fold"] for r in rows.select("fold").where("fold is not null").distinct().collect())
    models = [(f, p) for f in (folds if fold else [None]) for p in penalties]
    d, m, split = len(features), len(models), dev is not None
    upper = np.triu_indices(d)
    beta, free = np.zeros((m, d)), np.ones((m, d), bool)

    def passed(weights: np.ndarray, losses: bool) -> dict[str, np.ndarray]:
        """By fold, for every model: slopes and curvatures of training rows, or summed log loss and number of dev rows."""

        def gather(frames):
            held: dict[str, np.ndarray] = {}
            for frame in frames:
                for name, own in frame.groupby("fold"):
                    own = own[own.dev == losses] if split else own
                    x, y = own[[f"x{i}" for i in range(d)]].to_numpy(), own.label.to_numpy()[:, None]
                    z = x @ weights.T
                    if losses:
                        total = np.stack((np.logaddexp(0, np.where(y > 0.5, -z, z)).sum(axis=0), np.full(m, float(len(own)))), axis=1)
                    else:
                        q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                        curve = np.stack([((x[:, i] * x[:, j])[:, None] * q * (1 - q)).sum(axis=0) for i, j in zip(*upper, strict=True)], axis=1)
                        total = np.concatenate(((y - q).T @ x, curve), axis=1)
                    held[name] = held.get(name, 0) + total
            yield pd.DataFrame([(name, place, value) for name, total in held.items() for place, value in enumerate(total.ravel().tolist())], columns=["fold", "place", "value"]).astype({"place": "int32", "value": "float64"})

        out = {name: np.zeros(m * (2 if losses else d + len(upper[0]))) for name in folds}
        for r in rows.mapInPandas(gather, "fold string, place int, value double").groupBy("fold", "place").agg(F.sum("value").alias("value")).collect():  # folds x models x sums
            if r["fold"] in out:
                out[r["fold"]][r["place"]] = r["value"]
        return {name: total.reshape(m, -1) for name, total in out.items()}

    def kept(sums: dict[str, np.ndarray], k: int) -> np.ndarray:
        return sum((total[k] for name, total in sums.items() if name != models[k][0]), np.zeros(next(iter(sums.values())).shape[1])) if sums else np.zeros(0)

    open_ = set(range(m)) if folds else set()
    for _ in range(steps):
        if not open_:
            break
        sums = passed(beta, False)
        for k in sorted(open_):
            values, penalty = kept(sums, k), models[k][1]
            slope = values[:d] - penalty * beta[k]
            curve = penalty * np.eye(d)
            curve[upper] += values[d:]
            curve = np.triu(curve) + np.triu(curve, 1).T
            if signs is not None:  # what is held at zero goes on once its slope points the right way
                free[k] |= slope * np.array(signs) > 1e-9
            step = np.zeros(d)
            if free[k].any():
                step[free[k]] = np.linalg.solve(curve[np.ix_(free[k], free[k])], slope[free[k]])
            now = beta[k] + step
            if signs is not None:
                wrong = now * np.array(signs) < 0
                now[wrong], free[k] = 0.0, free[k] & ~wrong
            if np.abs(now - beta[k]).max(initial=0) < 1e-10:
                open_.discard(k)
            beta[k] = now
    sums, best = passed(beta, True) if folds else {}, {}
    for k, (left_out, penalty) in enumerate(models if folds else []):
        loss, n = kept(sums, k)
        found = {"left_out": left_out, "penalty": penalty, "weights": beta[k].tolist(), "loss": loss / n if n else float("inf")}
        if left_out not in best or found["loss"] < best[left_out]["loss"] - 1e-12:
            best[left_out] = found
    return list(best.values())


def probability_losses(rows: DataFrame, p: str, label: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted log loss, Brier score and accuracy."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    loss = -(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q))
    mean = lambda c: F.sum(c * F.col(weight)) / F.sum(weight)
    return rows.groupBy(*by).agg(mean(loss).alias("log_loss"), mean(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("brier"), mean(((F.col(p) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def gate(metrics: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """metrics with the failed rules' names and whether all passed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return metrics.withColumn("failed", F.array_join(failed, ",")).withColumn("passed", F.col("failed") == "")


def hash_split(rows: DataFrame, key: str, seed: str, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """rows with split: train, dev or test by the place of a keyed hash."""
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("split", F.when(place < shares[0], "train").when(place < shares[1], "dev").otherwise("test"))


def hash_sample(rows: DataFrame, by: str, key: str, seed: str, n: int) -> DataFrame:
    """n rows of each group in the order of a keyed hash."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(by).cast("string"), F.col(key).cast("string")), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("place") <= n)


def ranked_split(groups: DataFrame, column: str, seed: str) -> DataFrame:
    """groups (distinct values of a column, few of them) with split: 60, 20 and 20 of a hundred by the order of their digests."""
    order = Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256))
    placed = groups.withColumns({"place": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy())})
    edge = lambda share: F.bround(F.col("n") * share, 0)
    return placed.select(column, F.when(F.col("place") < edge(0.6), "train").when(F.col("place") < edge(0.8), "dev").otherwise("test").alias("split"))
