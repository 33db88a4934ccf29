"""Intervals and decisions over trials: Wilson bounds, cluster bootstraps, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.columns import order_statistic
from trialspark.shared import materialise

#: Replicates of a bootstrap; clusters up to which every task has all of them; clusters of a leaf of the tree beyond; and leaves of
#: one piece at most (16 MB of numbers).
REPLICATES, DIRECT, LEAF, MOST_LEAVES = 20_000, 100_000, 1 << 15, 32
# What the draws are made of; a SQL twin has the same.
MULTIPLIER, STRIDE, SEED_STRIDE, OFFSET = np.uint32(73244475), 2654435761, 97531, np.uint32(1374496523)


def wilson(k: Column, n: Column, z: float = 1.96, upper: bool = False) -> Column:
    """Wilson score bound of k successes in n; for n = 0 the bound is 0 (lower) or 1 (upper)."""
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre + (spread if upper else -spread)) / (1 + z * z / n)).otherwise(1.0 if upper else 0.0)


def _numbered(clusters: DataFrame, order: str) -> tuple[DataFrame, int]:
    spark = clusters.sparkSession
    pieces = clusters.repartitionByRange(order).withColumn("piece", F.spark_partition_id())
    pieces = materialise(pieces, "pieces")  # range bounds are sampled anew in each execution, so the pieces are fixed first
    pieces = pieces.withColumn("at", F.row_number().over(Window.partitionBy("piece").orderBy(order)))
    bases, n = [], 0
    for r in sorted(pieces.groupBy("piece").agg(F.count("*").alias("n")).collect()):  # one row for each partition; pieces ascend
        bases.append((r["piece"], n))
        n += r["n"]
    base = spark.createDataFrame(bases, "piece int, base long")
    return pieces.join(F.broadcast(base), "piece").select(*clusters.columns, (F.col("base") + F.col("at") - 1).alias("j"), F.lit(n).cast("long").alias("n")), n


def numbered(clusters: DataFrame, order: str) -> DataFrame:
    """clusters (one row for each, already aggregated) with j from 0 on in the given order, and their number n."""
    return _numbered(clusters, order)[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 32-bit integers that spreads every bit."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * MULTIPLIER
    return x ^ (x >> np.uint32(16))


def draws(seed: int, b: int, first: int, last: int, n: int) -> np.ndarray:
    """Numbers below n drawn at places first to last - 1 of replicate b: whole-number arithmetic that any engine can repeat."""
    one = _mixed(np.array([((b + 1) * STRIDE + seed * SEED_STRIDE) % 2**32], np.uint32))
    two = _mixed(one + OFFSET)
    h = _mixed(_mixed(one + np.arange(first, last, dtype=np.uint32)) ^ two)
    return (h.astype(np.uint64) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _direct(seed: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                at = ((b, draws(seed, b, 0, r.n, r.n)) for b in range(r.lo, r.hi))
                yield pd.DataFrame([(b, float(r.x[i].sum()), float(r.y[i].sum()), len(i)) for b, i in at], columns=["b", "top", "bottom", "drawn"])

    return rows


def stream(seed: int, b: int, node: int) -> np.random.Generator:
    """Random numbers of replicate b at a node of the tree, whichever task asks: a counter-based generator set to that place."""
    return np.random.Generator(np.random.Philox(key=seed, counter=(node << 128) | (b << 64)))


def leaf_counts(seed: int, b: int, n: int, first: int, last: int, leaf: int = LEAF) -> dict[int, int]:
    """How many of the n draws of replicate b fall on each of the leaves first to last - 1 of leaf numbers.

    The n draws are split between the halves of the leaves by a binomial number, and so on down; what lies beyond the asked
    leaves is not followed. Together the counts are multinomial, and n in all.
    """
    out, todo = {}, [(1, 0, -(-n // leaf), n)]
    while todo:
        node, lo, hi, count = todo.pop()
        if hi <= first or lo >= last or lo >= hi:
            continue
        if hi - lo == 1:
            out[lo] = count
            continue
        mid = (lo + hi) // 2
        share = (mid - lo) * leaf / (min(hi * leaf, n) - lo * leaf)
        left = int(stream(seed, b, node).binomial(count, share))
        todo += [(2 * node, lo, mid, left), (2 * node + 1, mid, hi, count - left)]
    return out


def _tree(seed: int, replicates: int, leaf: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, replicates))
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                first = int(r.low) // leaf
                leaves = -(-len(r.x) // leaf)
                for b in range(replicates):
                    for at, count in leaf_counts(seed, b, int(r.n), first, first + leaves, leaf).items():
                        lo = (at - first) * leaf
                        x, y = r.x[lo : lo + leaf], r.y[lo : lo + leaf]
                        i = stream(seed, b, at | 1 << 60).integers(0, len(x), count)
                        sums[:, b] += x[i].sum(), y[i].sum(), count
        yield pd.DataFrame({"b": np.arange(replicates), "top": sums[0], "bottom": sums[1], "drawn": sums[2].astype(np.int64)})

    return rows


def _kinds(seed: int):  # noqa: ANN202
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                counts = ((b, stream(seed, b, 0).multinomial(r.n, r.m / r.n)) for b in range(r.lo, r.hi))
                yield pd.DataFrame([(b, float(c @ r.x), float(c @ r.y), int(c.sum())) for b, c in counts], columns=["b", "top", "bottom", "drawn"])

    return rows


def _spans(held: DataFrame, replicates: int, parallel: int) -> DataFrame:
    """One small row, copied to each task, with its range of replicates."""
    step = max(1, -(-replicates // parallel))
    spans = held.withColumn("lo", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(step)))).withColumn("hi", F.least(F.col("lo") + step, F.lit(replicates)))
    return spans.repartition(parallel)


def replicate_sums(clusters: DataFrame, order: str, top: str, bottom: str | None, replicates: int, seed: int, pieces: int | None = None, direct: int = DIRECT, leaf: int = LEAF) -> DataFrame:
    """b, top, bottom, drawn, method: of each replicate the sums over what was drawn, and how many numbers were; see bootstrap."""
    number = F.coalesce(F.col(top).cast("double"), F.lit(0.0)).alias("x"), (F.lit(1.0) if bottom is None else F.coalesce(F.col(bottom).cast("double"), F.lit(0.0))).alias("y")
    clusters = materialise(clusters.select(order, *number), "clusters")
    parallel = 2 * clusters.sparkSession.sparkContext.defaultParallelism
    schema = "b long, top double, bottom double, drawn long"
    total = lambda sums, method: sums.groupBy("b").agg(*(F.sum(x).alias(x) for x in ("top", "bottom", "drawn"))).withColumn("method", F.lit(method))
    if clusters.count() > direct:
        kinds = materialise(clusters.groupBy("x", "y").agg(F.count("*").alias("m")), "kinds")
        if kinds.count() <= direct:
            held = kinds.agg(F.sum("m").alias("n"), F.reverse(F.array_sort(F.collect_list(F.struct("m", "x", "y")))).alias("v")).select("n", "v.m", "v.x", "v.y")
            return total(_spans(held, replicates, parallel).mapInPandas(_kinds(seed), schema), "kinds")
    c, n = _numbered(clusters, order)
    method = "draws" if n <= direct else "tree"
    leaves = max(1, -(-n // leaf))
    size = max(n, 1) if method == "draws" else leaf * min(MOST_LEAVES, -(-leaves // (pieces or min(parallel, leaves))))
    low = (F.floor(F.col("j") / size) * size).alias("low")
    cells = c.select(low, "n", F.struct("j", "x", "y").alias("v"))
    held = cells.groupBy("low", "n").agg(F.array_sort(F.collect_list("v")).alias("v")).select("low", "n", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    if method == "draws":
        sums = _spans(held, replicates, parallel).mapInPandas(_direct(seed), schema)
    else:
        sums = held.repartition(-(-n // size), "low").mapInPandas(_tree(seed, replicates, leaf), schema).where("drawn > 0")
    return total(sums, method)


def bootstrap(clusters: DataFrame, order: str, top: str, bottom: str | None, replicates: int = REPLICATES, seed: int = 7, **how: int) -> DataFrame:
    """b, value, method for each replicate: the mean of top over n clusters drawn with replacement, or the sum of top over the sum
    of bottom; a null counts as 0. Without clusters there are no rows.

    Up to DIRECT clusters (method draws) every task has all of them, and draws for a range of replicates; a draw is a function of
    seed, b and place (see draws), so that any engine can repeat it. Beyond, clusters of equal numbers are one kind, and up to DIRECT
    kinds every task has all of them with how many there are: how often a replicate draws each is one multinomial number, so that the
    work does not grow with the clusters (method kinds). With more kinds (method tree) clusters lie in leaves of LEAF numbers,
    and a task holds some leaves: how many of a replicate's n draws fall on them it learns from binomial splits on the way down
    to them (see leaf_counts), and it draws these and no others. What comes out depends on seed and n, not on the number of
    tasks. A task gives one row of sums for each replicate, however many pieces it had; no draw is shuffled.
    """
    return replicate_sums(clusters, order, top, bottom, replicates, seed, **how).select("b", (F.col("top") / F.col("bottom")).alias("value"), "method")


def intervals(values: DataFrame, **at: float) -> DataFrame:
    """One row of order statistics of value at the given shares, and the method of the draws; replicates are few, so they are
    gathered."""
    return values.agg(F.collect_list("value").alias("v"), F.max("method").alias("method")).select(*(F.round(order_statistic(F.col("v"), p), 9).alias(k) for k, p in at.items()), "method")


def zero_defect_bound(n: Column, level: float = 0.05) -> Column:
    """Upper bound of the share of bad roots when n sampled ones are all good."""
    return 1 - F.pow(F.lit(level), 1.0 / n)


def triage(admissible: Column, exposures: Column, systematic: Column) -> Column:
    return F.when((admissible <= 0.25) | systematic, "drop").when((admissible >= 0.5) & (exposures == 0), "proceed").otherwise("owner")


def variance_gate(varying: Column, mixed: Column, groups: Column) -> Column:
    """Enough groups vary (lower Wilson bound of their share above .60) and a fifth of all are mixed."""
    return (wilson(varying, groups) > 0.60) & (mixed >= 0.20 * groups)


def in_range(mean: Column) -> Column:
    """A mean that leaves room on both sides."""
    return (mean >= 0.20) & (mean <= 0.80)


def headroom(mean: Column, upper: Column) -> Column:
    """In range, and the upper end of its interval below .90."""
    return in_range(mean) & (upper < 0.90)


def headline(**incidences: Column) -> Column:
    """The name of the largest incidence of those at .20 or above, of equals the first; null if there is none."""
    best = F.greatest(*incidences.values())
    return F.when(best >= 0.20, F.coalesce(*(F.when(v == best, name) for name, v in incidences.items())))
