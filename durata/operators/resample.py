"""Cluster bootstrap from sufficient sums: draws are hashes, so they are the same under any partitioning.

Two ways to draw.  :func:`multiplicities` writes every draw as a row, which SQL can
repeat; :func:`resampled` splits the number of draws over halves of the clusters,
halves of halves and so on, and never has a table of draws.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import hash_uniform
from ..sources.scratch import scratch, stored


def numbered(clusters: DataFrame, key: str) -> DataFrame:
    """``clusters`` with ``cluster_no`` from 0 by key, and ``_k``, their number: a stored table, which estimate and replicates read.

    Numbers come from counts of hash ranges and a row number within each, so no
    task sorts all clusters.
    """
    clusters = stored(clusters)
    rows = clusters.withColumn("_b", F.substring(F.md5(F.col(key).cast("string")), 1, 2))
    size = rows.groupBy("_b").agg(F.count("*").alias("_c"))  # 256 rows at most
    w = Window.partitionBy(F.lit(0)).orderBy("_b")
    base = size.select("_b", (F.sum("_c").over(w) - F.col("_c")).alias("_base"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_k"))
    own = Window.partitionBy("_b").orderBy(F.md5(F.col(key).cast("string")), key)
    return stored(rows.withColumn("_r", F.row_number().over(own)).join(F.broadcast(base), "_b").withColumn("cluster_no", F.col("_base") + F.col("_r") - 1).drop("_b", "_r", "_base"))


def multiplicities(clusters: DataFrame, key: str, replicates: int, seed: int = 1) -> DataFrame:
    """``(rep, cluster_no, m)``: how often each cluster is drawn; as many draws as clusters in each replicate."""
    k = clusters.count()
    draws = clusters.sparkSession.range(replicates * k).select(F.floor(F.col("id") / F.lit(k)).cast("int").alias("rep"), F.col("id"))
    no = F.floor(hash_uniform(F.lit(seed), F.col("id")) * F.lit(k)).cast("long")
    return draws.select("rep", no.alias("cluster_no")).groupBy("rep", "cluster_no").agg(F.count("*").alias("m"))


def bootstrap_ratio(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int = 200, seed: int = 1) -> DataFrame:
    """``(estimate, low, high, replicates)``: a ratio of sums and its 95 % percentile interval.

    Rows reduce to two sums a cluster; a replicate without denominator is null and left out.
    """
    sums = numbered(df.groupBy(cluster).agg(F.sum(numerator).alias("_a"), F.sum(denominator).alias("_b2")), cluster)
    total = sums.agg((F.sum("_a") / F.nullif(F.sum("_b2"), F.lit(0))).alias("estimate"))
    reps = multiplicities(sums, cluster, replicates, seed).join(sums.select("cluster_no", "_a", "_b2"), "cluster_no")
    reps = reps.groupBy("rep").agg((F.sum(F.col("m") * F.col("_a")) / F.nullif(F.sum(F.col("m") * F.col("_b2")), F.lit(0))).alias("x"))
    q = reps.agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("x").alias("replicates"))
    return total.crossJoin(q).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")


def bootstrap_differences(df: DataFrame, cluster: str, methods: dict[str, tuple[Column, Column]], reference: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """``(method, estimate, low, high, difference, diff_low, diff_high)`` of ratios of sums, all from the same draws.

    ``methods`` has each method's numerator and denominator; differences are to
    ``reference``, for which they are null.
    """
    long = F.array(*[F.struct(F.lit(m).alias("method"), a.cast("double").alias("_x"), b.cast("double").alias("_y")) for m, (a, b) in methods.items()])
    sums = df.select(cluster, F.inline(long)).groupBy(cluster, "method").agg(F.sum("_x").alias("_a"), F.sum("_y").alias("_b2"))
    clusters = numbered(df.select(cluster).distinct(), cluster)
    drawn = multiplicities(clusters, cluster, replicates, seed).join(clusters.select(cluster, "cluster_no"), "cluster_no").join(sums, cluster)
    ratio = lambda m: F.sum(m * F.col("_a")) / F.nullif(F.sum(m * F.col("_b2")), F.lit(0.0))
    return _compared(sums.groupBy("method").agg(ratio(F.lit(1)).alias("x")), drawn.groupBy("rep", "method").agg(ratio(F.col("m")).alias("x")), "method", reference)


def _compared(whole: DataFrame, reps: DataFrame, name: str, reference: str) -> DataFrame:
    """Estimates and intervals of ``x`` by ``name``, and of its difference to the reference within each replicate."""
    pair = F.array(F.lit(0.025), F.lit(0.975))
    base = reps.filter(F.col(name) == reference).select("rep", F.col("x").alias("_ref"))
    q = reps.join(base, "rep", "left").groupBy(name).agg(F.percentile("x", pair).alias("q"), F.percentile(F.col("x") - F.col("_ref"), pair).alias("d"))
    point = whole.crossJoin(F.broadcast(whole.filter(F.col(name) == reference).select(F.col("x").alias("_ref"))))
    other = lambda c: F.when(F.col(name) != reference, c)
    return point.join(q, name).select(
        name, F.col("x").alias("estimate"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"),
        other(F.col("x") - F.col("_ref")).alias("difference"), other(F.col("d")[0]).alias("diff_low"), other(F.col("d")[1]).alias("diff_high"),
    )


def bootstrap_gap(df: DataFrame, cluster: str, high: str, target: str, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Gap and ratio of the rates of two groups with percentile intervals; rows follow their cluster."""
    h, y = F.col(high), F.col(target)
    sums = numbered(df.groupBy(cluster).agg(F.sum(h).alias("nh"), F.sum(h * y).alias("yh"), F.sum(1 - h).alias("nl"), F.sum((1 - h) * y).alias("yl")), cluster)
    hi = lambda m: F.sum(m * F.col("yh")) / F.nullif(F.sum(m * F.col("nh")), F.lit(0))
    lo = lambda m: F.sum(m * F.col("yl")) / F.nullif(F.sum(m * F.col("nl")), F.lit(0))
    one = sums.agg(hi(F.lit(1)).alias("h"), lo(F.lit(1)).alias("l"))
    reps = multiplicities(sums, cluster, replicates, seed).join(sums, "cluster_no").groupBy("rep").agg(hi(F.col("m")).alias("h"), lo(F.col("m")).alias("l"))
    pair = F.array(F.lit(0.025), F.lit(0.975))
    q = reps.agg(F.percentile(F.col("h") - F.col("l"), pair).alias("g"), F.percentile(F.col("h") / F.nullif("l", F.lit(0.0)), pair).alias("r"))
    return one.crossJoin(q).select((F.col("h") - F.col("l")).alias("gap"), F.col("g")[0].alias("gap_low"), F.col("g")[1].alias("gap_high"), (F.col("h") / F.nullif("l", F.lit(0.0))).alias("ratio"), F.col("r")[0].alias("ratio_low"), F.col("r")[1].alias("ratio_high"))


def bootstrap_auc(df: DataFrame, cluster: str, scores: list[str], target: str, reference: str | None = None, replicates: int = 100, seed: int = 1) -> DataFrame:
    """``(score, estimate, low, high, difference, diff_low, diff_high)`` by weighted AUCs of resampled clusters; all scores share the draws.

    Differences are to ``reference``, the first score unless told.
    """
    from .ranking import auc

    clusters = numbered(df.select(cluster).distinct(), cluster)
    long = df.select(cluster, target, F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("_v")) for s in scores])))
    cells = long.groupBy(cluster, "score", "_v").agg(F.count("*").alias("_n"), F.sum(target).alias("_p"))
    drawn = multiplicities(clusters, cluster, replicates, seed).join(clusters.select(cluster, "cluster_no"), "cluster_no").join(cells, cluster)
    both = F.array(F.struct(F.lit(1).alias("_y"), F.col("_p").alias("_c")), F.struct(F.lit(0).alias("_y"), (F.col("_n") - F.col("_p")).alias("_c")))
    drawn = drawn.groupBy("rep", "score", "_v").agg(F.sum(F.col("m") * F.col("_n")).alias("_n"), F.sum(F.col("m") * F.col("_p")).alias("_p")).select("rep", "score", "_v", F.inline(both))
    reps = auc(drawn, ["score", "rep"], "_v", "_y", "_c").select("rep", "score", F.col("auc").alias("x"))
    return _compared(auc(long, ["score"], "_v", target).select("score", F.col("auc").alias("x")), reps, "score", reference or scores[0])


def _drawn_in(sizes: list[int], place: int, replicates: int, seed: int) -> np.ndarray:
    """How many of all draws of each replicate fall into range ``place``, by halving the ranges.

    Each half gets a binomial share by its number of clusters.  A half's generator
    is seeded by the half, so every task that passes it sees the same shares.
    """
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high, drawn = 0, len(sizes), np.full(replicates, before[-1])
    while high - low > 1:
        middle = (low + high) // 2
        share = (before[middle] - before[low]) / max(before[high] - before[low], 1)
        left = np.random.default_rng([seed, 1, low, high]).binomial(drawn, share)
        low, high, drawn = (low, middle, left) if place < middle else (middle, high, drawn - left)
    return drawn


def resampled(df: DataFrame, cluster: str, sums: dict[str, Column], replicates: int = 1000, seed: int = 1, clusters_a_range: int = 20_000) -> DataFrame:
    """``(rep, draws, ..)``: sums over clusters drawn with replacement, as many as there are, for each replicate.

    Rows reduce to one row of sums a cluster.  Clusters lie in hash ranges of some
    ``clusters_a_range``; the draws of a replicate are split over the ranges (see
    :func:`_drawn_in`) and within a range over its clusters, where they are summed
    up at once.  What is shuffled afterwards is a row a range and replicate,
    whatever the number of clusters; what is sent along is one number a range.
    The same input gives the same draws under any partitioning.  Null clusters are
    one cluster; null sums count 0; an empty table gives no rows.
    """
    names = list(sums)
    text = F.coalesce(F.col(cluster).cast("string"), F.lit("\0null"))
    with scratch(df.sparkSession) as keep:
        per = df.groupBy(text.alias("_k")).agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(f"_s{i}") for i, c in enumerate(sums.values())])
        per = stored(per.withColumn("_h", F.xxhash64("_k")))
        ranges = max(1, -(-per.count() // clusters_a_range))
        per = per.withColumn("_range", F.pmod("_h", F.lit(ranges)).cast("int"))
        counted = {r["_range"]: r["count"] for r in per.groupBy("_range").count().collect()}  # a number a range
        sizes = [counted.get(i, 0) for i in range(ranges)]

        def draw(table: pa.Table) -> pa.Table:
            table = table.sort_by([("_h", "ascending"), ("_k", "ascending")])
            place = table.column("_range")[0].as_py()
            values = np.stack([np.ones(table.num_rows), *(table.column(f"_s{i}").to_numpy() for i in range(len(names)))], axis=1)
            drawn, out = _drawn_in(sizes, place, replicates, seed), []
            rng = np.random.default_rng([seed, 2, place])
            step = max(1, (1 << 21) // table.num_rows)  # some replicates at a time
            for a in range(0, replicates, step):
                counts = rng.multinomial(drawn[a : a + step], np.full(table.num_rows, 1 / table.num_rows))
                out.append(counts @ values)
            total = np.concatenate(out)
            return pa.table([pa.array(np.arange(replicates, dtype=np.int32)), *(pa.array(c) for c in total.T)], names=["rep", "draws", *[f"_s{i}" for i in range(len(names))]])

        parts = per.groupBy("_range").applyInArrow(draw, ", ".join(["rep int", "draws double", *[f"_s{i} double" for i in range(len(names))]]))
        out = parts.groupBy("rep").agg(F.sum("draws").cast("long").alias("draws"), *[F.sum(f"_s{i}").alias(name) for i, name in enumerate(names)])
        return keep(stored(out))


def resampled_interval(df: DataFrame, cluster: str, numerator: Column, denominator: Column, replicates: int = 1000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """``(estimate, low, high, replicates)`` of a ratio of sums by :func:`resampled`; replicates without denominator are left out."""
    reps = resampled(df, cluster, {"a": numerator, "b": denominator}, replicates, seed).select((F.col("a") / F.nullif("b", F.lit(0.0))).alias("x"))
    tail = (1 - level) / 2
    q = reps.agg(F.percentile("x", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.count("x").alias("replicates"))  # a value a replicate
    whole = df.agg((F.sum(numerator) / F.nullif(F.sum(denominator), F.lit(0))).alias("estimate"))
    return whole.crossJoin(q).select("estimate", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "replicates")
