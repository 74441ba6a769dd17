"""Areas under the ROC curve of resampled clusters, without a table of draws.

How often a cluster is drawn follows from its number alone: the draws of a replicate
are split over halves of the clusters, halves of halves and so on, each split seeded
by the half it divides.  So rows are shuffled once, to the range of scores they lie
in, and the draws of the clusters met there are worked out on the spot.  What is
shuffled afterwards is a row a range and replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored
from .hot import hot_hashes
from .ranking import auc
from .resample import _compared, numbered

_LEAF = 16  # clusters that are no longer halved
_REPLICATES = 64  # worked out at a time; part of the seed, so it does not follow the data
_RANGES = 2048


def draws_of(places: np.ndarray, clusters: int, first: int, replicates: int, seed: int) -> np.ndarray:
    """How often each of ``places``, sorted numbers below ``clusters``, is drawn in replicates ``first`` and on: a row a place.

    Only the halves that hold a wanted place are split, so the work follows the
    number of places, not of clusters.
    """
    out = np.zeros((len(places), replicates), dtype=np.int64)
    todo = [(0, clusters, 0, len(places), np.full(replicates, clusters))]
    while todo:
        low, high, i, j, drawn = todo.pop()
        if i == j:
            continue
        rng = np.random.Generator(np.random.PCG64([seed, first, low, high]))
        if high - low <= _LEAF:
            out[i:j] = rng.multinomial(drawn, np.full(high - low, 1 / (high - low))).T[places[i:j] - low]
            continue
        middle = (low + high) // 2
        left = rng.binomial(drawn, (middle - low) / (high - low))
        cut = i + int(np.searchsorted(places[i:j], middle))
        todo += [(low, middle, i, cut, left), (middle, high, cut, j, drawn - left)]
    return out


def _placed(cells: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``cells`` with ``range`` and ``part``: values of many rows are ranges of their own, in as many parts as they fill ranges."""
    cuts = {score: np.unique(np.array(e, dtype=np.float64), return_counts=True) for score, e in edges.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, no = batch.column("_v").to_numpy(), batch.column("cluster_no").to_numpy()
            names = np.array(batch.column("score").to_pylist(), dtype=object)
            where, part = np.zeros(len(v), dtype=np.int32), np.zeros(len(v), dtype=np.int32)
            for score, (edge, filled) in cuts.items():
                own = np.flatnonzero(names == score)
                i = np.searchsorted(edge, v[own], side="right")
                times = np.where(i > 0, np.concatenate([[0], filled])[i], 0)
                tied = (times > 1) & (np.concatenate([[np.nan], edge])[i] == v[own])
                where[own] = 2 * i + ~tied  # a frequent value comes before the range that it opens
                part[own] = np.where(tied, no[own] % np.maximum(times, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), pa.array(part)], names=[*batch.schema.names, "range", "part"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInArrow(place, f"{kind}, range int, part int")


def resampled_auc(df: DataFrame, cluster: str, scores: list[str], target: str, replicates: int = 1000, seed: int = 1, rows_a_range: int = 20_000) -> DataFrame:
    """``(score, rep, pos, neg, auc)``: the AUC of each score when as many clusters as there are are drawn with replacement.

    All scores share the draws, and the same input gives the same draws under any
    partitioning.  Rows first become counts of each cluster's distinct scores.
    These are dealt to ranges of scores; within a range pairs are counted over its
    distinct scores, across ranges from the ranges' sums.  A score of very many
    rows needs no order, so it is spread over parts, and a cluster of very many
    rows gets its number by a broadcast.

    ``target`` is 0 or 1.  Rows with a null score or target count in no AUC, but
    their clusters can be drawn; null clusters are one cluster; NaN is the largest
    score; a replicate with one class has a null AUC; an empty table gives no rows.
    """
    text = F.coalesce(F.col(cluster).cast("string"), F.lit("\0null")).alias("_c")
    long = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("_v")) for s in scores])
    with scratch(df.sparkSession) as keep:
        numbers = numbered(df.select(text).distinct(), "_c").select("_c", "cluster_no")
        clusters = numbers.count()
        rows = df.select(text, F.col(target).cast("long").alias("_y"), F.inline(long)).filter("_v is not null and _y is not null")
        cells = stored(rows.groupBy("_c", "score", "_v").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q")))
        size = max([r["count"] for r in cells.groupBy("score").count().collect()], default=0)  # a number a score
        ranges = min(_RANGES, -(-size // rows_a_range))
        edges: dict[str, list[float]] = {s: [] for s in scores}
        if ranges > 1:
            shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
            found = cells.filter("not isnan(_v)").groupBy("score").agg(F.percentile_approx("_v", shares, 16 * ranges).alias("e"))
            edges |= {r.score: r.e for r in found.collect()}  # `_RANGES` numbers a score at most
        hot = hot_hashes(cells, ["_c"])
        is_hot = F.xxhash64("_c").isin(hot) if hot else F.lit(False)
        known = cells.filter(~is_hot).join(numbers, "_c")
        if hot:
            known = known.unionByName(cells.filter(is_hot).join(F.broadcast(numbers.filter(is_hot)), "_c"))

        def draw(table: pa.Table) -> pa.Table:
            table = table.sort_by("_v")
            v, p, q = (table.column(c).to_numpy() for c in ("_v", "_p", "_q"))
            here, code = np.unique(table.column("cluster_no").to_numpy(), return_inverse=True)
            tied = table.column("range")[0].as_py() % 2 == 0
            starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) & ~np.isnan(v[:-1])]))
            sums = []
            for first in range(0, replicates, _REPLICATES):
                times = draws_of(here, clusters, first, _REPLICATES, seed)[code].astype(np.float64)
                pos, neg = (np.add.reduceat(times * n[:, None], starts, axis=0) for n in (p, q))
                won = pos * (np.cumsum(neg, axis=0) - neg / 2)
                sums.append(np.stack([pos.sum(axis=0), neg.sum(axis=0), 0 * won.sum(axis=0) if tied else won.sum(axis=0)]))
            p, q, u = np.concatenate(sums, axis=1)[:, :replicates]
            n = np.zeros(replicates, dtype=np.int64)
            key = [pa.array(n.astype(np.int32) + table.column("range")[0].as_py()), pa.array(np.arange(replicates, dtype=np.int32))]
            return pa.table([pa.array([table.column("score")[0].as_py()] * replicates), *key, pa.array(p), pa.array(q), pa.array(u)], names=["score", "range", "rep", "p", "q", "u"])

        parts = _placed(known.drop("_c"), edges).groupBy("score", "range", "part").applyInArrow(draw, "score string, range int, rep int, p double, q double, u double")
        each = parts.groupBy("score", "rep", "range").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("u").alias("u"))
        over = Window.partitionBy("score", "rep").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # `_RANGES` rows twice at most
        within = F.when(F.col("range") % 2 == 0, F.col("p") * F.col("q") / 2).otherwise(F.col("u"))
        each = each.withColumn("w", F.col("p") * F.coalesce(F.sum("q").over(over), F.lit(0.0)) + within)
        out = each.groupBy("score", "rep").agg(F.sum("p").cast("long").alias("pos"), F.sum("q").cast("long").alias("neg"), F.sum("w").alias("_w"))
        pairs = F.col("pos").cast("double") * F.col("neg")
        return keep(stored(out.select("score", "rep", "pos", "neg", F.when(pairs > 0, F.col("_w") / pairs).alias("auc"))))


def resampled_auc_intervals(df: DataFrame, cluster: str, scores: list[str], target: str, reference: str | None = None, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """``(score, estimate, low, high, difference, diff_low, diff_high)`` by :func:`resampled_auc`; differences are to ``reference``, the first score unless told."""
    long = df.select(target, F.inline(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("_v")) for s in scores]))).filter(F.col("_v").isNotNull() & F.col(target).isNotNull())
    reps = resampled_auc(df, cluster, scores, target, replicates, seed).select("rep", "score", F.col("auc").alias("x"))
    return _compared(auc(long, ["score"], "_v", target).select("score", F.col("auc").alias("x")), reps, "score", reference or scores[0])
