"""Centroid clustering of whole-number vectors, assignments found by Orchard search.

Each centroid has the list of all others in order of distance.  A vector walks the
list of the centroid it holds; as soon as a closer centroid turns up, the walk goes
on in that one's list.  It ends where the next centroid lies strictly beyond twice
the vector's own distance: by the triangle inequality none of the rest is as close.
All numbers are whole, so ties and stops are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import scratch, stored, unused

#: Squared lengths must stay below this, so that squared distances fit into 64 bits.
_LONGEST = float(1 << 60)


def whole_vectors(df: DataFrame, vector: Column, name: str, dim: int | None = None, scale: int = 256, longest: float = _LONGEST) -> DataFrame:
    """``df`` with ``name``, the vector's components as whole numbers; rows whose vector cannot take part go.

    Those are vectors that are null, hold null or non-finite components, have
    another number of components than ``dim``, or are so long that their exact
    products and distances would not fit.
    """
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(F.transform(v, lambda x: x * float(scale)), F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1))
    good = v.isNotNull() & fine & (length < longest) & (F.lit(True) if dim is None else F.size(v) == dim)
    whole = F.transform(v, lambda x: F.floor(x * float(scale)).cast("long"))
    return df.filter(F.coalesce(good, F.lit(False))).withColumn(name, whole)


class Orchard:
    """Centroids (k x d whole numbers) with each one's neighbours in order of distance."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.int64)
        gap = self.c[:, None, :] - self.c[None, :, :]
        apart = np.einsum("ijd,ijd->ij", gap, gap)
        self.order = np.argsort(apart, axis=1, kind="stable")  # ties: the smaller number first
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.start = int(np.argmin(apart.sum(axis=1, dtype=np.float64)))  # the most central one
        self.tested = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
        n, k = len(x), len(self.c)
        at, place = np.full(n, self.start), np.zeros(n, dtype=np.int64)
        gap = x - self.c[self.start]
        best = np.einsum("ij,ij->i", gap, gap)
        seen = np.zeros((n, k), dtype=bool)
        seen[:, self.start] = True
        walking = np.arange(n) if k > 1 else np.zeros(0, dtype=np.int64)
        while len(walking):
            own, where = at[walking], place[walking]
            walking = walking[-(-self.apart[own, where] // 4) <= best[walking]]  # not strictly beyond twice the distance
            if not len(walking):
                break
            other = self.order[at[walking], place[walking]]
            place[walking] += 1
            new = ~seen[walking, other]
            rows, other = walking[new], other[new]
            seen[rows, other] = True
            self.tested += len(rows)
            gap = x[rows] - self.c[other]
            d = np.einsum("ij,ij->i", gap, gap)
            closer = (d < best[rows]) | ((d == best[rows]) & (other < at[rows]))
            rows = rows[closer]
            best[rows], at[rows], place[rows] = d[closer], other[closer], 0
            walking = walking[place[walking] < k]
        return at, best


def _pieces(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            piece = batch.slice(a, rows)
            yield piece, piece.column("_w").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(piece.num_rows, dim)


def _summed(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task and cluster, how many vectors it has and their componentwise sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        k, dim = search.c.shape
        for _, x in _pieces(batches, dim):
            at, _ = search.nearest(x)
            count = np.bincount(at, minlength=k)
            order = np.argsort(at, kind="stable")
            used = np.flatnonzero(count)
            sums = np.add.reduceat(x[order], np.cumsum(count[used]) - count[used], axis=0) if len(used) else np.zeros((0, dim), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(sums), pa.list_(pa.int64()))], names=["c", "n", "s"])

    return run


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid replaced by its vectors' mean, rounded down; k x d sums reach the driver, whatever the table's size."""
    part = vectors.select("_w").mapInArrow(_summed(centroids), "c int, n long, s array<long>")
    cells = part.select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in cells.collect():
        out[r.c, r.i] = int(r.x) // r.n
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``df``'s rows with ``cluster, distance, cluster_inertia, inertia, centroid_sha256``, by k-means of whole-number vectors.

    Components are ``floor(scale * x)``.  Centroids start as the k vectors with the
    smallest sha256 of ``seed:id``; ``rounds`` times every vector goes to the
    nearest (squared Euclidean distance, ties to the smaller number) and non-empty
    centroids move to their vectors' mean, rounded down; then vectors are assigned
    once more.  ``distance`` is squared; the inertias sum it over the cluster and
    over all (null beyond 64 bits).  The hash is that of the final centroid's components as decimal
    numbers, joined by commas.

    Vectors that are null, hold null or non-finite components or have another
    length than ``dim`` are left out, as are those longer than 2^30 after scaling,
    whose distances are no 64-bit numbers.  Repeated rows each count; of equal ids,
    the smaller vector starts first; rows without an id are assigned, but no
    centroid starts from them.  With fewer than k such vectors there are fewer
    centroids; without one, or with an empty table, there are no rows.  Columns of
    ``df`` stay; an added name that exists already gets an underscore more.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k must be 1 or more, rounds not negative")
    names = [unused(c, df.columns) for c in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    own = df.withColumnsRenamed({c: f"_in{i}" for i, c in enumerate(df.columns)})  # free of clashes below
    back = [F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)]
    of = {c.lower(): f"_in{i}" for i, c in enumerate(df.columns)}
    rows = whole_vectors(own, F.col(of[vector_col.lower()]), "_w", dim, scale)
    with scratch(df.sparkSession) as keep:
        vectors = stored(rows)
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(of[id_col.lower()]).cast("string")), 256)
        first = vectors.select(key.alias("h"), "_w").filter("h is not null").orderBy("h", "_w").limit(k).collect()
        if not first:
            vectors, first = vectors.limit(0), [[None, [0] * dim]]
        centroids = np.array([r[1] for r in first], dtype=np.int64)
        for _ in range(rounds):
            centroids = _moved(vectors, centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Orchard(centroids)
            for piece, x in _pieces(batches, dim):
                at, d = search.nearest(x)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(at.astype(np.int32)), pa.array(d)], names=[*kept, "_c", "_d"])

        kept = [c for c in vectors.columns if c != "_w"]
        schema = vectors.drop("_w").withColumns({"_c": F.lit(0), "_d": F.lit(0).cast("long")}).schema
        out = keep(stored(vectors.mapInArrow(assign, schema)))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = out.groupBy("_c").agg(F.sum(F.col("_d").cast("decimal(38,0)")).alias("_x")).withColumn("_all", F.lit(0))  # k rows at most
    total = sums.groupBy("_all").agg(F.sum("_x").alias("_y"))
    facts = sums.join(F.broadcast(total), "_all").select("_c", F.col("_x").try_cast("long").alias("_x"), F.col("_y").try_cast("long").alias("_y"))
    hashes = F.element_at(F.array(*[F.lit(x) for x in digest]), F.col("_c") + 1)
    new = [F.col("_c"), F.col("_d"), F.col("_x"), F.col("_y"), hashes]
    return out.join(F.broadcast(facts), "_c").select(*back, *[c.alias(n) for c, n in zip(new, names, strict=True)])
