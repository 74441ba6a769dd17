"""Nearest neighbours by a block matrix join with int8 tiles.

Vectors become int8 codes, and codes are what is dealt into query and candidate
blocks of bounded size.  A tile, one query block against one candidate block,
multiplies codes; the norms of what quantisation left out bound the error of every
product, so a pair whose upper bound lies below the k-th best lower bound cannot
be among the k nearest.  The bounds of all tiles are merged, and only for pairs
that survive the merge are the vectors themselves fetched and the score computed
in double precision.  The result is exact: quantisation only decides what is
computed twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import scratch, stored

_STEP = 1024  # dimensions at once: sums of products of int8 codes stay exact in float32, which BLAS multiplies
_CODES = "_id long, _same long, _q boolean, _dim int, _code binary, _scale double, _norm double, _miss double"
_FOUND = "query_id long, query_same long, vec_id long, same long, low double, high double"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """int8 codes of the unit vectors, with their scales and the norms of what is coded and of what is missed."""
    for batch in batches:
        for piece in (batch.slice(a, 2048) for a in range(0, batch.num_rows, 2048)):
            dims = piece.column("_dim").to_numpy()
            for dim in np.unique(dims):
                own = piece.filter(pa.array(dims == dim))
                x = own.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, dim)
                unit = x / np.max(np.abs(x), axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                scale = np.max(np.abs(unit), axis=1) / 127.0
                code = np.rint(unit / scale[:, None]).astype(np.int8)
                coded = code * scale[:, None]
                norms = [np.sqrt((y * y).sum(axis=1)) for y in (coded, unit - coded)]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in ("_id", "_same", "_q", "_dim")), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale), *map(pa.array, norms)],
                    names=["_id", "_same", "_q", "_dim", "_code", "_scale", "_norm", "_miss"],
                )


class _Block:
    """The coded vectors of a block, in order of id."""

    def __init__(self, table: pa.Table, most_equal: int | None = None):
        ids, same = table.column("_id").to_numpy(), table.column("_same").to_numpy()
        if most_equal is not None:  # of equal vectors, more than so many of the smallest ids are nobody's nearest
            order = np.lexsort((ids, same))
            head = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
            rank = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
            table = table.take(pa.array(order[rank < most_equal]))
        table = table.sort_by("_id")
        self.id, self.same = table.column("_id").to_numpy(), table.column("_same").to_numpy()
        self.scale, self.norm, self.miss = (table.column(c).to_numpy() for c in ("_scale", "_norm", "_miss"))
        self.code = np.frombuffer(b"".join(table.column("_code").to_pylist()), dtype=np.int8).reshape(len(self.id), -1)
        self.heads = np.flatnonzero(np.append(True, self.id[1:] != self.id[:-1]))


def _tile(q: _Block, c: _Block, k: int, rows: int = 256) -> Iterator[tuple[np.ndarray, ...]]:
    """(query place, candidate place, lower bound, upper bound) of the pairs that may be among the query's k nearest ids of this tile."""
    right = c.code.astype(np.float32)
    for a in range(0, len(q.id), rows):
        some = slice(a, a + rows)
        left = q.code[some].astype(np.float32)
        dots = sum((left[:, d : d + _STEP] @ right[:, d : d + _STEP].T).astype(np.float64) for d in range(0, left.shape[1], _STEP))
        about = dots * q.scale[some, None] * c.scale[None, :]
        bound = q.miss[some, None] + q.norm[some, None] * c.miss[None, :] + 1e-9
        about[q.id[some, None] == c.id[None, :]] = -np.inf
        low = about - bound
        of_id = low if len(c.heads) == len(c.id) else np.maximum.reduceat(low, c.heads, axis=1)  # an id of several vectors counts once
        kth = np.partition(of_id, -k, axis=1)[:, -k] if of_id.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((about + bound >= kth[:, None]) & np.isfinite(about))
        yield a + i, j, low[i, j], (about + bound)[i, j]


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 8192, block: int = 8192) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of largest cosine for each query row.

    All rows are candidates, but for rows with the query's own id.  Ties go to the
    smaller id; a query with fewer than k candidates gets all of them.  Vectors
    that are null, empty, zero or hold null or non-finite components, and rows
    without an id, take no part; vectors of different lengths do not meet.  An id
    that occurs in several rows counts once, with its best score.  Other columns
    are not read; an empty table, or one without queries, gives no rows.

    Blocks are dealt by a hash of id and vector, so many equal vectors, and an id
    of very many vectors, spread over all of them; equal rows count once before
    they are dealt.  Vectors are told apart by 64-bit hashes.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    v = F.col(vector_col).cast("array<double>")
    size = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: F.greatest(a, F.abs(x)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"), fine.alias("_fine")).filter("_id is not null and _v is not null and _fine")
    rows = rows.select("_id", "_v", "_q", F.size("_v").alias("_dim"), F.xxhash64("_v").alias("_same"))

    dealt = lambda f, of: F.pmod(F.xxhash64("_id", "_same"), F.lit(of)).alias(f)
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))
    code = ["_id", "_same", "_dim", "_code", "_scale", "_norm", "_miss"]

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if queries.num_rows and candidates.num_rows:
            q, c = _Block(queries), _Block(candidates, k + 1)
            parts = list(_tile(q, c, k))
        i, j, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        own = [q.id[i], q.same[i], c.id[j], c.same[j]] if len(i) else [np.zeros(0, np.int64)] * 4
        return pa.table([*own, low, high], names=[x.split()[0] for x in _FOUND.split(", ")])

    with scratch(df.sparkSession) as keep:
        coded = rows.mapInArrow(_encode, _CODES).groupBy("_id", "_same", "_dim").agg(F.bool_or("_q").alias("_q"), *[F.first(c).alias(c) for c in ("_code", "_scale", "_norm", "_miss")])
        coded = stored(coded)
        n, n_query = coded.agg(F.count("*"), F.count_if("_q")).first()
        blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n_query // query_block))
        left = coded.filter("_q").select(*code, dealt("_qb", query_blocks), every(blocks).alias("_cb"))
        right = coded.select(*code, dealt("_cb", blocks), every(query_blocks).alias("_qb"))
        keys = ["_dim", "_qb", "_cb"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, _FOUND)
        # the k-th best lower bound over all tiles, an id counting once
        of_id = F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy(F.desc("low"), "query_same", "same"))
        found = found.withColumn("_first", of_id == 1)
        order = Window.partitionBy("query_id").orderBy(F.desc("_first"), F.desc("low"), "vec_id")
        found = found.withColumn("_no", F.row_number().over(order))
        kth = F.max(F.when(F.col("_first") & (F.col("_no") == k), F.col("low"))).over(Window.partitionBy("query_id"))
        pairs = keep(stored(found.withColumn("_kth", kth).filter("_kth is null or high >= _kth").select("query_id", "query_same", "vec_id", "same")))
    # very small or large components are scaled by a power of two, which changes no digit of the cosine
    largest = F.aggregate("_v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    power = F.when(largest.between(1e-100, 1e100), F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(largest))))
    scaled = F.transform(F.array(power), lambda p: F.transform("_v", lambda x: x / p))[0]  # the power once a vector, not once a component
    own = rows.select("_id", "_same", scaled.alias("_v"))
    own = own.withColumn("_norm", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).dropDuplicates(["_id", "_same"])
    q = own.select(F.col("_id").alias("query_id"), F.col("_same").alias("query_same"), F.col("_v").alias("_qv"), F.col("_norm").alias("_qn"))
    c = own.select(F.col("_id").alias("vec_id"), F.col("_same").alias("same"), F.col("_v").alias("_cv"), F.col("_norm").alias("_cn"))
    both = pairs.join(q, ["query_id", "query_same"]).join(c, ["vec_id", "same"])
    dot = F.aggregate(F.zip_with("_qv", "_cv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = both.select("query_id", "vec_id", (dot / (F.col("_qn") * F.col("_cn"))).alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
