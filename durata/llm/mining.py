"""Hard negatives by inner product, candidates pruned coordinate by coordinate.

Vectors lie in buckets of like length.  A bucket whose longest vector cannot reach
an anchor's threshold is passed over.  Otherwise the threshold, divided by both
lengths, bounds the angle between anchor and candidate, and so gives a range of
feasible values for each coordinate of a candidate's direction.  A bucket holds
each coordinate's values in order; the ranges of the anchor's few largest
coordinates, its focus, are looked up there and intersected, and only what is left
is multiplied out.  Components are whole numbers, so scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import whole_vectors
from .tables import scratch, stored

_CODES = "_id long, _same long, _label long, _q boolean, _dim int, _v binary, _len double"
_POSITIVE = "anchor_id long, anchor_same long, vec_id long, same long, score long"
_NEGATIVE = "anchor_id long, anchor_same long, positive_score long, vec_id long, same long, score long"
#: Squared lengths stay below this, so every product of two vectors is exact in doubles, whatever the order of its sum.
_LONGEST = float(1 << 52)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as 32-bit numbers in one binary, with the vector's length."""
    for batch in batches:
        w = batch.column("_w")
        x, count = w.flatten().to_numpy(zero_copy_only=False), w.value_lengths().to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(count) * 4).astype(np.int32)
        code = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype(np.int32).tobytes())])
        square = np.bincount(np.repeat(np.arange(batch.num_rows), count), weights=x.astype(np.float64) ** 2, minlength=batch.num_rows)
        own = [batch.column(c) for c in ("_id", "_same", "_label", "_q", "_dim")]
        yield pa.RecordBatch.from_arrays([*own, code, pa.array(np.sqrt(square))], names=[x.split()[0] for x in _CODES.split(", ")])


class _Rows:
    """Vectors of one table, by falling length and then id."""

    def __init__(self, table: pa.Table):
        size, ids = table.column("_len").to_numpy(), table.column("_id").to_numpy()
        table = table.take(pa.array(np.lexsort((ids, -size))))
        self.id, self.same, self.label, self.size = (table.column(c).to_numpy() for c in ("_id", "_same", "_label", "_len"))
        dim = table.column("_dim")[0].as_py()
        self.x = np.frombuffer(b"".join(table.column("_v").to_pylist()), dtype=np.int32).reshape(len(self.id), dim).astype(np.float64)
        self.unit = self.x / np.where(self.size > 0, self.size, 1.0)[:, None]


class Bucket:
    """Directions of like length with each coordinate's values in order."""

    def __init__(self, unit: np.ndarray, longest: float):
        self.unit, self.longest = unit, longest
        self.order = np.argsort(unit, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, direction: np.ndarray, least_cosine: float, focus: int = 4) -> np.ndarray | None:
        """Rows that may have that cosine to ``direction``, in order of place; None if nearly all may."""
        n, d = self.unit.shape
        at = np.argsort(-np.abs(direction), kind="stable")[:focus]
        own, angle = np.arccos(np.clip(direction[at], -1, 1)), np.arccos(np.clip(least_cosine, -1, 1))
        low, high = np.cos(np.minimum(own + angle, np.pi)) - 1e-9, np.cos(np.maximum(own - angle, 0)) + 1e-9
        ends = [(np.searchsorted(self.value[:, f], a, "left"), np.searchsorted(self.value[:, f], b, "right")) for f, a, b in zip(at, low, high, strict=True)]
        if not ends:
            return None
        least = int(np.argmin([b - a for a, b in ends]))
        a, b = ends[least]
        if b - a > n // 2:
            return None
        found = self.order[a:b, at[least]]
        for i, f in enumerate(at):
            if i != least:
                v = self.unit[found, f]
                found = found[(v >= low[i]) & (v <= high[i])]
        return np.sort(found)


class _Best:
    """The k rows of largest score so far for each list, ties to the smaller id and then hash."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def add(self, i: int, score: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        if len(score) > self.k:
            some = score >= np.partition(score, -self.k)[-self.k]
            score, ids, same = score[some], ids[some], same[some]
        s, v, h = (np.concatenate(x) for x in zip(self.found[i], (score, ids, same), strict=True))
        order = np.lexsort((h, v, -s))[: self.k]
        self.found[i] = (s[order], v[order], h[order])

    def kth(self, i: int, default: float) -> float:
        """A later row below this is not among the k best."""
        s = self.found[i][0]
        return max(default, s[-1]) if len(s) == self.k else default


def _search(q: _Rows, c: _Rows, least: np.ndarray, take, bucket_rows: int = 2048) -> None:
    """Give ``take(anchor, rows, scores)`` all rows whose score may reach ``least[anchor]``, which ``take`` returns anew and may raise."""
    alive = np.arange(len(q.id))
    for a in range(0, len(c.id), bucket_rows):
        part = slice(a, a + bucket_rows)
        longest = c.size[a]  # lengths fall, so this bounds all buckets to come
        alive = alive[q.size[alive] * longest * (1 + 1e-9) + 1e-9 >= least[alive]]
        if not len(alive):
            return
        bucket, wide = Bucket(c.unit[part], longest), []
        for i in alive:
            reach = q.size[i] * longest
            cosine = least[i] / reach - 1e-9 if reach > 0 else -1.0
            rows = bucket.candidates(q.unit[i], cosine) if cosine > 0 else None
            if rows is None:
                wide.append(i)
            elif len(rows):
                least[i] = take(i, a + rows, c.x[a + rows] @ q.x[i])
        for b in range(0, len(wide), 256):  # anchors that nothing is pruned for share one product
            some = wide[b : b + 256]
            for i, scores in zip(some, q.x[some] @ c.x[part].T, strict=True):
                near = np.flatnonzero(scores >= least[i])
                if len(near):
                    least[i] = take(i, a + near, scores[near])


def _positives(k: int):
    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and candidates.num_rows:
            anchors = anchors.rename_columns([c[1:] for c in anchors.column_names])
            q, c = _Rows(anchors), _Rows(candidates)
            best = _Best(len(q.id), k)

            def take(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
                other = c.id[rows] != q.id[i]
                best.add(i, scores[other], c.id[rows][other], c.same[rows][other])
                return best.kth(i, -np.inf)

            _search(q, c, np.full(len(q.id), -np.inf), take)
            out = [(q.id[i], q.same[i], v, h, s) for i, f in enumerate(best.found) for s, v, h in zip(*f, strict=True)]
        return _table(out, _POSITIVE)

    return tile


def _negatives(k: int, low: int, high: int):
    def tile(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and candidates.num_rows:
            anchors = anchors.rename_columns([c[1:] for c in anchors.column_names])
            q, c = _Rows(anchors), _Rows(candidates)
            asked = {(i, h): b for i, h, b in zip(*(anchors.column(x).to_pylist() for x in ("_id", "_same", "_bands")), strict=True)}
            bands = [asked[key] for key in zip(q.id.tolist(), q.same.tolist(), strict=True)]  # the rows' order is now that of their length
            first = np.cumsum([0, *map(len, bands)])
            best = _Best(int(first[-1]), k)
            bound = lambda s, share: s * share / 100  # noqa: E731  only where to look; scores are judged in whole numbers

            def take(i: int, rows: np.ndarray, scores: np.ndarray) -> float:
                other = c.label[rows] != q.label[i]
                rows, scores = rows[other], scores[other]
                whole, limits = scores.astype(np.int64), []
                for j, s in enumerate(bands[i]):
                    near = (100 * whole <= high * s) & (100 * whole >= low * s)
                    if near.any():
                        best.add(first[i] + j, scores[near], c.id[rows[near]], c.same[rows[near]])
                    limits.append(best.kth(first[i] + j, bound(s, low)))
                return min(limits) - 1e-6

            _search(q, c, np.array([bound(min(b), low) for b in bands]) - 1e-6, take)
            out = [(q.id[i], q.same[i], s, v, h, x) for i, own in enumerate(bands) for j, s in enumerate(own) for x, v, h in zip(*best.found[first[i] + j], strict=True)]
        return _table(out, _NEGATIVE)

    return tile


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(np.array(c, dtype=np.int64)) for c in columns], names=names)


def _tiles(left: DataFrame, right: DataFrame, keys: list[str]):
    left = left.select(*[F.col(c).alias(f"q{c}") for c in left.columns])  # both stem from one table, so names tell them apart
    return left.groupBy(*[f"q{c}" for c in keys]).cogroup(right.groupBy(*keys))


def _few(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table to be broadcast if it is small, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_numbers: int = 1 << 22, least_rows: int = 4096,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor and positive, the best rows of other labels in a band below the positive's score.

    Scores are inner products of the components ``floor(scale * x)``; higher ones
    come first, ties by smaller id.  An anchor's positives are its first
    ``positives`` rows of the same label with another id, its negatives for one of
    them the first ``negatives`` rows of another label with ``low * positive_score
    <= 100 * negative_score <= high * positive_score``.  A negative positive score
    leaves no such row if low < high.  Anchors with too few of either get what there is.

    Rows with a null id, label or vector, with null or non-finite components, or
    longer than 2^26 after scaling (their products are not exact) take no part;
    vectors of different lengths do not meet.  Ids are whole numbers.  Repeated
    rows count once; rows of one id that differ are rows of their own, told apart
    by 64-bit hashes.  Other columns are not read; an empty table, or one without
    anchors, gives no rows.

    Both searches are matrix joins in blocks of at most ``block_numbers`` numbers:
    positives within a label, a large label in several blocks; negatives between
    blocks of anchors and of a length bucket, left out where the bucket's longest
    vector cannot reach the anchor's band.
    """
    if positives < 1 or negatives < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives must be 1 or more, and 0 <= low <= high")
    label = F.col(label) if isinstance(label, str) else label
    flat = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(label).alias("_label"), label.isNotNull().alias("_known"), F.coalesce(is_anchor, F.lit(False)).alias("_q"), F.col(vector_col).alias("_e"))
    rows = whole_vectors(flat.filter("_known and _id is not null"), F.col("_e"), "_w", None, scale, _LONGEST)
    rows = rows.select("_id", F.xxhash64("_label", "_w").alias("_same"), "_label", "_q", F.size("_w").alias("_dim"), "_w")
    dealt = lambda of, name: F.pmod(F.xxhash64("_id", "_same"), F.coalesce(of, F.lit(1)).cast("long")).alias(name)
    every = lambda of, name: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(of, F.lit(1)).cast("long") - 1)).alias(name)
    own = ["_id", "_same", "_label", "_dim", "_v", "_len"]

    with scratch(df.sparkSession) as keep:
        once = ["_id", "_same", "_dim", "_label"]
        coded = stored(rows.mapInArrow(_encode, _CODES).groupBy(*once).agg(F.bool_or("_q").alias("_q"), F.first("_v").alias("_v"), F.first("_len").alias("_len")))
        cores = df.sparkSession.sparkContext.defaultParallelism
        whole = coded.count()
        # blocks grow with the table up to their bound, so that few copies are made; small tables still spread
        rows_a_block = F.greatest(F.lit(1), F.least(F.lit(block_numbers) / F.greatest("_dim", F.lit(1)), F.lit(float(max(least_rows, whole // (4 * cores))))))
        blocks = lambda n: F.ceil(n / rows_a_block)

        # positives: blocks within a label; only labels of several blocks need to be told, fewer than there are blocks
        labels = coded.groupBy("_dim", "_label").agg(F.count("*").alias("n"), F.count_if("_q").alias("nq")).select("_dim", "_label", blocks(F.col("n")).alias("_cs"), blocks(F.col("nq")).alias("_qs"))
        large = _few(stored(labels.filter("_cs > 1 or _qs > 1")))
        parted = coded.join(large, ["_dim", "_label"], "left")
        left = parted.filter("_q").select(*own, dealt(F.col("_qs"), "_qb"), every(F.col("_cs"), "_cb"))
        right = parted.select(*own, dealt(F.col("_cs"), "_cb"), every(F.greatest("_qs", F.lit(1)), "_qb"))
        keys = ["_dim", "_label", "_qb", "_cb"]
        found = _tiles(left, right, keys).applyInArrow(_positives(positives), _POSITIVE)
        order = Window.partitionBy("anchor_id", "anchor_same").orderBy(F.desc("score"), "vec_id", "same")
        pairs = stored(found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n"))

        # negatives: anchors go to the length buckets that can reach their band
        bands = pairs.filter("score >= 0" if low < high else "true").groupBy(F.col("anchor_id").alias("_id"), F.col("anchor_same").alias("_same")).agg(F.collect_set("score").alias("_bands"))
        cuts = coded.agg(F.percentile_approx("_len", F.array(*[F.lit(i / 16) for i in range(1, 16)]), 1000)).first()[0] or []
        bucket = sum((F.when(F.col("_len") > F.lit(x), 1).otherwise(0) for x in sorted(set(cuts))), F.lit(0))
        anchors = stored(coded.filter("_q").join(bands, ["_id", "_same"]))
        sizes = coded.withColumn("_bucket", bucket).groupBy("_dim", "_bucket").agg(F.count("*").alias("n"), F.max("_len").alias("_top"))
        per_dim = anchors.groupBy("_dim").agg(F.count("*").alias("nq"))
        sizes = _few(stored(sizes.join(per_dim, "_dim").select("_dim", "_bucket", "_top", blocks(F.col("n")).alias("_cs"), blocks(F.col("nq")).alias("_qs"))))
        reach = F.col("_len") * F.col("_top") * (1 + 1e-9) + 1e-6 >= F.array_min("_bands") * (low / 100)
        left = anchors.join(sizes, "_dim").filter(reach).select(*own, "_bands", "_bucket", dealt(F.col("_qs"), "_qb"), every(F.col("_cs"), "_cb"))
        right = coded.withColumn("_bucket", bucket).join(sizes, ["_dim", "_bucket"]).select(*own, "_bucket", dealt(F.col("_cs"), "_cb"), every(F.col("_qs"), "_qb"))
        keys = ["_dim", "_bucket", "_qb", "_cb"]
        found = _tiles(left, right, keys).applyInArrow(_negatives(negatives, low, high), _NEGATIVE)
        order = Window.partitionBy("anchor_id", "anchor_same", "positive_score").orderBy(F.desc("score"), "vec_id", "same")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        wanted = pairs.select("anchor_id", "anchor_same", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = wanted.join(best, ["anchor_id", "anchor_same", "positive_score"])
        return keep(stored(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
