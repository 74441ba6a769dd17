"""The nearest rows of the same group: rows are dealt out in tiles of bounded size, requests to the tiles near them.

Cuts laid on a hash-chosen sample make the tiles; every row is placed by them and a
tile's box is that of all its rows, so the sample decides sizes and never results.
A request is first compared within its own tile, which bounds its k-th distance, and
then sent to the few tiles whose box is not beyond that.  Shuffled are rows, requests
and what is found, whatever the number of tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch, stored

_SAMPLED = 32  # rows of the sample a tile, about
_LEAF = 2  # rows of a leaf within a tile
_BLOCK = 256  # requests worked on at once


@dataclass
class _Boxes:
    """Nodes with the box of their rows; ``left`` is -1 at a leaf."""

    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


@dataclass
class _Cuts:
    """By group, cuts that halve it again and again; its leaves are the tiles."""

    root: dict[str, int] = field(default_factory=dict)
    dim: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)

    def lay(self, group: str, sample: np.ndarray) -> None:
        def node(rows: np.ndarray) -> int:
            at = len(self.left)
            for x, new in ((self.dim, 0), (self.cut, 0.0), (self.left, -1), (self.right, -1)):
                x.append(new)
            if len(rows) >= 2 * _SAMPLED:
                with np.errstate(invalid="ignore"):
                    wide = np.nan_to_num(rows.max(0) - rows.min(0), nan=0.0)
                for dim in np.argsort(-wide, kind="stable"):
                    values = np.sort(rows[:, dim])
                    middle = values[(len(values) - 1) // 2]
                    for cut in (middle, values[max(np.searchsorted(values, middle) - 1, 0)]):
                        low = rows[:, dim] <= cut
                        if len(rows) // 4 <= low.sum() <= len(rows) - len(rows) // 4:
                            self.dim[at], self.cut[at] = int(dim), float(cut)
                            self.left[at], self.right[at] = node(rows[low]), node(rows[~low])
                            return at
            return at

        self.root[group] = node(sample)

    def place(self, groups: pa.Array, u: np.ndarray) -> np.ndarray:
        """The tile of each row, -1 in groups without cuts."""
        codes = groups.dictionary_encode()
        at = np.array([self.root.get(g, -1) for g in codes.dictionary.to_pylist()], np.int64)[codes.indices.to_numpy()]
        dim, cut, left, right = (np.array(x) for x in (self.dim, self.cut, self.left, self.right))
        on = np.flatnonzero(at >= 0)
        while len(on := on[left[at[on]] >= 0]):
            low = u[on, dim[at[on]]] <= cut[at[on]]
            at[on] = np.where(low, left[at[on]], right[at[on]])
        return at

    def boxes(self, tiles: dict[int, tuple[np.ndarray, np.ndarray]], size: int) -> _Boxes:
        """The nodes' boxes from those of the tiles; a tile without rows is never near."""
        lo, hi = np.full((len(self.left), size), np.inf), np.full((len(self.left), size), -np.inf)
        for at in reversed(range(len(self.left))):  # what is within comes after
            if at in tiles:
                lo[at], hi[at] = tiles[at]
            elif self.left[at] >= 0:
                a, b = self.left[at], self.right[at]
                lo[at], hi[at] = np.minimum(lo[a], lo[b]), np.maximum(hi[a], hi[b])
        return _Boxes(lo, hi, np.array(self.left), np.array(self.right))


def _length(parts: np.ndarray) -> np.ndarray:
    """Added up column by column, as the SQL does."""
    total = parts[..., 0] * parts[..., 0]
    for i in range(1, parts.shape[-1]):
        total = total + parts[..., i] * parts[..., i]
    return np.sqrt(total)


def _gap(boxes: _Boxes, node: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least distance that a row of the node can have, no larger than any in doubles either; NaN where it is unknown."""
    return _length(np.maximum(np.maximum(boxes.lo[node] - u, u - boxes.hi[node]), 0.0))


def _reached(boxes: _Boxes, u: np.ndarray, bound: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a request and a leaf below its start that is not beyond its bound, and their gap."""
    who, node, found = np.arange(len(u)), start, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    while len(who):
        gap = _gap(boxes, node, u[who])
        near = ~(gap > bound[who])
        who, node, gap = who[near], node[near], gap[near]
        leaf = boxes.left[node] < 0
        found.append((who[leaf], node[leaf], gap[leaf]))
        who, node = who[~leaf], node[~leaf]
        who, node = np.repeat(who, 2), np.column_stack([boxes.left[node], boxes.right[node]]).ravel()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _halved(rows: np.ndarray) -> tuple[_Boxes, np.ndarray]:
    """The rows in halves down to leaves of a few: boxes, and a line of positions a leaf (from ``len(rows)`` on they fill up and are no rows)."""
    depth = max(0, int(np.ceil(np.log2(len(rows) / _LEAF))))
    order = np.arange(-(-len(rows) // (1 << depth)) << depth)[None, :]
    lo, hi = [], []
    for level in range(depth + 1):
        v = rows[order % len(rows)]
        lo.append(v.min(1))
        hi.append(v.max(1))
        if level < depth:
            dim = np.nan_to_num(hi[-1] - lo[-1], nan=0.0).argmax(1)
            half = order.shape[1] // 2
            cut = np.argpartition(np.take_along_axis(v, dim[:, None, None], 2)[:, :, 0], half, axis=1)
            order = np.take_along_axis(order, cut, 1).reshape(-1, half)
    inner = np.arange((1 << depth) - 1)
    ends = np.full(1 << depth, -1)
    return _Boxes(np.concatenate(lo), np.concatenate(hi), np.concatenate([2 * inner + 1, ends]), np.concatenate([2 * inner + 2, ends])), order


def _nearest(rows: np.ndarray, u: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Request, row and distance of each request's first k rows within its bound (ties: earlier rows), and how many rows each met."""
    found, met = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], np.zeros(len(u), np.int64)
    if len(rows) and len(u):
        with np.errstate(invalid="ignore", over="ignore"):
            boxes, order = _halved(rows)
            for first in range(0, len(u), _BLOCK):
                some = slice(first, first + _BLOCK)
                who, row, distance, met[some] = _within(rows, boxes, order, u[some], bound[some], k)
                found.append((who + first, row, distance))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), met


def _within(rows: np.ndarray, boxes: _Boxes, order: np.ndarray, u: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    level = max(0, int(np.log2(max(order.size / (8 * k), 1))))
    node = np.zeros(len(u), np.int64)
    for _ in range(min(level, int(np.log2(len(order))))):  # the nearer half, down to 8 k rows or more: a wide block bounds better
        a, b = boxes.left[node], boxes.right[node]
        node = np.where(_gap(boxes, b, u) < _gap(boxes, a, u), b, a)
    level = int(np.log2(node[0] + 1))
    near = order.reshape(1 << level, -1)[node + 1 - (1 << level)]
    if near.shape[1] >= k:  # k rows surely lie within it
        distance = _length(u[:, None, :] - rows[near % len(rows)])
        distance[(near >= len(rows)) | np.isnan(distance)] = np.inf
        bound = np.minimum(bound, np.partition(distance, k - 1, axis=1)[:, k - 1])
    who, leaf, gap = _reached(boxes, u, bound, np.zeros(len(u), np.int64))
    by = np.lexsort((gap, who))
    who, leaf, gap = who[by], leaf[by], gap[by]
    place, least, met = _place_in(who) * order.shape[1], 2 * k, np.zeros(len(u), np.int64)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    while len(who):  # the nearest leaves tell which of the others are opened
        now = place < least
        more = _rows_of(rows, order, u, who[now], leaf[now])
        met += np.bincount(more[0], minlength=len(u))
        found = _first(*(np.concatenate(x) for x in zip(found, more, strict=True)), k)
        bound = np.fmin(bound, _kth(found[0], found[2], len(u), k))
        rest = ~now & ~(gap > bound[who])
        who, leaf, gap, place, least = who[rest], leaf[rest], gap[rest], place[rest], 2 * least
    kept = ~(found[2] > bound[found[0]])
    return *(x[kept] for x in found), met


def _place_in(who: np.ndarray) -> np.ndarray:
    """The place of each among its equals; ``who`` is in order."""
    return np.arange(len(who)) - np.searchsorted(who, who)


def _rows_of(rows: np.ndarray, order: np.ndarray, u: np.ndarray, who: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = order[leaf + 1 - len(order)].ravel()
    who = np.repeat(who, order.shape[1])[row < len(rows)]
    row = row[row < len(rows)]
    return who, row, _length(u[who] - rows[row])


def _first(who: np.ndarray, row: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((row, distance, who))
    by = by[_place_in(who[by]) < k]
    return who[by], row[by], distance[by]


def _kth(who: np.ndarray, distance: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th distance of each of ``n`` requests, in order by both; infinite where there are fewer or it is NaN."""
    out, last = np.full(n, np.inf), _place_in(who) == k - 1
    out[who[last]] = np.nan_to_num(distance[last], nan=np.inf, posinf=np.inf)
    return out


def _matrix(table: pa.Table | pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in names]) if table.num_rows else np.zeros((0, len(names)))


def _placed(df: DataFrame, cuts: _Cuts, u: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = cuts.place(batch.column("_g"), _matrix(batch, u))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile, pa.int64())], names=[*batch.schema.names, "_tile"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_tile", T.LongType())]))


def _met(asked: DataFrame, points: DataFrame, most: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """Requests and rows by tile; where a tile has more than ``most`` requests, they are dealt to copies of it."""
    tile = ["_g", "_tile"]
    crowded = F.broadcast(asked.groupBy(*tile).agg(F.count("*").alias("_m")).filter(F.col("_m") > most).select(*tile, F.ceil(F.col("_m") / most).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = asked.join(crowded, tile, "left").withColumn("_part", F.pmod(F.xxhash64("q"), parts).cast("int")).drop("_parts")
    copies = points.join(crowded, tile, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.groupBy(*tile, "_part").cogroup(copies.groupBy(*tile, "_part")).applyInArrow(run, schema)


def near_rows(points: DataFrame, asked: DataFrame, u: list[str], k: int, carry: list[str] = (), tile: int = 1 << 14) -> DataFrame:
    """``(q, n, distance, compared, carry..)``: the first ``k`` of ``points`` (``_g``, ``n``, ``u..``, ``carry..``) in each request's group (``asked``: ``_g``, ``q``, ``u..``).

    The distance is Euclidean over the columns ``u``, doubles without nulls; ties go
    to the smaller ``n``.  ``compared`` tells how many rows a request met in the last
    search, with its bound known.  Of points that are equal in ``u``, ``k`` are kept
    at most, those of the smallest ``n``.  A tile has about ``tile`` to twice as many rows.
    The result is a stored table.
    """
    size, carry = len(u), list(carry)
    with scratch(points.sparkSession) as keep:
        cuts = _Cuts()
        if points.count() > 2 * tile:
            sample = points.filter(F.pmod(F.xxhash64("n", F.lit("cut")), F.lit(max(1, tile // _SAMPLED))) == 0).select("_g", *u).distinct().toArrow()  # a fixed share, only to lay cuts
            sample = sample.sort_by([(c, "ascending") for c in ["_g", *u]])
            for g in pc.unique(sample.column("_g")).to_pylist():
                cuts.lay(g, _matrix(sample.filter(pc.equal(sample.column("_g"), g)), u))
        first = Window.partitionBy("_g", *u).orderBy("n")
        points = stored(_placed(points.withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= k).drop("_no"), cuts, u))
        asked = stored(_placed(asked.select("_g", "q", *u), cuts, u))
        sent = T.StructType([*asked.schema.fields, T.StructField("_bound", T.DoubleType())])
        cut_groups = [g for g, at in cuts.root.items() if cuts.left[at] >= 0]
        ready = asked.withColumn("_bound", F.lit(float("inf")))
        if cut_groups:
            ends = [f(c).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i, c in enumerate(u)]
            tiles = {r["_tile"]: (np.array(r[2 : 2 + size]), np.array(r[2 + size :])) for r in points.filter("_tile >= 0").groupBy("_g", "_tile").agg(*ends).collect()}
            boxes = cuts.boxes(tiles, size)

            def to_tiles(requests: pa.Table, rows: pa.Table) -> pa.Table:
                own = _matrix(requests, u)
                who, _, distance, _ = _nearest(_matrix(rows, u), own, np.full(len(own), np.inf), k)
                bound = _kth(who, distance, len(own), k)
                groups = requests.column("_g").to_pylist()
                with np.errstate(invalid="ignore", over="ignore"):
                    who, to, _ = _reached(boxes, own, bound, np.full(len(own), cuts.root[groups[0]] if groups else 0))
                sent_on = requests.select(["_g", "q", *u]).take(pa.array(who))
                return pa.table([*sent_on.columns, pa.array(to, pa.int64()), pa.array(bound[who])], names=["_g", "q", *u, "_tile", "_bound"])

            several = F.col("_g").isin(cut_groups)
            home = _met(asked.filter(several), points.filter(several).select("_g", "_tile", *u), 4 * tile, to_tiles, sent)
            ready = stored(home.unionByName(ready.filter(~several)))

        def search(requests: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows.column("n")))
            who, row, distance, met = _nearest(_matrix(rows, u), _matrix(requests, u), requests.column("_bound").to_numpy(), k)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(met)))]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(distance), *[rows.column(c).take(pa.array(row)).combine_chunks() for c in ["n", *carry]])]
            return pa.table([requests.column("q"), pa.array(met), *lists], names=["q", "_met", "distance", "n", *carry])

        types = {f.name: f.dataType for f in points.schema.fields}
        lists = [T.StructField("distance", T.ArrayType(T.DoubleType())), *[T.StructField(c, T.ArrayType(types[c])) for c in ["n", *carry]]]
        found = _met(ready, points, 4 * tile, search, T.StructType([asked.schema["q"], T.StructField("_met", T.LongType()), *lists]))
        each = found.repartition("q").select("q", "_met", F.posexplode_outer(F.arrays_zip("distance", "n", *carry)).alias("_pos", "_x"))
        each = each.select("q", "_pos", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_met")).alias("_met"), "_x.*")
        order = Window.partitionBy("q").orderBy(F.col("_pos").isNull(), "distance", "n")
        best = each.withColumns({"_r": F.row_number().over(order), "compared": F.sum("_met").over(Window.partitionBy("q"))}).filter((F.col("_r") <= k) & F.col("_pos").isNotNull())
        return keep(stored(best.select("q", "n", "distance", "compared", *carry)))
