"""Substring dedup: remove words covered by word windows that occur more than once.

Method: recompression (see :mod:`.recompression`).  Rounds of run and pair naming
give equal word sequences equal interior symbols, so each window has an anchor,
a short run of high-level symbols, that is the same wherever the window occurs.

1. Spark counts anchor keys over the whole corpus.  An anchor that occurs once
   certifies that none of its windows (ten or so) is repeated; that ends the
   work for unique text, for about one small row in ten words.
2. Among shared anchors, the *unit* (all words of all the anchor's windows) is
   compared: where units are equal, all their windows are repeated.
3. What is left, single units and one representative of each repeated unit under
   an anchor that has different units, is compared window by window.

Equal units of a block (some thousand documents) are one row with a count, and
each step counts before it joins, so a passage that a third of all documents
share is one row a block before the shuffle, and joins have a unique side, which
lets AQE split hot keys.  No group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import anchors
from .tables import hot_join, hot_keys, scratch, stored
from .wordhash import Words, mix, powers, rolling, slices

_BASE = np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    part = TaskContext.get().partitionId() << 32
    for k, piece in enumerate(slices(batches, text, block_bytes)):
        yield part | k, piece


class _Units:
    """Windows of a block grouped by anchor: ``first[i] .. first[i + 1]`` are unit i's windows."""

    def __init__(self, words: Words, width: int):
        self.start, key, at = anchors(words.hash, words.offsets, width)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (key[1:] != key[:-1])  # keys of different rounds may lie at one place
        heads = np.flatnonzero(new)
        self.first = np.append(heads, len(at))
        self.key = key[heads]
        a, b = self.start[heads], self.start[self.first[1:] - 1] + width
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(words.hash) * powers(len(words.hash), _BASE), dtype=np.uint64)])
        whole = (total[b] - total[a]) * powers(len(words.hash) + 1, _INVERSE)[a]
        self.unit = mix(whole + mix((b - a).astype(np.uint64) * np.uint64(1 << 20) + (at[heads] - a).astype(np.uint64)))
        self.same = mix(self.unit + self.key)  # equal for equal units


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``df``: ``(id_col, n_words, n_removed, kept_text, removed)``.

    A word is removed if it lies in a window of ``width`` consecutive words of its
    text whose sequence also starts anywhere else in ``df``, the same text
    included.  ``kept_text`` joins the kept words by one space, ``removed`` lists
    the removed word ranges ``(start, end)``, end exclusive.

    Null and empty texts have no words: 0, 0, '' and no range.  Texts of fewer
    than ``width`` words are kept whole.  Repeated rows are texts like any other:
    all their copies lose what they share.  Null or repeated ids are carried
    along; other columns are not read.  An empty table gives an empty result.
    Windows are compared by 64-bit fingerprints under 64-bit anchor keys, which
    equal windows share: two windows count as equal if both agree.

    ``df`` is read once: its blocks are stored, so that a block's number is data
    and no property of the scan.  The result reads two stored tables; what else
    was stored on the way is deleted.
    """
    if width < 2:
        raise ValueError("width must be 2 or more")
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, piece in _blocks(batches, "_text", block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_pack(piece)], pa.binary())], names=["block", "payload"])

    def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                u = _Units(Words(_unpack(payload.as_py()).column("_text")), width)
                _, i, m = np.unique(u.same, return_index=True, return_counts=True)  # a long run of one word is one row
                yield pa.RecordBatch.from_arrays([pa.array(_signed(u.key[i])), pa.array(_signed(u.unit[i])), pa.array(np.full(len(i), block)), pa.array(i.astype(np.int32)), pa.array(m.astype(np.int32))], names=["key", "unit", "block", "i", "m"])

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, marks in zip(*(batch.column(c) for c in ("block", "payload", "marks")), strict=True):
                words = Words(_unpack(payload.as_py()).column("_text"))
                u, fingerprints = _Units(words, width), rolling(words.hash, width)
                i, kind = _marks(marks)
                size = u.first[i + 1] - u.first[i]
                owner = np.repeat(np.arange(len(i)), size)
                w = u.start[u.first[i][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(u.key[i][owner])), pa.array(_signed(fingerprints[w])), pa.array(np.full(len(w), block.as_py())), pa.array(np.where(kind[owner] == 1, w, -1 - w).astype(np.int32))],
                    names=["key", "window", "block", "p"],
                )

    listed = lambda rows: rows.groupBy("block").agg(F.collect_list(F.struct("i", "kind")).alias("marks"))  # noqa: E731  bounded by a block
    with scratch(df.sparkSession) as keep:
        blocks = keep(stored(docs.mapInArrow(packed, "block long, payload binary"), "none"))  # payloads are compressed already
        with scratch(df.sparkSession) as keep_shared:
            units = stored(blocks.mapInArrow(unit_rows, "key long, unit long, block long, i int, m int"), "lz4")
            twice = stored(units.groupBy("key").agg(F.sum("m").alias("n"), F.count("*").alias("rows")).filter("n > 1"))
            shared = keep_shared(stored(hot_join(units, twice.select("key"), ["key"], hot_keys(twice, ["key"], "rows"))))
        kinds = stored(shared.groupBy("key", "unit").agg(F.sum("m").alias("n"), F.count("*").alias("rows"), F.min(F.struct("block", "i")).alias("at")))
        repeated = kinds.filter("n > 1").select("key", "unit")
        equal = hot_join(shared, repeated, ["key", "unit"], hot_keys(kinds, ["key", "unit"], "rows")).select("block", "i", F.lit(0).cast("byte").alias("kind"))
        per_key = stored(kinds.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"))
        # kind 1: a single unit, whose windows are asked for; 2: the representative of a repeated one, which is only compared with
        several = hot_join(kinds.select("key", "n", "at"), per_key.select("key"), ["key"], hot_keys(per_key, ["key"], "rows"))
        open_units = several.select("at.block", "at.i", F.when(F.col("n") > 1, 2).otherwise(1).cast("byte").alias("kind"))
        windows = stored(blocks.join(listed(open_units), "block").mapInArrow(window_rows, "key long, window long, block long, p int"))
        again = stored(windows.groupBy("key", "window").agg(F.count("*").alias("n")).filter("n > 1"))
        single = hot_join(windows.filter("p >= 0"), again.drop("n"), ["key", "window"], hot_keys(again, ["key", "window"], "n"))
        found = keep(stored(listed(equal.unionByName(single.select("block", F.col("p").alias("i"), F.lit(1).cast("byte").alias("kind"))))))

    kind_of = df.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, marks in zip(batch.column("payload"), batch.column("marks"), strict=True):
                yield _cut(_unpack(payload.as_py()), marks, width)

    out = blocks.join(found, "block", "left").mapInArrow(cut, f"_id {kind_of}, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>")
    return out.withColumnRenamed("_id", id_col)


def _pack(piece: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, piece.schema) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in piece.columns], schema=piece.schema))
    return zstandard.compress(sink.getvalue(), 3)


def _unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.decompress(payload)).read_next_batch()


def _marks(marks: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    if not marks.is_valid:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int8)
    return marks.values.field("i").to_numpy().astype(np.int64), marks.values.field("kind").to_numpy()


def _cut(piece: pa.RecordBatch, marks: pa.ListScalar, width: int) -> pa.RecordBatch:
    words = Words(piece.column("_text"))
    n = len(words.hash)
    i, kind = _marks(marks)
    change = np.zeros(n + 1, dtype=np.int64)
    if len(i):
        whole = i[kind == 0]
        u = _Units(words, width) if len(whole) else None
        whole = np.flatnonzero(np.isin(u.same, u.same[whole])) if u else whole
        a = np.concatenate([i[kind == 1], u.start[u.first[whole]] if u else i[:0]])
        b = np.concatenate([i[kind == 1], u.start[u.first[whole + 1] - 1] if u else i[:0]]) + width
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    gone = np.cumsum(change)[:n] > 0
    edge = np.diff(gone.astype(np.int8), prepend=np.int8(0))
    edge[words.offsets[:-1][words.offsets[:-1] < n]] = np.where(gone[words.offsets[:-1][words.offsets[:-1] < n]], 1, 0)
    starts = np.flatnonzero(edge == 1)
    stops = np.zeros(n + 1, dtype=bool)
    stops[:n] = ~gone
    stops[words.offsets] = True
    stop_at = np.flatnonzero(stops)
    ends = stop_at[np.searchsorted(stop_at, starts, side="right")] if len(starts) else starts
    owner = np.searchsorted(words.offsets, starts, side="right") - 1
    base = words.offsets[owner]
    lists = np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], names=["start", "end"])
    removed_before = np.concatenate([[0], np.cumsum(gone)])
    # kept words that follow each other at one blank are copied as one run of bytes
    data, own = words.data, np.flatnonzero(~gone)
    docs = np.searchsorted(words.offsets, own, side="right")
    head = np.ones(len(own) + 1, dtype=bool)
    if len(own):
        blank = np.frombuffer(data, dtype=np.uint8)[words.last[own[:-1]]] == 0x20
        head[1:-1] = (np.diff(own) > 1) | (docs[1:] != docs[:-1]) | (words.first[own[1:]] != words.last[own[:-1]] + 1) | ~blank
    heads = np.flatnonzero(head)
    runs = [data[x:y] for x, y in zip(words.first[own[heads[:-1]]].tolist(), words.last[own[heads[1:] - 1]].tolist(), strict=True)] if len(own) else []
    bounds = np.searchsorted(own[heads[:-1]] if len(own) else own, words.offsets).tolist()
    kept = [b" ".join(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    text = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [piece.column("_id"), pa.array(np.diff(words.offsets).astype(np.int64)), pa.array(np.diff(removed_before[words.offsets])), text, pa.ListArray.from_arrays(pa.array(lists), spans)],
        names=["_id", "n_words", "n_removed", "kept_text", "removed"],
    )
