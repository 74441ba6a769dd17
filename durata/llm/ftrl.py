"""Logistic regression by FTRL-proximal over hashed features, and its use on whole texts.

Training takes a bounded sample of labelled rows (a parameter) in one task;
scoring is a sparse dot product in every task.  L1 keeps the weights few, so they
travel with the scoring function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import scratch, stored
from .wordhash import slices

#: Texts to (feature hashes, index of each feature's text); a feature counts once a text.
Featurizer = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


#: The bias without any labelled row: nothing speaks for label 1.
UNTRAINED = -3.0


def _passes(places: list[np.ndarray], labels: np.ndarray, n_features: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, balance: np.ndarray) -> np.ndarray:
    z, n = np.zeros(n_features + 1), np.zeros(n_features + 1)  # the bias comes last, without L1
    sparse = np.append(np.full(n_features, l1), 0.0)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= sparse[i], 0.0, (np.sign(zi) * sparse[i] - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, y, b in zip(places, labels, balance, strict=True):
            w = weights(i)
            g = b * (1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None))


def fit(features: list[np.ndarray], labels: np.ndarray, epochs: int = 5, alpha: float = 3.0, beta: float = 1.0, l1: float = 10.0, l2: float = 1.0, min_docs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, weights, bias).  Each coordinate has its own rate ``alpha / (beta + sqrt(sum of squared gradients))``.

    Features of fewer than ``min_docs`` texts are left out: a text or two cannot
    show that they tell the classes apart.  Classes weigh the same in sum, however
    rare one is.  A sample of one class (or none) gives no weights and a bias for
    that class's share.
    """
    known, count = np.unique(np.concatenate([*features, np.zeros(0, np.uint64)]), return_counts=True)
    known = known[count >= min_docs]
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if len(labels) == 0 or labels.min() == labels.max():
        return known[:0], np.zeros(0), float(np.log(share / (1 - share)))
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    places = []
    for f in features:
        at = np.searchsorted(known, f)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == f[hit]
        places.append(np.append(at[hit], len(known)))
    w = _passes(places, labels, len(known), epochs, alpha, beta, l1, l2, balance)
    kept = np.flatnonzero(w[:-1])
    return known[kept], w[kept], float(w[-1])


class Scorer:
    """Sparse dot products with few weights: a bit table passes the few features that may have one."""

    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float, bits: int = 22):
        order = np.argsort(known)
        self.known, self.weights, self.bias, self.mask = known[order], weights[order], bias, np.uint64((1 << bits) - 1)
        self.table: np.ndarray | None = None

    def __call__(self, features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        margin = np.full(n, self.bias)
        if len(self.known):
            if self.table is None:
                self.table = np.zeros(int(self.mask) + 1, dtype=bool)
                self.table[self.known & self.mask] = True
            may = np.flatnonzero(self.table[features & self.mask])
            f, own = features[may], owner[may]
            at = np.minimum(np.searchsorted(self.known, f), len(self.known) - 1)
            hit = self.known[at] == f
            pairs = np.unique(np.stack([own[hit], at[hit]]), axis=1)
            np.add.at(margin, pairs[0], self.weights[pairs[1]])
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether ``crc32(id as text) mod folds`` is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def train(
    docs: DataFrame, labels: DataFrame, featurize: Featurizer, id_col: str, text_col: str, label_col: str, usable: Column, most_rows: int, most_bytes: int, **options: float
) -> Scorer:
    """Fit on at most ``most_rows`` labelled texts of ``most_bytes`` bytes in all, chosen by a hash of their ids among the ``usable`` ones.

    Ids are chosen from the label table alone; that list is bounded, so it is
    broadcast and the texts of other rows never move.  Of an id with several rows
    one text is taken.  Texts are added in the order of the hash; one that would
    take their sum beyond ``most_bytes`` is passed over and the next one tried, so
    the one task that fits has a bounded input, however long texts are.  Null labels
    and ids are not used; an id labelled twice counts with its larger label.
    Without any row the scorer takes label 0 for likelier.
    """
    chosen = labels.filter(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(chosen), "_id")

    def learn(table: pa.Table) -> pa.Table:
        # the order is that of a hash of the ids: free of the labels' and the files' order, the same in every run
        ids = table.column("_id").to_numpy().astype(np.uint64)
        order = np.lexsort((ids, (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        table = table.take(pa.array(order))
        features: list[np.ndarray] = []
        for piece in slices(table.combine_chunks().to_batches(), "_text"):
            f, own = featurize(piece.column("_text"))
            by = np.argsort(own, kind="stable")
            f, cuts = f[by], np.searchsorted(own[by], np.arange(piece.num_rows + 1))
            features += [np.unique(f[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        known, w, bias = fit(features, table.column("_y").to_numpy().astype(np.float64), **options)
        return pa.table({"f": pa.array(np.append(known.view(np.int64), 0)), "w": pa.array(np.append(w, bias)), "bias": pa.array(np.arange(len(w) + 1) == len(w))})

    with scratch(docs.sparkSession):
        sample = stored(rows.groupBy("_id", "_y").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"))).alias("x")).select("_id", "_y", F.col("x.text").alias("_text")))
        room, fits = most_bytes, []
        for r in sample.select("_id", F.octet_length("_text").alias("b")).orderBy(F.xxhash64("_id"), "_id").collect():  # most_rows at most
            if r.b <= room:
                room -= r.b
                fits.append((r["_id"],))
        chosen = docs.sparkSession.createDataFrame(fits, sample.select("_id").schema)
        group = sample.join(F.broadcast(chosen), "_id").withColumn("_all", F.lit(0)).groupBy("_all")
        rows = group.applyInArrow(learn, "f long, w double, bias boolean").toArrow()  # bounded by the sample
    f, w, b = (rows.column(c).to_numpy() for c in ("f", "w", "bias"))
    return Scorer(f[~b].view(np.uint64).copy(), w[~b].copy(), float(w[b][0]) if b.any() else UNTRAINED)


def score(docs: DataFrame, scorer: Scorer, featurize: Featurizer, text_col: str, score_col: str = "_score", slice_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with ``score_col``, between 0 and 1; null and empty texts get the score of no features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, slice_bytes):
            f, own = featurize(piece.column(text_col))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(scorer(f, own, piece.num_rows))], names=[*piece.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
