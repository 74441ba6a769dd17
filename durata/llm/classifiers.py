"""Toxicity and quality of whole texts: two feature sets over one FTRL learner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ftrl import Scorer, score, train
from .tables import unused
from .wordhash import Words, mix

_N = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _together(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix(a * _N[0] + mix(b + _N[kind]))


def word_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, word pairs, and skip-grams over one and two words.

    Words are runs of ASCII letters and digits and of all other letters; ASCII
    punctuation parts them.
    """
    words = Words(texts, lower=True, plain=True)
    h, own = words.hash, words.doc_of_word()
    values, owners = [h], [own]
    for gap in (1, 2, 3):
        same = own[gap:] == own[:-gap]
        values.append(_together(h[:-gap][same], h[gap:][same], gap))
        owners.append(own[gap:][same])
    return np.concatenate(values), np.concatenate(owners)


def quality_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams (1 to 3); words are as they stand, case and punctuation included."""
    words = Words(texts)
    h, own = words.hash, words.doc_of_word()
    if not len(h):
        return h, own
    two, three = own[1:] == own[:-1], own[2:] == own[:-2]
    twos = _together(h[:-1], h[1:], 1)
    grams = [h, twos[two], _together(twos[:-1], h[2:], 2)[three]]
    return np.concatenate(grams), np.concatenate([own, own[1:][two], own[2:][three]])


FEATURES = {"toxic": word_ngrams, "quality": quality_ngrams}
OPTIONS = {"toxic": {"l1": 10.0, "alpha": 3.0}, "quality": {"l1": 0.6, "alpha": 0.2, "min_docs": 3}}


def classifier(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8000, most_bytes: int = 64 << 20) -> Scorer:
    """A scorer for ``label_col`` (``toxic`` or ``quality``), fit on at most ``most_rows`` ``usable`` rows of ``labels``, of ``most_bytes`` bytes of text in all.

    Columns of ``docs`` and ``labels`` but for the named ones are not read.  Without
    labelled rows the scorer has no weights and scores every text below 0.5; with
    one label alone it has none either and gives the labels' smoothed share.
    """
    return train(docs, labels, FEATURES[label_col], id_col, text_col, label_col, usable, most_rows, most_bytes, **OPTIONS[label_col])


def scored(docs: DataFrame, scorer: Scorer, label_col: str, text_col: str = "text", score_col: str = "_score", predicted_col: str = "_predicted") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher: label 1 likelier) and ``predicted_col`` (1 from 0.5 on).

    Whole texts are scored; null and empty texts, which have no features, get the
    bias's score.  Rows are independent of each other, so repeated rows get equal
    scores, and an empty table stays empty.  Other columns pass through; an added
    name that exists already gets underscores more (see :func:`.tables.unused`).
    """
    score_col = unused(score_col, docs.columns)
    predicted_col = unused(predicted_col, [*docs.columns, score_col])
    out = score(docs, scorer, FEATURES[label_col], text_col, score_col)
    return out.withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))
