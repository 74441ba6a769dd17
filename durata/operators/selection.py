"""Choosing a hazard model: candidates judged on later rows, the winner refit and tested once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import _mark, marked
from ..sources.scratch import scratch, stored
from .boosting import Boosted
from .folded import Linear
from .hazard import evaluate
from .periods import features, person_periods
from .prepare import fingerprint, require_same

#: Person-periods with features, or whole rows, to a fitted model.
Fit = Callable[[DataFrame], PipelineModel | Linear | Boosted]


@dataclass
class Selection:
    """``scores`` has a row a model, part (validation; test for the winner alone), landmark and horizon."""

    winner: str
    model: PipelineModel | Linear | Boosted
    mean_brier: dict[str, float]
    scores: DataFrame


def select_model(
    train: DataFrame, validation: DataFrame, test: Callable[[], DataFrame], candidates: dict[str, Fit], key: str, landmarks: list[int], horizons: list[int], cap: int | None = None,
    whole: bool = False,
) -> Selection:
    """The candidate with the least mean Brier score on ``validation``, refit on both tables and scored on ``test()``.

    Each landmark and horizon counts the same; ties go to the smaller name.  All
    candidates are fit on one stored table of person-periods up to ``cap``; with
    ``whole``, on the stored rows themselves, whose days they work out (with a cap of
    their own, such as :func:`.hazard.fit_hazard` with ``of``).  ``test`` is a
    function so that its rows are not read before the winner stands; it is called once.
    A candidate whose score is unknown, because no row can be judged, cannot win.
    """
    if not candidates:
        raise ValueError("no candidates")
    if whole and cap is not None:
        raise ValueError("candidates on whole rows have a cap of their own")
    names = sorted(candidates)
    days = (lambda rows: rows) if whole else (lambda rows: stored(features(person_periods(rows, cap))))
    with scratch(train.sparkSession) as keep:
        train, validation = stored(train), stored(validation)  # both are read more than once
        periods = days(train)
        judged = {name: stored(evaluate(candidates[name](periods), validation, key, landmarks, horizons)) for name in names}
        means = {name: judged[name].agg(F.avg("brier")).first()[0] for name in names}
        known = {name: m for name, m in means.items() if m is not None}
        if not known:
            raise ValueError("validation has no row that can be judged")
        winner = min(known, key=lambda name: (known[name], name))
        model = candidates[winner](days(train.unionByName(validation)))
        final = evaluate(model, test(), key, landmarks, horizons)
        parts = [judged[name].select(F.lit(name).alias("model"), F.lit("validation").alias("part"), "*") for name in names]
        parts.append(final.select(F.lit(winner).alias("model"), F.lit("test").alias("part"), "*"))
        scores = keep(stored(reduce(DataFrame.unionByName, parts)))
    return Selection(winner, model, known, scores)


def save_model(model: PipelineModel, path: str, source: DataFrame) -> None:
    """Save a pipeline and, beside it, the fingerprint of the rows it was fit on.  Refuses to overwrite."""
    model.write().save(path)
    _mark(source.sparkSession, path, "input", fingerprint(source).first().asDict())


def load_model(path: str, source: DataFrame) -> PipelineModel:
    """The pipeline at ``path``, which must have been fit on the rows of ``source``."""
    require_same(fingerprint(source).first().asDict(), marked(source.sparkSession, path, "input"), f"the input of {path}")
    return PipelineModel.load(path)
