"""Ranking within sets: halves, ties, AUC, and gaps between groups, all as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import hash_uniform
from ..sources.scratch import scratch, small, stored
from .ordered import running
from .quantiles import values_at
from .stats import meet


def set_rows(df: DataFrame, scenarios: dict[str, list[str]]) -> DataFrame:
    """Rows once per scenario with ``scenario`` and ``set_id``, its key columns joined; no keys: one set per snapshot."""
    ids = [F.struct(F.lit(k).alias("scenario"), F.concat_ws("|", "snapshot", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in cols]).alias("set_id")) for k, cols in scenarios.items()]
    return df.select("*", F.inline(F.array(*ids)))


def complete_sets(df: DataFrame, keys: list[str], scores: list[str], least: int = 3) -> DataFrame:
    """Only sets of ``least`` rows or more in which every score of every row is known."""
    w = Window.partitionBy(*keys)
    known = F.lit(True)
    for s in scores:
        known = known & F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    return df.withColumns({"_n": F.count("*").over(w), "_ok": F.bool_and(known).over(w)}).filter((F.col("_n") >= least) & F.col("_ok")).drop("_n", "_ok")


def auc(df: DataFrame, keys: list[str], score: str, target: str, weight: str | None = None) -> DataFrame:
    """``(keys.., pos, neg, auc)``: area under the ROC curve, ties at half; null with one class.

    Scores shrink to distinct values with class sums first, so what is ordered are
    distinct scores, whatever the number of rows; without keys, in ranges.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    cells = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(w * F.col(target)).alias("_p"), F.sum(w * (1 - F.col(target))).alias("_q"))
    if keys:
        over = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_below", F.coalesce(F.sum("_q").over(over), F.lit(0)))
    else:
        cells = running(cells, "_s", {"_below": "_q"})
    out = cells.groupBy(*keys).agg(F.sum("_p").alias("pos"), F.sum("_q").alias("neg"), F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2.0)).alias("_u"))
    return out.select(*keys, "pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("_u") / (F.col("pos") * F.col("neg"))).alias("auc"))


def priority(df: DataFrame, keys: list[str], score: str, order: str = "id") -> DataFrame:
    """``rank``, and ``half``: high for the first ceil(n / 2), 'tied' where the score at the boundary is on both sides."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"rank": F.row_number().over(w.orderBy(F.desc(score), order)), "_half": F.ceil(F.count("*").over(w) / 2)})
    last = F.max(F.when(F.col("rank") == F.col("_half"), F.col(score))).over(w)
    following = F.max(F.when(F.col("rank") == F.col("_half") + 1, F.col(score))).over(w)
    rows = rows.withColumns({"_last": last, "_next": following})
    tied = (F.abs(F.col("_last") - F.col("_next")) <= 1e-12) & (F.abs(F.col(score) - F.col("_last")) <= 1e-12)
    return rows.withColumn("half", F.when(tied, "tied").when(F.col("rank") <= F.col("_half"), "high").otherwise("low")).drop("_half", "_last", "_next")


def set_metrics(df: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """Per set: n, ended, rate of the rows with the highest score, base rate, AUC, pairs and score span."""
    rows = df.withColumn("_top", F.max(score).over(Window.partitionBy(*keys)))
    own = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(target).alias("ended"), F.avg(F.when(F.abs(F.col(score) - F.col("_top")) <= 1e-12, F.col(target))).alias("top_rate"),
        F.avg(target).alias("base_rate"), (F.max(score) - F.min(score)).alias("span"),
    )
    return own.join(auc(df, keys, score, target), keys).withColumn("pairs", F.col("pos") * F.col("neg")).drop("pos", "neg")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    total = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))
    return known.groupBy(*keys).agg(total.alias("value"), F.count("*").alias("sets")) if keys else known.agg(total.alias("value"), F.count("*").alias("sets"))


def half_gap(df: DataFrame, keys: list[str], score: str, target: str, order: str = "id") -> DataFrame:
    """Rate of the top half minus that of the bottom half, weighted by set size; odd sets leave the middle row out."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(score), order)), "_n": F.count("*").over(w)})
    k = F.floor(F.col("_n") / 2)
    sets = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_r") <= k, F.col(target))).alias("hi"), F.avg(F.when(F.col("_r") > F.col("_n") - k, F.col(target))).alias("lo"))
    return sets.filter("n >= 2").agg(F.count("*").alias("sets"), (F.sum((F.col("hi") - F.col("lo")) * F.col("n")) / F.sum("n")).alias("gap"))


def label_gap(df: DataFrame, keys: list[str], high: str, target: str, least: int = 3, weighting: str = "size", score: str | None = None, spread: float = 0.0) -> DataFrame:
    """High-minus-low rate within sets that have both labels, weighted by size or by the smaller side.

    With ``score``, sets whose scores span ``spread`` or more and the others are
    told apart by a column ``wide``.
    """
    if weighting not in ("size", "smaller"):
        raise ValueError("weighting must be size or smaller")
    h, y = F.col(high), F.col(target)
    wide = F.lit(True) if score is None else F.coalesce(F.max(score) - F.min(score) >= spread, F.lit(False))
    sets = df.groupBy(*keys).agg(wide.alias("wide"), F.count("*").alias("n"), F.sum(h).alias("n_hi"), F.sum(h * y).alias("y_hi"), F.sum((1 - h) * y).alias("y_lo"))
    sets = sets.withColumn("n_lo", F.col("n") - F.col("n_hi")).filter((F.col("n") >= least) & (F.col("n_hi") > 0) & (F.col("n_lo") > 0))
    w = F.col("n") if weighting == "size" else F.least("n_hi", "n_lo")
    gap = F.col("y_hi") / F.col("n_hi") - F.col("y_lo") / F.col("n_lo")
    sums = [F.count("*").alias("sets"), F.sum("n").alias("rows"), (F.sum(gap * w) / F.sum(w)).alias("gap")]
    return sets.agg(*sums) if score is None else sets.groupBy("wide").agg(*sums)


def same_share(df: DataFrame, keys: list[str], score: str, share: float, seed: int = 1, key: str = "row_id", few: int = 2_000_000, blocks: int = 4096) -> DataFrame:
    """``chosen``: the top round(share * n) rows by score, ties in hash order; rounding half to even.

    The score at the cut comes from rank selection (:func:`.quantiles.values_at`),
    so no group is sorted.  Rows at that score are told apart by ``blocks`` ranges
    of their hash, and only those of the block in which the share ends are ranked.
    Null scores come last, as minus infinity does; NaN comes first.
    """
    k = lambda n: F.bround(F.lit(share) * n).cast("long")
    v = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    uniform = hash_uniform(F.lit(seed), F.col(key))
    rows = df.withColumn("_v", v)
    n = F.col("n")
    with scratch(df.sparkSession) as keep:
        at = values_at(rows, "_v", F.when(k(n) > 0, F.array(n - k(n))).otherwise(F.array().cast("array<bigint>")), keys, few=few)
        cuts = stored(at.select(*keys, k(n).alias("_k"), F.element_at("at", n - k(n)).alias("_cut")))
        # what lies above the cut is block -1; a group has `blocks` rows more at most
        placed = meet(rows, small(cuts), keys).withColumn("_b", F.when(F.col("_v") > F.col("_cut"), -1).when(F.col("_v") == F.col("_cut"), F.floor(uniform * blocks).cast("int"))).filter("_b is not null")
        sizes = placed.groupBy(*keys, "_k", "_cut", "_b").agg(F.count("*").alias("_n"))
        over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        sizes = sizes.withColumn("_room", F.col("_k") - F.sum("_n").over(over) + F.col("_n"))
        part = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
        ends = keep(stored(sizes.groupBy(*keys, "_cut").agg(F.max(F.when(F.col("_room") >= F.col("_n"), F.col("_b"))).alias("_full"), F.max(F.when(part, F.col("_b"))).alias("_part"), F.max(F.when(part, F.col("_room"))).alias("_room"))))
    whole = rows.join(F.broadcast(ends), F.lit(True), "left") if not keys else meet(rows, small(ends), keys, "left")  # one row without keys
    met = whole.withColumn("_b", F.floor(uniform * blocks).cast("int"))
    at_cut = F.coalesce(F.col("_v") == F.col("_cut"), F.lit(False))
    last = F.coalesce(at_cut & (F.col("_b") == F.col("_part")), F.lit(False))
    inside = Window.partitionBy(*keys, "_b").orderBy(uniform, key)
    ranked = met.filter(last).withColumn("chosen", (F.row_number().over(inside) <= F.col("_room")).cast("int"))
    decided = F.coalesce((F.col("_v") > F.col("_cut")) | (at_cut & (F.col("_b") <= F.col("_full"))), F.lit(False))
    out = met.filter(~last).withColumn("chosen", decided.cast("int")).unionByName(ranked)
    return out.select(*df.columns, "chosen")


def rate_score(train: DataFrame, test: DataFrame, keys: list[str], target: str, out: str = "p") -> DataFrame:
    """``test`` with the mean target of its key in ``train``, the overall mean where the key is new."""
    own = train.groupBy(*keys).agg(F.avg(target).alias("_own"))
    overall = train.agg(F.avg(target).alias("_all"))
    return test.join(own, keys, "left").crossJoin(F.broadcast(overall)).withColumn(out, F.coalesce("_own", "_all")).drop("_own", "_all")
