"""Right-censored durations, Kaplan-Meier curves as tables, and what is read from them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, small, stored
from .stats import meet


def _curve_window(strata: list[str]):
    return Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))


def censored_at(df: DataFrame, obs_end: dt.date, years: list[int] | None = None) -> DataFrame:
    """``observed_end``, ``t`` (whole days) and ``event``: an end on the observation end or later, or none, is censored there."""
    end = F.lit(obs_end)
    event = F.coalesce(F.col("end_date") < end, F.lit(False))
    rows = df.filter(F.col("start_date").isNotNull())
    if years is not None:
        rows = rows.filter(F.year("start_date").isin(years))
    rows = rows.withColumns({"event": event.cast("int"), "observed_end": F.when(event, F.col("end_date")).otherwise(end)})
    return rows.withColumn("t", F.datediff("observed_end", "start_date")).filter("t >= 0")


def known_at(df: DataFrame, cutoff: dt.date) -> DataFrame:
    """The table as it was known at ``cutoff``: later starts are unknown, later ends censored at the cutoff."""
    return censored_at(df.filter(F.col("start_date") < F.lit(cutoff)), cutoff)


def km_curve(df: DataFrame, strata: list[str] = ()) -> DataFrame:
    """``(strata.., t, d, c, n, s)``: one row per distinct time, with n at risk and the survival share after it.

    Rows shrink to distinct times before any window, so windows see days, not rows.
    """
    strata = list(strata)
    return _curve(df.groupBy(*strata, "t").agg(F.sum("event").alias("d"), F.count("*").alias("c")), strata)


def _curve(g: DataFrame, strata: list[str]) -> DataFrame:
    """The curve from ends ``d`` and rows ``c`` of each time."""
    w = _curve_window(strata)
    at_risk = F.sum("c").over(w.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("n", at_risk)
    step = F.lit(1.0) - F.col("d") / F.col("n")
    return g.withColumn("s", F.product(step).over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))


def survival_at(curve: DataFrame, days: list[int], strata: list[str] = ()) -> DataFrame:
    """``(strata.., day, s)``: the step function at checkpoints, 1 before the first time."""
    strata = list(strata)
    at = curve.withColumn("day", F.explode(F.array(*[F.lit(d) for d in days])))
    reached = F.col("t") <= F.col("day")
    last = F.max_by(F.when(reached, F.col("s")), F.when(reached, F.col("t")))
    return at.groupBy(*strata, "day").agg(F.coalesce(last, F.lit(1.0)).alias("s"))


def quantile_times(curve: DataFrame, shares: list[float], strata: list[str] = ()) -> DataFrame:
    """``(strata.., share, t)``: the first time by which that share has ended (up to rounding); null if it never has."""
    strata = list(strata)
    at = curve.withColumn("share", F.explode(F.array(*[F.lit(p) for p in shares])))
    return at.groupBy(*strata, "share").agg(F.min(F.when(F.col("s") <= 1 - F.col("share") + 1e-9, F.col("t"))).alias("t"))


def summary(df: DataFrame, strata: list[str], days: list[int] = (14, 30, 60)) -> DataFrame:
    """Per stratum: n, events, censored, median time and survival at the days."""
    curve = km_curve(df, strata)
    counts = df.groupBy(*strata).agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.sum(1 - F.col("event")).alias("censored"))
    median = quantile_times(curve, [0.5], strata).select(*strata, F.col("t").alias("median_t"))
    wide = survival_at(curve, list(days), strata).groupBy(*strata).pivot("day", list(days)).agg(F.first("s"))
    wide = wide.select(*strata, *[F.col(str(d)).alias(f"s_{d}") for d in days])
    return counts.join(median, strata).join(wide, strata)


def lookup(points: DataFrame, curve: DataFrame, at: str, out: str, strata: list[str] = ()) -> DataFrame:
    """``points`` with the curve's value at column ``at``; 1 before the first time, null for an unknown stratum.

    Points shrink to distinct (stratum, time) pairs, which meet the curve's
    breakpoints by a running last value over both, so no pair of rows is built.
    """
    strata = list(strata)
    keys = points.select(*strata, F.col(at).alias("t")).filter(F.col(at).isNotNull()).distinct().withColumns({"_s": F.lit(None).cast("double"), "_q": F.lit(1)})
    steps = curve.select(*strata, F.col("t").cast(keys.schema["t"].dataType).alias("t"), F.col("s").alias("_s"), F.lit(0).alias("_q"))
    w = _curve_window(strata)
    known = F.count("_s").over(w) > 0
    last = F.last("_s", ignorenulls=True).over(w.orderBy("t", "_q").rowsBetween(Window.unboundedPreceding, 0))
    found = keys.unionByName(steps).select(*strata, "t", "_q", F.when(known, F.coalesce(last, F.lit(1.0))).alias(out)).filter("_q = 1").drop("_q").withColumnRenamed("t", at)
    return points.join(found, [*strata, at], "left")


def conditional_end(points: DataFrame, curve: DataFrame, elapsed: str, horizon: int, out: str, strata: list[str] = ()) -> DataFrame:
    """P(end within ``horizon`` more days | still open at ``elapsed``), in [0, 1]; null where nothing is left at ``elapsed``."""
    rows = points.withColumn("_later", F.col(elapsed) + horizon)
    rows = lookup(lookup(rows, curve, elapsed, "_s0", strata), curve, "_later", "_s1", strata)
    p = F.when(F.col("_s0") > 0, F.least(F.greatest(1 - F.col("_s1") / F.col("_s0"), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn(out, p).drop("_later", "_s0", "_s1")


def two_level(points: DataFrame, train: DataFrame, elapsed: str, horizon: int, strata: list[str]) -> DataFrame:
    """Conditional end by stratum where it is known, else over all: ``p``, ``fallback``.

    Both curves come from one stored table of times, so ``train`` is read once, and
    chances are worked out for each stratum and time that is asked for, not for each point.
    """
    keys = [*strata, elapsed]
    with scratch(points.sparkSession) as keep:
        times = stored(train.groupBy(*strata, "t").agg(F.sum("event").alias("d"), F.count("*").alias("c")))
        asked = stored(points.select(*keys).distinct())
        whole = times.groupBy("t").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
        own = stored(conditional_end(asked, stored(_curve(times, strata)), elapsed, horizon, "_own", strata))
        chances = keep(stored(conditional_end(own, stored(_curve(whole, [])), elapsed, horizon, "_all")))
    both = meet(points, small(chances), keys)
    return both.withColumns({"p": F.coalesce("_own", "_all"), "fallback": F.col("_own").isNull()}).drop("_own", "_all")


def remaining_median(curve: DataFrame, elapsed: list[int], cap: int = 730, strata: list[str] = ()) -> DataFrame:
    """``(strata.., elapsed, days)``: further days until half of those open at ``elapsed`` have ended; ``cap`` if never."""
    strata = list(strata)
    at = survival_at(curve, elapsed, strata).select(*strata, F.col("day").alias("elapsed"), F.col("s").alias("_s0"))
    steps = curve.select(*strata, "t", "s")
    both = at.join(steps, strata) if strata else at.crossJoin(steps)
    later = F.when((F.col("t") > F.col("elapsed")) & (F.col("s") <= F.col("_s0") / 2), F.col("t"))
    return both.groupBy(*strata, "elapsed").agg(F.coalesce(F.min(later) - F.col("elapsed"), F.lit(cap)).alias("days"))


def confidence_band(curve: DataFrame, strata: list[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Greenwood variance with the log-log transform: ``low``, ``high``."""
    w = _curve_window(list(strata)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(F.col("n") > F.col("d"), F.col("d") / (F.col("n") * (F.col("n") - F.col("d"))))
    v = F.sum(term).over(w)
    inner = (F.col("s") > 0) & (F.col("s") < 1)
    theta = F.lit(z) * F.sqrt(v) / F.ln("s")
    return curve.withColumns({"low": F.when(inner, F.pow("s", F.exp(-theta))).otherwise(F.col("s")), "high": F.when(inner, F.pow("s", F.exp(theta))).otherwise(F.col("s"))})


def yearly_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("start_date").alias("start_year")).agg(
        F.count("*").alias("n"), F.sum("event").alias("events"), F.sum(1 - F.col("event")).alias("censored"), (F.sum(1 - F.col("event")) / F.count("*")).alias("censored_share"),
        F.median("t").alias("median_t"), F.max("t").alias("max_t"),
    )


def condition_table(df: DataFrame, strata: list[str], least: int, elapsed: int, horizon: int) -> DataFrame:
    """Per stratum of ``least`` rows or more: n, times by which 25, 50 and 75 % have ended, and P(end in ``horizon`` more days | open at ``elapsed``)."""
    big = df.groupBy(*strata).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    curve = km_curve(df, strata)
    ended = lambda share: F.min(F.when(F.col("s") <= 1 - share, F.col("t")))
    at = lambda day: F.coalesce(F.max_by(F.when(F.col("t") <= day, F.col("s")), F.when(F.col("t") <= day, F.col("t"))), F.lit(1.0))
    q = curve.groupBy(*strata).agg(ended(0.25).alias("q25"), ended(0.5).alias("q50"), ended(0.75).alias("q75"), at(elapsed).alias("_a"), at(elapsed + horizon).alias("_b"))
    return big.join(q, strata).select(*strata, "n", "q25", "q50", "q75", F.when(F.col("_a") > 0, 1 - F.col("_b") / F.col("_a")).alias("p"))
