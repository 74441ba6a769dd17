"""What was live at a date, what was known then, and how crowded it was."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot(df: DataFrame, dates: list[dt.date], horizons: list[int], obs_end: dt.date, years: list[int] | None = None) -> DataFrame:
    """Rows live at each date (start <= date < end) with ``elapsed_day`` and ``target_h`` for each horizon.

    A date whose longest horizon reaches ``obs_end`` is refused: its targets are
    not known.  Dates are few and exploded within the row, so nothing is joined.
    Rows that are live at no date go before that, by a test of their own columns
    that Spark moves below the joins that ``df`` comes from.
    """
    if bad := [d for d in dates if d + dt.timedelta(days=max(horizons)) >= obs_end]:
        raise ValueError(f"targets unknown at {bad[0]}")
    rows = df if years is None else df.filter(F.year("start_date").isin(years))
    if dates:
        rows = rows.filter(_any([(F.col("start_date") <= F.lit(d)) & (F.col("end_date") > F.lit(d)) for d in dates]))
    rows = rows.withColumn("snapshot", F.explode(F.array(*[F.lit(d) for d in dates]))).filter("start_date <= snapshot and end_date > snapshot")
    ended = lambda h: ((F.col("end_date") <= F.date_add("snapshot", h)) & (F.col("end_date") < F.lit(obs_end))).cast("int")
    return rows.withColumns({"elapsed_day": F.datediff("snapshot", "start_date"), **{f"target_{h}": ended(h) for h in horizons}})


def active_count(df: DataFrame, group: list[str], out: str = "active") -> DataFrame:
    """``df`` with how many others of the group were live at each row's own start.

    A sweep over +1/-1 changes per group and day; intervals never meet pairwise.
    """
    change = df.select(*group, F.inline(F.array(F.struct(F.col("start_date").alias("_day"), F.lit(1).alias("_c")), F.struct(F.col("end_date").alias("_day"), F.lit(-1).alias("_c")))))
    days = change.groupBy(*group, "_day").agg(F.sum("_c").alias("_c"))
    live = F.sum("_c").over(Window.partitionBy(*group).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0))
    days = days.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_day"), live.alias("_live"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = df.join(days, _all([*same, F.col("start_date") == F.col("_day")]), "left")
    own = (F.col("end_date") > F.col("start_date")).cast("int")
    return joined.withColumn(out, F.greatest(F.col("_live") - own, F.lit(0))).drop("_day", "_live", *[f"_g{i}" for i in range(len(group))])


def live_at(intervals: DataFrame, questions: DataFrame, group: list[str], day: str, out: str = "live") -> DataFrame:
    """``questions`` with how many ``intervals`` of their group are live on their ``day`` (start <= day < end).

    One sweep per group: starts add, ends subtract, and the days that are asked
    for read the running sum.  All three shrink to one row a group and day first, so
    a group of very many intervals is no long sort.  Null groups are a group of
    their own; a group without intervals has 0, a null day null.  Intervals without
    both dates, or that end before they start, do not count.
    """
    day_col, c, n = unused("_day", questions.columns), unused("_c", questions.columns), [unused(f"_g{i}", questions.columns) for i in range(len(group))]
    named = [F.col(g).alias(x) for g, x in zip(group, n, strict=True)]
    own = intervals.filter("start_date is not null and end_date is not null and end_date > start_date")
    ends = F.array(F.struct(F.col("start_date").alias(day_col), F.lit(1).alias(c)), F.struct(F.col("end_date").alias(day_col), F.lit(-1).alias(c)))
    change = own.select(*named, F.inline(ends)).unionByName(questions.filter(F.col(day).isNotNull()).select(*named, F.col(day).alias(day_col), F.lit(0).alias(c)))
    days = change.groupBy(*n, day_col).agg(F.sum(c).alias(c))
    running = F.sum(c).over(Window.partitionBy(*n).orderBy(day_col).rowsBetween(Window.unboundedPreceding, 0))
    days = days.withColumn(c, running)
    same = [questions[g].eqNullSafe(days[x]) for g, x in zip(group, n, strict=True)]
    joined = questions.join(days, _all([*same, questions[day] == days[day_col]]), "left")
    return joined.select(*[questions[x] for x in questions.columns if x != out], F.when(questions[day].isNotNull(), F.coalesce(days[c], F.lit(0))).alias(out))


def unused(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def look_back(df: DataFrame, key: list[str], days: int = 365, order: str = "row_id") -> DataFrame:
    """``recent``: starts of the key in the ``days`` before; ``prev_length`` and ``prev_gap``: of the previous interval, if it ended by now and not longer ago.

    Rows with a null in the key have no history: 0 and nulls.  They are dealt out
    by ``order``, so that they are no partition of their own.
    """
    unknown = _any([F.col(k).isNull() for k in key])
    rows = df.withColumns({"_day": F.unix_date("start_date"), "_alone": F.when(unknown, F.col(order).cast("string"))})
    w = Window.partitionBy(*key, "_alone")
    before = w.orderBy("start_date", order)
    rows = rows.withColumns({"recent": F.count("*").over(w.orderBy("_day").rangeBetween(-days, -1)), "_ps": F.lag("start_date").over(before), "_pe": F.lag("end_date").over(before)})
    gap = F.datediff("start_date", "_pe")
    known = (gap >= 0) & (gap <= days) & F.col("_alone").isNull()
    return rows.withColumns({"recent": F.when(F.col("_alone").isNull(), F.col("recent")).otherwise(0), "prev_length": F.when(known, F.datediff("_pe", "_ps")), "prev_gap": F.when(known, gap)}).drop("_day", "_ps", "_pe", "_alone")
