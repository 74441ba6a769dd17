"""Group statistics with explicit rules for ties, empty groups and missing values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, stored
from .ordered import running
from .quantiles import quantiles

_QUARTILES = [0.25, 0.5, 0.75]


def meet(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``, by equal groups, null ones included; without groups the one row of ``b``."""
    if not by:
        return a.crossJoin(b)
    b = b.withColumnsRenamed({c: f"_meet_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_meet_{c}"]) for c in by])
    return a.join(b, same, how).drop(*[f"_meet_{c}" for c in by])


def modes(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """``(by.., mode, frequency)``: every most frequent value of each group, a row each, however many are tied."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("mode")).agg(F.count("*").alias("frequency"))
    return meet(counts, counts.groupBy(*by).agg(F.max("frequency").alias("_top")), list(by)).filter("frequency = _top").drop("_top")


def exact_stats(df: DataFrame, value: str, by: list[str] = (), shown: int = 1000) -> DataFrame:
    """n, mean, median, modes joined by '|', number of modes, their frequency, min, quartiles, max.

    Values are counted first, so modes come from a table of distinct values.  The
    text has the ``shown`` smallest modes; ``mode_ties`` tells how many there are,
    and :func:`modes` has them all as rows.  Quartiles are exact at any size of a
    group (see :func:`.quantiles.quantiles`).  ``df`` is read once, since the
    columns needed are stored first.
    """
    by = list(by)
    rows = stored(df.select(*dict.fromkeys([*by, value])).filter(F.col(value).isNotNull()))
    top = modes(rows, value, by)
    first = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("mode")) <= shown
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_first"), F.col("mode")))), lambda v: v.cast("long").cast("string")), "|")
    tied = top.withColumn("_first", first).groupBy(*by).agg(listed.alias("modes"), F.count("*").alias("mode_ties"), F.first("frequency").alias("mode_freq"), F.min("mode").alias("mode"))
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = meet(meet(sums, tied, by), quantiles(rows, value, _QUARTILES, by).drop("n"), by)
    return out.select(*by, "n", "mean", F.col("q")[1].alias("median"), "modes", "mode_ties", "mode_freq", "min", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "max", "mode")


def selected_stat(stats: DataFrame, kind: str) -> DataFrame:
    """``value`` of the chosen statistic and ``issue``: a tied mode has no value."""
    if kind not in ("mean", "median", "mode"):
        raise ValueError("kind must be mean, median or mode")
    if kind != "mode":
        return stats.withColumns({"value": F.col(kind).cast("double"), "issue": F.lit(None).cast("string")})
    tied = F.col("mode_ties") > 1
    return stats.withColumns({"value": F.when(~tied, F.col("mode")).cast("double"), "issue": F.when(tied, F.concat(F.lit("tied: "), F.col("modes")))})


def full_range_stats(df: DataFrame, bands: DataFrame, bin_col: str, value: str) -> DataFrame:
    """Statistics of every band of ``bands(bin, ..)``; empty bands have n = 0 and nulls."""
    facts = exact_stats(df.filter(F.col(bin_col).isNotNull()), value, [bin_col])
    out = bands.join(facts, bands["bin"] == facts[bin_col], "left").drop(facts[bin_col])
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def cross_table(df: DataFrame, bands: DataFrame, categories: DataFrame, bin_col: str, cat_col: str, value: str) -> DataFrame:
    """n, mean, median, std (0 for one row), quartiles and IQR over the whole band by category grid; ``df`` is read once for all of them."""
    with scratch(df.sparkSession) as keep:
        rows = stored(df.filter(F.col(value).isNotNull()).select(F.col(bin_col).alias("bin"), F.col(cat_col), F.col(value)))
        return keep(stored(_cross_table(rows, bands, categories, cat_col, value)))


def _cross_table(rows: DataFrame, bands: DataFrame, categories: DataFrame, cat_col: str, value: str) -> DataFrame:
    facts = rows.groupBy("bin", cat_col).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    facts = meet(facts, quantiles(rows, value, _QUARTILES, ["bin", cat_col]).select("bin", cat_col, F.col("q").alias("_q")), ["bin", cat_col])
    grid = bands.select("bin").crossJoin(categories.select(cat_col))
    out = grid.join(facts, ["bin", cat_col], "left")
    return out.select("bin", cat_col, F.coalesce("n", F.lit(0)).alias("n"), "mean", F.col("_q")[1].alias("median"), "std", F.col("_q")[0].alias("q1"), F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, rows, present, missing, missing_rate)`` in one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(c).alias("present"), (F.col("_n") - F.col(c)).alias("missing"), ((F.col("_n") - F.col(c)) / F.col("_n")).alias("missing_rate")) for c in columns])
    return one.select(F.inline(rows))


def flag_counts(df: DataFrame, flags: list[str], scope: Column) -> DataFrame:
    """``(flag, whole, in_scope)``: how many rows have each flag, in all and within the scope."""
    one = df.agg(*[F.count_if(F.col(f)).alias(f) for f in flags], *[F.count_if(F.col(f) & scope).alias(f"_s_{f}") for f in flags])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("whole"), F.col(f"_s_{f}").alias("in_scope")) for f in flags])))


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """``(value, rank)`` of distinct values: ties share the mean of their ranks."""
    counts = running(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("_c")), "value", {"_below": "_c"})
    return counts.select("value", (F.col("_below") + (F.col("_c") + 1) / 2.0).alias("rank"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks, over pairs without nulls."""
    rows = df.select(F.col(x).alias("_x"), F.col(y).alias("_y")).dropna()
    rx = average_ranks(rows, "_x").select(F.col("value").alias("_x"), F.col("rank").alias("_rx"))
    ry = average_ranks(rows, "_y").select(F.col("value").alias("_y"), F.col("rank").alias("_ry"))
    # equal pairs are counted first: the ranks are joined to distinct pairs, not to rows
    pairs = rows.groupBy("_x", "_y").agg(F.count("*").cast("double").alias("w")).join(rx, "_x").join(ry, "_y")
    w, a, b = F.col("w"), F.col("_rx"), F.col("_ry")
    s = pairs.agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    cov = F.expr("n * ab - a * b")
    return s.select(F.col("n").cast("long").alias("n"), (cov / F.sqrt(F.expr("(n * aa - a * a) * (n * bb - b * b)"))).alias("rho"))


def correlation_ratio(df: DataFrame, category: str, value: str, least: int = 1) -> DataFrame:
    """eta = sqrt(between / total sum of squares), over groups of ``least`` rows or more."""
    rows = df.select(F.col(category).alias("_g"), F.col(value).cast("double").alias("_v")).dropna()
    g = rows.groupBy("_g").agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_v") * F.col("_v")).alias("ss")).filter(F.col("n") >= least)
    t = g.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return t.select("groups", "n", F.sqrt(F.expr("(b - s * s / n) / nullif(ss - s * s / n, 0)")).alias("eta"))


def pair_r2(df: DataFrame, x: str, z: str, y: str) -> DataFrame:
    """R-squared of least squares of y on two numeric attributes, in closed form from sums."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(z).cast("double").alias("z"), F.col(y).cast("double").alias("y")).dropna()
    r = rows.agg(F.count("*").alias("n"), F.corr("x", "y").alias("xy"), F.corr("z", "y").alias("zy"), F.corr("x", "z").alias("xz"))
    return r.select("n", F.expr("(xy * xy + zy * zy - 2 * xy * zy * xz) / nullif(1 - xz * xz, 0)").alias("r2"))


def pair_r2_category(df: DataFrame, x: str, category: str, y: str) -> DataFrame:
    """R-squared of least squares of y on a numeric attribute and a category's dummies: within-group centring."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(category).alias("g"), F.col(y).cast("double").alias("y")).dropna()
    g = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
    t = g.agg(F.sum("n").alias("n"), F.sum(F.expr("xx - x * x / n")).alias("sxx"), F.sum(F.expr("yy - y * y / n")).alias("syy"), F.sum(F.expr("xy - x * y / n")).alias("sxy"), F.sum("yy").alias("yy"), F.sum("y").alias("y"))
    return t.select("n", F.expr("1 - (syy - sxy * sxy / nullif(sxx, 0)) / nullif(yy - y * y / n, 0)").alias("r2"))


def long_groups(df: DataFrame, groupings: dict[str, Column], value: str) -> DataFrame:
    """``(kind, code, n, median)`` for several groupings at once: rows unpivoted and stored, so ``df`` is read once."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("code")) for k, c in groupings.items()])
    with scratch(df.sparkSession) as keep:
        rows = stored(df.select(F.col(value).alias("_v"), F.inline(pairs)).filter("code is not null"))
        return keep(stored(_long_groups(rows)))


def _long_groups(rows: DataFrame) -> DataFrame:
    return meet(rows.groupBy("kind", "code").agg(F.count("_v").alias("n")), quantiles(rows, "_v", [0.5], ["kind", "code"]).select("kind", "code", F.col("q")[0].alias("median")), ["kind", "code"], "left")


def group_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``(by.., n, ..)``: rows of each group and exact quantiles of a value under the names of ``shares``; null for groups without values.  ``df`` is read once."""
    by = list(by)
    with scratch(df.sparkSession) as keep:
        rows = stored(df.select(*dict.fromkeys([*by, value])))
        return keep(stored(_group_quantiles(rows, value, shares, by)))


def _group_quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    found = quantiles(df, value, list(shares.values()), by)
    named = found.select(*by, *[F.col("q")[i].alias(name) for i, name in enumerate(shares)])
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    if by:
        return meet(counts, named, by, "left")
    return counts.join(F.broadcast(named), F.lit(True), "left")


def describe_many(df: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`exact_stats` of several variables, one row each."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])))
    return exact_stats(rows, "value", ["variable"])


def weighted_medians(cells: DataFrame, by: str) -> DataFrame:
    """Mean of cell medians weighted by their n."""
    return cells.filter("n > 0").groupBy(by).agg((F.sum(F.col("median") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def extremes(cells: DataFrame, k: int, column: str, key: str, largest: bool) -> DataFrame:
    order = F.desc(column) if largest else F.asc(column)
    return cells.filter(F.col(column).isNotNull()).orderBy(order, key).limit(k)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attribute_table(df: DataFrame, numeric: list[str], categories: list[str], value: str) -> DataFrame:
    """One row an attribute: missing rate, and median, range and rho of numbers, or distinct count, top value, its share and eta of categories.  ``df`` is read once."""
    with scratch(df.sparkSession) as keep:
        rows = stored(df.select(*dict.fromkeys([*numeric, *categories, value])))
        return keep(stored(_attribute_table(rows, numeric, categories, value)))


def _attribute_table(df: DataFrame, numeric: list[str], categories: list[str], value: str) -> DataFrame:
    parts = []
    for c in numeric:
        one = df.agg(F.avg(F.col(c).isNull().cast("int")).alias("missing_rate"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
        one = one.crossJoin(group_quantiles(df, c, {"median": 0.5}).select("median")).select("missing_rate", "median", "min", "max")
        parts.append(one.crossJoin(spearman(df, c, value).select(F.col("rho").alias("strength"))).select(F.lit(c).alias("attribute"), "*"))
    for c in categories:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("_v")).agg(F.count("*").alias("_n"))
        top = counts.agg(F.count("*").alias("distinct_values"), F.max_by("_v", F.struct("_n", F.col("_v"))).alias("top_value"), (F.max("_n") / F.sum("_n")).alias("top_share"))
        rate = df.agg(F.avg(F.col(c).isNull().cast("int")).alias("missing_rate"))
        parts.append(rate.crossJoin(top).crossJoin(correlation_ratio(df, c, value).select(F.col("eta").alias("strength"))).select(F.lit(c).alias("attribute"), "*"))
    return union_all(parts)
