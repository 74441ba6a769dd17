"""Exact order statistics of large groups, without a buffer of a group's values.

A wanted rank is first known to lie between a group's least and greatest value.
Sketches of fixed size propose narrower bounds, counts of the rows below and between
them decide which hold the rank, and only rows between are looked at again.  Once
few rows are left between the bounds, the rank is read off.  Bounds of all groups and
ranks are narrowed together, a few rows each.  Rows are counted by value before any of
this and the counts are stored, so the table that they come from is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch, small, stored

_GRID = 128


def _narrowed(rows: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Bounds ``(by.., _r, _lo, _hi, _below, _inside)`` with tighter ones where a sketch finds them."""
    inside = _within(rows, open_, by)
    shares = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    grid = inside.groupBy(*by, "_r").agg(F.percentile_approx("_v", shares, 16 * _GRID).alias("_grid"))  # a row counts once here, whatever its frequency
    place = ((F.col("_r") - F.col("_below")) / F.col("_inside") * _GRID).cast("int")
    cut = lambda i: F.element_at("_grid", F.least(F.greatest(i, F.lit(0)), F.lit(_GRID)) + 1)
    tried = small(open_.join(grid, [*by, "_r"]).withColumns({"_a": F.greatest(cut(place - 2), F.col("_lo")), "_b": F.least(cut(place + 3), F.col("_hi"))}).transform(stored))
    # what lies below, between and above the proposed bounds, exactly
    v, n, a, b = (F.col(c) for c in ("_v", "_n", "_a", "_b"))
    middle = (v > a) & (v < b)
    often = lambda where: F.sum(F.when(where, n).otherwise(0))
    counts = _within(rows, tried, by).groupBy(*by, "_r").agg(
        often(v < a).alias("_c0"), often(v == a).alias("_c1"), often(middle).alias("_c2"), often((v == b) & (a < b)).alias("_c3"),
        F.max(F.when(v < a, v)).alias("_last"), F.min(F.when(middle, v)).alias("_first"), F.max(F.when(middle, v)).alias("_end"), F.min(F.when(v > b, v)).alias("_next"),
    )
    out, c = tried.join(counts, [*by, "_r"]), [F.lit(0).cast("long"), *[F.col(f"_c{i}") for i in range(4)]]
    so_far = [sum(c[: i + 1], F.lit(0)) for i in range(5)]  # rows before each of the five parts: below a, a, between, b, above b
    at = F.col("_r") - F.col("_below")

    def part(*values: Column) -> Column:
        pick = F.when(at < so_far[1], values[0])
        for i in (1, 2, 3):
            pick = pick.when(at < so_far[i + 1], values[i])
        return pick.otherwise(values[4])

    # a heavy value is met by a cut and solved there; every round takes at least the two cuts' values out
    low, high = part(F.col("_lo"), a, F.col("_first"), b, F.col("_next")), part(F.col("_last"), a, F.col("_end"), b, F.col("_hi"))
    left = part(*c[1:], F.col("_inside") - so_far[4])
    return out.select(*by, "_r", low.alias("_lo"), high.alias("_hi"), (F.col("_below") + part(*so_far)).alias("_below"), left.alias("_inside"))


def _within(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Rows between the bounds of their group, once for each bound."""
    if by:
        met = rows.join(bounds, by)
    else:
        met = rows.crossJoin(F.broadcast(bounds))  # a row a rank, so as few as the ranks asked for
    return met.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def _placed(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts of values with ``_before``, the rows of smaller ones in the same group."""
    return counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))


def quantiles(df: DataFrame, value: str | Column, shares: list[float], by: list[str] = (), frequency: Column | None = None, few: int = 2_000_000) -> DataFrame:
    """``(by.., n, q)``: the number of values and the exact quantiles at ``shares``, between ranks by linear interpolation.

    Nulls, frequencies, groups without values and ``few`` are those of :func:`values_at`.
    """
    if any(not 0 <= s <= 1 for s in shares) or not shares:
        raise ValueError("shares must be between 0 and 1")
    # one expression over an array of shares, however many there are
    positions = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: s * (F.col("n") - 1))

    def between(p: Column) -> Column:
        value_at = lambda r: F.element_at("at", r.cast("long"))
        low, high = F.floor(p), F.ceil(p)
        return F.when(value_at(low) == value_at(high), value_at(low)).otherwise((high - p) * value_at(low) + (p - low) * value_at(high))

    ranks = F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(F.floor(p), F.ceil(p)))))
    return values_at(df, value, ranks, by, frequency, few).select(*by, "n", F.transform(positions, between).alias("q"))


def values_at(df: DataFrame, value: str | Column, wanted: Column, by: list[str] = (), frequency: Column | None = None, few: int = 2_000_000) -> DataFrame:
    """``(by.., n, at)``: the number of values, and a map of ranks (from 0, ascending) to the values there.

    ``wanted`` is an array of ranks by the group's number of values, the column
    ``n``; a group that wants none has no row.

    ``frequency`` (a whole number from 0) says how often a row counts.  Nulls do
    not count; a group without values has no row, an empty table without groups
    none at all.  Values are compared as doubles, NaN last.  Ranks in groups of at
    most ``few`` different values are read off at once; those of larger ones are
    narrowed until at most ``few`` rows lie between their bounds or the bounds meet, so no task holds or sorts more.

    ``df`` is read once.  The result is a stored table of the groups.
    """
    by = list(by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    keys = list(names.values())
    # null groups are told apart by a flag, so that joins are plain equalities
    flags = [f"{k}n" for k in keys]
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(names[c]) for c in by]
    rows = df.select(*own, *[F.col(c).isNull().alias(f) for c, f in zip(by, flags, strict=True)], v.alias("_v"), (F.lit(1) if frequency is None else frequency).cast("long").alias("_n")).filter("_v is not null and _n > 0")
    group = [*keys, *flags]
    types = {f.name: f.dataType for f in df.select(*by).schema} if by else {}
    shown = [F.when(~F.col(f), F.col(names[c]).cast(types[c])).alias(c) for c, f in zip(by, flags, strict=True)]

    def counted_at(some: DataFrame) -> DataFrame:
        """The wanted ranks of groups of few values: ``(group.., n, _r, _v)``."""
        counts = _placed(some, group).withColumn("n", F.sum("_n").over(Window.partitionBy(*(group or [F.lit(0)]))))
        here = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        return counts.select(*group, "n", F.explode(here).alias("_r"), "_v")

    def answers(ranks: DataFrame) -> DataFrame:
        at = ranks.groupBy(*group, "n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("at"))  # as many entries as wanted
        return at.select(*shown, "n", "at")

    with scratch(df.sparkSession) as keep:
        counts = stored(rows.groupBy(*group, "_v").agg(F.sum("_n").alias("_n")))
        most = counts.groupBy(*group).agg(F.count("*").alias("_values")).agg(F.max("_values")).first()[0] or 0
        if most <= few:
            return keep(stored(answers(counted_at(counts))))
        facts = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.count("*").alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        large = stored(facts.filter(F.col("_values") > few))
        bounds = stored(large.select(*group, F.explode(wanted).alias("_r"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("n").alias("_inside")))
        is_open = (F.col("_inside") > few) & (F.col("_lo") < F.col("_hi"))
        while True:  # each round leaves about a twentieth of the rows
            open_ = stored(bounds.filter(is_open))
            if not open_.count():
                break
            bounds = stored(bounds.filter(~is_open).unionByName(_narrowed(counts, small(open_), group)))
        read = _placed(_within(counts, small(stored(bounds.filter("_lo < _hi"))), group), [*group, "_r", "_below"])
        rank = F.col("_r") - F.col("_below")
        found = read.filter((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))).select(*group, "_r", "_v")
        ranks = found.unionByName(bounds.filter("_lo >= _hi").select(*group, "_r", F.col("_lo").alias("_v")))
        sizes = small(large.select(*group, "n"))
        ranks = ranks.join(sizes, group) if group else ranks.crossJoin(F.broadcast(large.select("n")))
        ranks = ranks.select(*group, "n", "_r", "_v")
        if group:
            ranks = ranks.unionByName(counted_at(counts.join(sizes.drop("n"), group, "left_anti")))
        return keep(stored(answers(ranks)))
