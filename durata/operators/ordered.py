"""Running sums over all rows of a table by an order, with no task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, value: str, sums: dict[str, str | Column], descending: bool = False, ranges: int = 200) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its column over the rows that come before by ``value``, a unique number.

    Rows are cut into ``ranges`` of neighbouring values (by approximate quantiles,
    so ranges hold about equally many rows).  Each range is summed up and sorted by
    itself, and the totals of the ranges before, a table of that fixed size, are
    added.  A null value comes first in ascending order and last in descending.
    """
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    # all columns are read in each branch, so that one shuffle below serves them all
    some = F.max(F.xxhash64(*df.columns))
    cuts = F.percentile_approx(F.col(value).cast("double"), shares, 10_000)
    edges = df.agg(F.when(some.isNotNull() & cuts.isNotNull(), cuts).otherwise(F.array().cast("array<double>")).alias("_edges"))
    number = F.size(F.filter("_edges", lambda c: c <= F.col(value)))
    rows = df.crossJoin(F.broadcast(edges)).withColumn("_range", -number if descending else number).drop("_edges")
    column = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = rows.groupBy("_range").agg(some.alias("_some"), *[F.sum(c).alias(f"_t_{name}") for name, c in column.items()]).filter("_some is not null")
    across = before(Window.partitionBy(F.lit(0)).orderBy("_range"))
    base = total.select("_range", *[F.coalesce(F.sum(f"_t_{name}").over(across), F.lit(0)).alias(f"_b_{name}") for name in sums])
    within = before(Window.partitionBy("_range").orderBy(F.desc(value) if descending else F.asc(value)))
    rows = rows.withColumns({f"_w_{name}": F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in column.items()}).join(F.broadcast(base), "_range")
    return rows.withColumns({name: F.col(f"_b_{name}") + F.col(f"_w_{name}") for name in sums}).drop("_range", *[f"_{x}_{name}" for name in sums for x in "bw"])
