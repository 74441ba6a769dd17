"""Bands of numeric values: full-range equal-width, irregular, and quantile bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles


def band_table(df: DataFrame, attributes: dict[str, float], edge_rule: str = "next", per_page: int = 10, most: int = 100_000) -> DataFrame:
    """``(attr, bin, lo, hi, label, page)``: every band from 0 to the maximum, empty ones too.

    ``next``: a maximum on an edge gets the band that starts there; ``ceil``: the
    last band ends at the edge, so such a maximum falls out.  Negative values are
    ignored; an attribute without values has one band.  More than ``most`` bands
    are refused: an outlier would decide the table's size.
    """
    for name, step in attributes.items():
        if not (isinstance(step, (int, float)) and math.isfinite(step) and step > 0):
            raise ValueError(f"step of {name} must be positive")
    if edge_rule not in ("next", "ceil"):
        raise ValueError("edge_rule must be next or ceil")
    last = {}
    for name, step in attributes.items():
        top = F.max(F.when(F.col(name) >= 0, F.col(name)))
        n = F.floor(top / step) if edge_rule == "next" else F.greatest(F.ceil(top / step) - 1, F.lit(0))
        last[name] = F.coalesce(n, F.lit(0)).cast("long")
    bounded = lambda v: F.when(v >= most, F.raise_error(F.lit(f"more than {most} bands"))).otherwise(v).cast("int")
    one = df.agg(*[bounded(v).alias(k) for k, v in last.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("attr"), F.col(k).alias("last"), F.lit(float(s)).alias("step")) for k, s in attributes.items()])
    bins = one.select(F.inline(rows)).select("attr", "step", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"))
    lo, hi = F.col("bin") * F.col("step"), (F.col("bin") + 1) * F.col("step")
    return bins.select("attr", "bin", lo.alias("lo"), hi.alias("hi"), _label(F.col("bin"), F.col("step")).alias("label"), F.floor(F.col("bin") / per_page).cast("int").alias("page"))


def equal_width(c: Column, step: float) -> Column:
    """The band's number, left-closed; null below 0."""
    return F.when(c >= 0, F.floor(c / step).cast("int"))


def _label(band: Column, step: Column) -> Column:
    return F.concat((band * step).cast("long").cast("string"), F.lit("-"), ((band + 1) * step).cast("long").cast("string"))


def apply_bands(df: DataFrame, attr: str, step: float, out: str) -> DataFrame:
    """``df`` with the label of ``attr``'s band, as :func:`band_table` names it; null below 0.  Labels are arithmetic: nothing is joined."""
    band = equal_width(F.col(attr), step)
    return df.withColumn(out, F.when(band.isNotNull(), _label(band, F.lit(float(step)))))


def left_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """[a, b) bands, the last one open; null below the first edge."""
    out = F.lit(None).cast("string")
    for lo, label in zip(edges, labels, strict=True):
        out = F.when(c >= lo, label).otherwise(out)
    return out


def right_closed(c: Column, edges: list[float], labels: list[str]) -> Column:
    """(a, b] bands; the last label is for values above the last edge; null stays null."""
    out = F.when(c.isNotNull(), labels[-1])
    for hi, label in reversed(list(zip(edges, labels[:-1], strict=True))):
        out = F.when(c <= hi, label).otherwise(out)
    return out


def floor_code(c: Column, width: float) -> Column:
    """The number of the band as text, 'unknown' for null."""
    return F.coalesce(F.floor(c / width).cast("int").cast("string"), F.lit("unknown"))


def quantile_edges(df: DataFrame, column: str, shares: list[float], name: str) -> DataFrame:
    """One row with ``name``, the distinct exact quantiles in order; an empty array without values."""
    some = quantiles(df, column, shares).agg(F.first("q").alias("q"))
    return some.select(F.coalesce(F.array_sort(F.array_distinct("q")), F.array().cast("array<double>")).alias(name))


def quantile_bands(df: DataFrame, column: str, k: int) -> DataFrame:
    """``df`` with ``band``: right-closed bands between the k-quantiles, equal edges merged; ties stay together."""
    edges = quantile_edges(df, column, [i / k for i in range(1, k)], "_edges")
    above = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    return df.crossJoin(F.broadcast(edges)).withColumn("band", F.when(F.col(column).isNotNull(), above)).drop("_edges")


def histogram(df: DataFrame, column: str, width: float, bins: int) -> DataFrame:
    """``(bin, n, share)`` with the last band open."""
    n = df.filter(F.col(column) >= 0).select(F.least(F.floor(F.col(column) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").count()
    total = n.agg(F.sum("count").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("bin", F.col("count").alias("n"), (F.col("count") / F.col("_t")).alias("share"))
