"""Batch forms of record search, paging and risk lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, condition: Column, order: list[str], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size - 1`` of the matches by ``order``, with ``position`` and ``total``.

    Only the page's upper end is sorted (a top-k), and the total is a count of its own.
    """
    hits = df.filter(condition)
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy(*order).limit(start + size)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    return top.withColumn("position", F.row_number().over(w) - 1).filter(F.col("position") >= start).crossJoin(F.broadcast(total))


def group_table(df: DataFrame, keys: list[str], target: str, cut: float) -> DataFrame:
    """Per group: n, rate and level by threshold."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))
    return g.withColumn("level", F.when(F.col("rate") >= cut, "high").otherwise("low"))


#: Orders of a group table by name: column and whether the largest come first.
ORDERS = {"rate": ("rate", True), "low_rate": ("rate", False), "count": ("n", True), "name": (None, False)}


def filter_groups(groups: DataFrame, keys: list[str], equal: dict[str, list], text: str = "", saved: list[str] | None = None, order: str = "rate") -> DataFrame:
    """Rows of a group table with their ``group_id``: given values of some keys, a text in any key, saved ids, in one of four orders.

    ``saved`` ids alone, with any order, are a side-by-side comparison.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}")
    name = F.concat_ws(" | ", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys])
    out = groups.withColumn("group_id", name)
    for k, values in equal.items():
        out = out.filter(F.col(k).isin(list(values)))
    if text:
        out = out.filter(F.lower("group_id").contains(text.lower()))
    if saved is not None:
        out = out.filter(F.col("group_id").isin(list(saved)))
    column, largest = ORDERS[order]
    return out.orderBy(*([F.desc(column) if largest else F.asc(column)] if column else []), "group_id")


def risk_lookup(requests: DataFrame, groups: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Requests with their group's rate; groups that are missing or smaller than ``least`` give ``insufficient_data``."""
    known = groups.filter(F.col("n") >= least)
    out = requests.join(known, keys, "left")
    return out.withColumn("status", F.when(F.col("rate").isNull(), "insufficient_data").otherwise("ok"))
