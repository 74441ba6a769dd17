"""Intermediate tables, free names, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch, shared_folder, small, stored

__all__ = ["hot_join", "hot_keys", "scratch", "shared_folder", "small", "stored", "unused"]


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores more as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int | None = None, share: int = 500, few: int = 20_000) -> list[int]:
    """Hashes of the unique ``keys`` of ``counts`` that hold more than one in ``share`` of all rows: fewer than ``share`` numbers, whatever the table's size.

    A table of ``few`` rows has none: there is nothing to spread.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    if total < few:
        return []
    return [r.h for r in counts.filter(F.col(n) > total / share).select(F.xxhash64(*keys).alias("h")).collect()]


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], hot: list[int], how: str = "inner", salts: int = 64) -> DataFrame:
    """``rows`` joined to ``side``, whose ``keys`` are unique, with hot keys dealt out.

    Rows of ``hot`` keys (see :func:`hot_keys`) are spread over ``salts`` tasks,
    each of which gets a copy of the key's row of ``side``.
    """
    if not hot:
        return rows.join(side, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(salts)).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt, copies = rows.withColumn("_salt", F.when(is_hot, spread).otherwise(0)), side.withColumn("_salt", F.explode(every))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
