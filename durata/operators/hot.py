"""Heavy hitters: the few keys that hold so many rows that one task should not get them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_hashes(df: DataFrame, keys: list[str], share: int = 500, few: int = 20_000, buckets: int = 1 << 14) -> list[int]:
    """``xxhash64(*keys)`` of every key that holds more than one in ``share`` of all rows: fewer than ``share`` numbers, whatever the table's size.

    No row is shuffled by its key.  Rows are first counted in ``buckets`` hash
    buckets, a sketch of fixed size that each task combines by itself; only keys of
    buckets above the threshold, which are fewer than ``share``, are then counted
    one by one, again with partial sums.  Null is a key like any other.  A table of
    ``few`` rows has no hot key: there is nothing to spread.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    sketch = hashed.groupBy(F.pmod("h", F.lit(buckets)).alias("b")).agg(F.count("*").alias("n")).collect()  # at most `buckets` rows
    total = sum(r.n for r in sketch)
    heavy = [r.b for r in sketch if r.n * share > total]
    if total < few or not heavy:
        return []
    counts = hashed.filter(F.pmod("h", F.lit(buckets)).isin(heavy)).groupBy("h").agg(F.count("*").alias("n"))
    return sorted(r.h for r in counts.filter(F.col("n") * share > total).collect())


def with_count(df: DataFrame, key: Column, name: str, share: int = 500, few: int = 20_000) -> DataFrame:
    """``df`` with ``name``, how many of its rows have the row's value of ``key``; null where the key is null.

    Rows of keys that hold more than one in ``share`` of the rows do not meet in a
    task: their counts come from partial sums, fewer than ``share`` of them, and
    are broadcast.  Rows with a null key are not counted and stay apart too.
    """
    rows = df.withColumn("_count_key", key)
    hot = hot_hashes(rows.filter("_count_key is not null"), ["_count_key"], share, few)
    is_hot = F.xxhash64("_count_key").isin(hot) if hot else F.lit(False)
    apart = F.when(F.col("_count_key").isNull() | is_hot, F.xxhash64(*df.columns))
    rows = rows.withColumn("_count_n", F.count("*").over(Window.partitionBy("_count_key", apart)))
    n = F.when(F.col("_count_key").isNotNull(), F.col("_count_n"))
    if hot:
        large = df.withColumn("_count_key", key).filter(is_hot).groupBy("_count_key").agg(F.count("*").alias("_count_hot"))
        rows = rows.join(F.broadcast(large), "_count_key", "left")
        n = F.coalesce("_count_hot", n)
    return rows.withColumn(name, n).select(*df.columns, name)
