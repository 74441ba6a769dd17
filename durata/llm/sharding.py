"""Sharding by jump consistent hashing, in DataFrame functions only.

The key and the number of shards alone decide a row's shard; with one more shard,
a row either stays or moves into the new one, which takes the fraction
``1 / (n + 1)``.  No ring table exists, so there is nothing to ship or keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import scratch, stored

# Fixed values of the published jump hash: its generator's multiplier, in two halves.
_HIGH, _LOW = divmod(2862933555777941757, 1 << 32)
_PRIME, _FACTOR = 65521, 31321  # a cell is a multiple of the key modulo a prime, so strides spread


def _dec(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("decimal(20,0)")


def jump_shards(key: Column, n: int) -> Column:
    """``struct<small, large>``: the key's shard among ``n`` and among ``n + 1``.

    The generator works modulo 2**64.  Products of 32-bit halves are exact in
    decimals, which neither overflow under ANSI rules nor round.
    """
    two32 = F.lit(1 << 32)
    low = key.bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned(key, 32)
    start = F.struct(F.lit(-1).cast("long").alias("small"), F.lit(-1).cast("long").alias("large"), F.lit(0).cast("long").alias("j"), high.alias("high"), low.alias("low"))

    def step(acc: Column, _: Column) -> Column:
        cross = (_dec(acc["high"]) * _dec(_LOW) + _dec(acc["low"]) * _dec(_HIGH)) % _dec(two32)
        whole = (_dec(acc["low"]) * _dec(_LOW) + cross.cast("decimal(20,0)") * _dec(two32) + F.lit(1)).cast("decimal(22,0)")
        new_low = (whole % _dec(two32)).cast("long")
        new_high = F.expr("1") * F.floor((whole - new_low.cast("decimal(22,0)")) / _dec(two32)).cast("decimal(22,0)") % _dec(two32)
        new_high = new_high.cast("long")
        jumped = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(new_high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(F.when(acc["j"] < n, acc["j"]).otherwise(acc["small"]).alias("small"), acc["j"].alias("large"), jumped.alias("j"), new_high.alias("high"), new_low.alias("low"))
        return F.when(acc["j"] > n, acc).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), start, step, lambda acc: F.struct(acc["small"].cast("int").alias("small"), acc["large"].cast("int").alias("large")))


def shard_rows(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", shards: int = 24, parts: int = 256, copies: int = 100_000) -> DataFrame:
    """One row per row: ``(key_col, size, text_crc32, law, shard, slot, grown_shard)``.

    ``size`` is the text's UTF-8 length plus 8, ``slot`` numbers a shard's rows
    from 0 without gaps, ``grown_shard`` is the shard when one more exists.
    ``law`` is ``key``: the key and the shard count decide, so equal keys share a
    shard.  Null keys count as -1 but stay null; null texts as empty (size 8, crc
    0); repeated rows each get a slot of their own; an empty table gives none.
    Other columns are not read.

    Rows that are equal here are counted before they are shuffled, and become rows
    again at the end, ``copies`` at a time, so that neither a key nor a text that
    very many rows share is one task's work.  Slots come from the counts of
    ``shards * parts`` cells, dealt by key and text (a table of that
    fixed size, so it can be broadcast), and from sums within a cell: no task sees
    a whole shard.
    """
    if shards < 1 or parts < 1 or copies < 1:
        raise ValueError("shards, parts and copies must be 1 or more")
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(key_col).alias("_key"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.coalesce(F.col("_key").cast("long"), F.lit(-1))
    with scratch(spark) as keep:
        # stored, so that the jump hash is run once a row
        kinds = rows.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_n")).withColumn("_k", key).withColumn("_s", jump_shards(F.col("_k"), shards))
        kinds = keep(stored(kinds.select("_key", "_k", "size", "text_crc32", "_n", F.col("_s.small").alias("shard"), F.col("_s.large").alias("grown_shard"), F.pmod(F.pmod(F.pmod("_k", F.lit(_PRIME)) * _FACTOR, F.lit(_PRIME)) + F.col("text_crc32"), F.lit(parts)).alias("_part"))))
        cells = kinds.groupBy("shard", "_part").agg(F.sum("_n").alias("_n"))
        before = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy("shard", *by[1:]).orderBy(*by[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        base = cells.select("shard", "_part", before(["_part"]).alias("_base"))
        at = kinds.withColumn("_at", before(["_k", "text_crc32", "size", F.col("_key").isNull()], "_part")).join(F.broadcast(base), ["shard", "_part"])
        # what few copies have is made rows where it lies; the rest is dealt out first
        first = keep(stored(at.select("_key", "size", "text_crc32", "shard", "grown_shard", "_n", (F.col("_base") + F.col("_at")).alias("_first"))))
    few = first.filter(F.col("_n") <= copies).withColumn("slot", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)))
    many = first.filter(F.col("_n") > copies).withColumn("_i", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / copies)))).repartition("_key", "text_crc32", "_i")
    start, last = F.col("_first") + F.col("_i") * copies, F.col("_first") + F.least(F.col("_n"), (F.col("_i") + 1) * copies) - 1
    out = few.unionByName(many.withColumn("slot", F.explode(F.sequence(start, last))).drop("_i"))
    return out.select(F.col("_key").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, placed: DataFrame, path: str, key_col: str = "doc_id") -> None:
    """Write ``df``'s rows as Parquet, one folder a shard, by the shards of their (unique) keys."""
    own = placed.select(F.col(key_col), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    df.join(own, key_col).repartition("_shard", F.floor(F.col("_slot") / 1_000_000)).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
