"""Keys of very many rows: same results, and no task that gets them all."""

import random

import pytest
from pyspark.sql import functions as F

from durata.operators import episodes as I
from durata.operators import prepare as P
from durata.operators.hot import hot_hashes, with_count


def tasks(df):
    """(rows of the fullest partition, mean over all)."""
    n = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(n), sum(n) / len(n)


@pytest.fixture(scope="module")
def ids(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 10 < 6, "").when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("n"))
    return df.repartition(8).cache()


def test_hot_hashes_are_the_hot_keys(ids):
    assert len(hot_hashes(ids, ["id"])) == 2 and hot_hashes(ids.limit(100), ["id"]) == [] and hot_hashes(ids.limit(0), ["id"]) == []


def test_counts_of_hot_and_missing_keys_do_not_meet(spark, ids):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        real = F.when(F.col("id") != "", F.col("id"))
        out = with_count(ids, real, "c")
        top, mean = tasks(out)
        assert top < 2 * mean
        assert {r.id: r.c for r in out.filter("id in ('', 'hot', '9', '19')").distinct().select("id", "c").distinct().collect()} == {"": None, "hot": 18_000, "9": 1, "19": 1}
        kept = P.frequent_keys(ids, "id", 100, [""])
        top, mean = tasks(kept)
        assert top < 2 * mean and kept.filter("known is not null").count() == 6000
        raw = ids.select("id", *[F.lit("").alias(c) for c in ("pub_start_date", "pub_end_date", "money_room", "house_area", "kenchiku_date", "madori_number_all", "madori_kind_all_label")], "n")
        done = P.prepare(raw)
        top, mean = tasks(done)
        assert top < 2 * mean
        assert (done.filter("repeated_id").count(), done.filter("missing_id").count()) == (18_000, 36_000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_an_entity_of_many_rows_is_stitched_in_ranges(spark):
    r = random.Random(9)
    rows = []
    for i in range(3000):
        unit = "big" if i % 3 == 0 else f"u{i % 200}"
        start = r.randrange(3000) if unit == "big" else r.randrange(400)
        rows.append((f"r{i:05}", "b", unit, start, start + r.choice([0, 1, 2, 5, 40]), "A" if r.random() < 0.97 else "B", 20.0 + (r.random() < 0.02) * 9))
    rows += [(f"m{i}", None, "x", 5, 9, "A", 1.0) for i in range(5)] + [("d", "b", "big", None, 3, "A", 1.0)]
    df = spark.createDataFrame(rows, "row_id string, building_id string, unit_id string, s int, e int, layout string, area double")
    df = df.withColumns({"start_date": F.date_from_unix_date(F.col("s")), "end_date": F.date_from_unix_date(F.col("e")), "station": F.lit("x")}).drop("s", "e").cache()
    order = lambda x: sorted(map(str, x.collect()))
    how = {"share": 50, "few": 100, "ranges": 16}
    assert order(I.segments(df, [0, 1, 7], **how)) == order(I.segments(df, [0, 1, 7]))
    assert order(I.episodes(df, [0, 1, 7], **how)) == order(I.episodes(df, [0, 1, 7]))
    assert I.segments(df, [1], **how).filter("unit_id = 'big'").select("segment").distinct().count() > 5
