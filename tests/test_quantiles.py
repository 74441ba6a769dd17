"""Exact quantiles, modes and cuts against Spark's buffers and plain loops."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from durata.functions.clean import hash_uniform
from durata.operators import metrics as M
from durata.operators import prepare as P
from durata.operators import ranking as R
from durata.operators import stats as G
from durata.operators.quantiles import quantiles

SHARES = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    wide = spark.range(9000).select((F.col("id") % 3).cast("string").alias("g"), F.exp(F.rand(1) * 300).alias("v"), (F.col("id") % 5).alias("f"))
    ties = spark.range(3000).select(F.lit(None).cast("string").alias("g"), (F.col("id") % 2 * 7.5).alias("v"), F.lit(1).cast("long").alias("f"))
    odd = spark.createDataFrame([("", float("nan"), 2), ("", -0.5, 1), ("only null", None, 1), ("one", 4.0, 1), ("never", 4.0, 0)], "g string, v double, f long")
    out = wide.unionByName(ties).unionByName(odd).cache()
    yield out
    out.unpersist()


@pytest.mark.parametrize("few", [10**6, 300])
def test_quantiles_are_exact_in_groups_and_whole(values, few):
    got = {r.g: (r.n, r.q) for r in quantiles(values, "v", SHARES, ["g"], few=few).collect()}
    want = {r.g: (r.n, r.q) for r in values.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", SHARES).alias("q")).filter("n > 0").collect()}
    assert str(got) != str({}) and {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
    got = quantiles(values.filter("not isnan(v)"), "v", SHARES, frequency=F.col("f"), few=few).first()
    rows = values.filter("not isnan(v)")
    assert got.q == rows.agg(F.percentile("v", F.array(*map(F.lit, SHARES)), F.col("f"))).first()[0]
    assert got.n == rows.filter("v is not null").agg(F.sum("f")).first()[0]


def test_quantiles_of_nothing_and_no_buffer(values, capsys):
    assert quantiles(values.limit(0), "v", SHARES).collect() == [] and quantiles(values.limit(0), "v", SHARES, ["g"]).collect() == []
    with pytest.raises(ValueError):
        quantiles(values, "v", [1.5])
    G.exact_stats(values.filter("not isnan(v)"), "v", ["g"]).explain()
    assert "percentile(" not in capsys.readouterr().out


def test_modes_are_bounded_in_text_and_whole_as_rows(spark):
    df = spark.range(3000).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("v"))
    out = G.exact_stats(df, "v", ["g"], shown=5).first()
    assert (out.g, out.modes, out.mode_ties, out.mode_freq, out["mode"], out.median) == (None, "0|1|2|3|4", 3000, 1, 0, 1499.5)
    assert G.modes(df, "v", ["g"]).count() == 3000
    assert G.exact_stats(df, "v", shown=2).first().modes == "0|1"


def tier_auc(rows, cuts):
    tiers = [[sum(1 for p, y in rows if y == k and sum(p >= c for c in cuts) == t) for t in range(len(cuts) + 1)] for k in (1, 0)]
    won = sum(a * (2 * sum(tiers[1][:t]) + tiers[1][t]) for t, a in enumerate(tiers[0]))
    return won, [a + b for a, b in zip(*tiers)]


@pytest.mark.parametrize("tiers", [2, 4, 5])
def test_best_cuts_equal_enumeration(spark, tiers):
    r = random.Random(tiers)
    rows = [(p, int(r.random() < p)) for p in [r.choice([i / 14 for i in range(15)]) for _ in range(300)]]
    edges = sorted({sorted(p for p, _ in rows)[0], *(q for q in quantiles(spark.createDataFrame(rows, "p double, y int"), "p", [round(0.1 + 0.02 * i, 2) for i in range(41)]).first().q)})
    best = None
    for cuts in itertools.combinations(edges, tiers - 1):
        won, sizes = tier_auc(rows, cuts)
        if min(sizes) >= 0.1 * len(rows) and (best is None or won > best[0]):
            best = (won, list(cuts), sizes)
    out = M.best_cuts(spark.createDataFrame(rows, "p double, y int"), "p", "y", tiers).collect()
    assert [(x.cuts, x.sizes) for x in out] == ([(best[1], best[2])] if best else [])
    assert M.best_cuts(spark.createDataFrame([(0.5, 1)] * 9, "p double, y int"), "p", "y", tiers).collect() == []


@pytest.mark.parametrize("few,blocks", [(10**6, 4096), (40, 8)])
def test_same_share_equals_sorting_each_group(spark, few, blocks):
    r = random.Random(11)
    made = [(r.choice(["a", "b", None]), str(i), r.choice([0.5, 0.5, None, r.random(), float("nan") if i % 9 == 0 else 0.1])) for i in range(900)]
    made += [("one", "x", 0.3), ("two", "y", 0.3), ("two", "z", 0.3)] + [("same", str(i), 1.0) for i in range(200)]
    df = spark.createDataFrame(made, "g string, row_id string, s double")
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        w = Window.partitionBy("g")
        order = w.orderBy(F.desc(F.coalesce("s", F.lit(float("-inf")))), hash_uniform(F.lit(1), F.col("row_id")), "row_id")
        want = df.withColumn("chosen", (F.row_number().over(order) <= F.bround(F.lit(share) * F.count("*").over(w))).cast("int"))
        got = R.same_share(df, ["g"], "s", share, few=few, blocks=blocks)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert R.same_share(df, [], "s", 0.25, few=few, blocks=blocks).agg(F.sum("chosen")).first()[0] == round(0.25 * len(made))
    assert R.same_share(df, [], "s", 0.0).agg(F.count("*"), F.sum("chosen")).first() == (len(made), 0)
    assert R.same_share(df.limit(0), ["g"], "s", 0.3).collect() == []


def test_the_first_row_of_an_id_is_found_before_the_shuffle(spark, capsys):
    P.first_per_id(spark.createDataFrame([("a", 1)], "id string, row_id int"), F.col("id"), ["row_id"]).explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > 0 and "Partial" in plan


def counting(spark, df):
    """``df`` through a task that counts its rows, and the counter."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), read


def test_tables_are_read_once_for_all_statistics(spark):
    from durata.operators import stats as G
    from durata.operators import survival as K

    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 40).alias("t"), (F.col("id") % 2).cast("int").alias("event"), (F.col("id") % 7).cast("int").alias("e"))
    asked = {
        "quantiles": lambda df: quantiles(df, "t", SHARES, ["g"], few=5),
        "stats": lambda df: G.exact_stats(df, "t", ["g"]),
        "many": lambda df: G.describe_many(df, ["t", "e"]),
        "groups": lambda df: G.group_quantiles(df, "t", {"m": 0.5}, ["g"]),
        "long": lambda df: G.long_groups(df, {"g": F.col("g"), "e": F.col("e")}, "t"),
        "attributes": lambda df: G.attribute_table(df, ["e"], ["g"], "t"),
        "cross": lambda df: G.cross_table(df.withColumnRenamed("e", "b"), spark.range(7).select(F.col("id").cast("int").alias("bin")), spark.createDataFrame([("0",), ("1",)], "g string"), "b", "g", "t"),
        "curves": lambda df: K.two_level(spark.createDataFrame([("0", 3), (None, 4)], "g string, at int"), df, "at", 5, ["g"]),
    }
    for name, ask in asked.items():
        df, read = counting(spark, rows)
        ask(df).collect()
        assert read.value == 1000, name


def test_repeated_values_are_counted_before_ranks_are_looked_for(spark, monkeypatch):
    """Many rows of few values need no rounds of narrowing, and no task orders more than the values."""
    from durata.operators import quantiles as module

    monkeypatch.setattr(module, "_narrowed", lambda *a: pytest.fail("narrowed"))
    rows = spark.range(5000).select((F.col("id") % 50).alias("v"))
    assert quantiles(rows, "v", [0.5], few=100).first().q == [24.5]
