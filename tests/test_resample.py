"""Bootstrap by splitting draws over halves of the clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.operators import resample as S
from durata.operators import resampled_auc as A
from durata.operators.ranking import auc
from durata.plans import q_scores
from durata.plans.queries import queries

SF = "/root/testdata/sf0.001"


def test_draws_of_ranges_add_up_and_follow_sizes():
    sizes = [5, 0, 11, 40, 1, 3, 300]
    drawn = np.stack([S._drawn_in(sizes, i, 2000, 7) for i in range(len(sizes))])
    assert (drawn.sum(axis=0) == sum(sizes)).all() and (drawn >= 0).all() and not drawn[1].any()
    share = np.array(sizes) / sum(sizes)
    assert np.allclose(drawn.mean(axis=1), sizes, atol=4 * np.sqrt(sum(sizes) * share * (1 - share) / 2000) + 1e-9)
    assert np.allclose(drawn.var(axis=1), sum(sizes) * share * (1 - share), rtol=0.15, atol=0.05)


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(6000).select((F.col("id") % 900).cast("string").alias("c"), F.rand(3).alias("x"), F.lit(1).alias("n"))
    return df.unionByName(spark.createDataFrame([(None, 0.5, 1), (None, None, 1)], "c string, x double, n int")).cache()


def test_every_replicate_draws_as_many_clusters_as_there_are(rows):
    how = {"replicates": 300, "seed": 5, "clusters_a_range": 40}
    out = S.resampled(rows, "c", {"n": F.col("n"), "x": F.col("x")}, **how)
    got = {r.rep: (r.draws, r.n, round(r.x, 6)) for r in out.collect()}
    assert len(got) == 300 and {d for d, _, _ in got.values()} == {901}
    assert len({n for _, n, _ in got.values()}) > 5
    again = S.resampled(rows.repartition(7), "c", {"n": F.col("n"), "x": F.col("x")}, **how)
    assert {r.rep: (r.draws, r.n, round(r.x, 6)) for r in again.collect()} == got
    per = np.array([r.x for r in rows.groupBy("c").agg(F.sum("x").alias("x")).collect()])
    x = np.array([x for _, _, x in got.values()])
    assert x.mean() == pytest.approx(per.sum(), abs=4 * per.std() * np.sqrt(901 / 300))
    assert x.std() == pytest.approx(per.std() * np.sqrt(901), rel=0.15)


def test_intervals_and_odd_tables(rows):
    r = S.resampled_interval(rows, "c", F.col("x"), F.col("n"), replicates=400).first()
    assert r.low < r.estimate < r.high and r.replicates == 400 and r.high - r.low == pytest.approx(2 * 1.96 * 0.2887 / np.sqrt(6000), rel=0.25)
    assert S.resampled(rows.limit(0), "c", {"x": F.col("x")}).collect() == []
    one = S.resampled(rows.filter("c = '7'"), "c", {"n": F.col("n")}, replicates=5).collect()
    assert [(x.draws, x.n) for x in one] == [(1, one[0].n)] * 5


def test_interval_of_the_query(spark):
    r = queries()["m15_m16_split_bootstrap"](spark, SF).first()
    cand = q_scores._cand(spark, SF)
    rate, n = cand.agg(F.avg("y"), F.count("*")).first()
    assert r.estimate == pytest.approx(rate, abs=1e-8) and r.low < rate < r.high and r.replicates == 1000
    assert r.high - r.low == pytest.approx(2 * 1.96 * np.sqrt(rate * (1 - rate) / n), rel=0.5)


def plain_auc(v, p, q):
    """Pairs of distinct scores one by one; ties count half."""
    won = sum(p[i] * (q[v < v[i]].sum() + q[v == v[i]].sum() / 2) for i in range(len(v)))
    return won / (p.sum() * q.sum()) if p.sum() and q.sum() else None


def test_draws_do_not_depend_on_who_asks():
    every = A.draws_of(np.arange(1000), 1000, 0, 64, 3)
    assert (every.sum(axis=0) == 1000).all() and every.mean() == 1 and every.var() == pytest.approx(1, rel=0.05)
    some = np.array([0, 5, 6, 500, 999])
    assert (A.draws_of(some, 1000, 0, 64, 3) == every[some]).all()
    assert (A.draws_of(np.arange(1000), 1000, 64, 64, 3) != every).any()
    assert (A.draws_of(np.arange(1), 1, 0, 4, 3) == 1).all()


@pytest.mark.parametrize("rows_a_range", [10**6, 37])
def test_resampled_aucs_equal_plain_loops(spark, rows_a_range):
    r = np.random.default_rng(4)
    made = []
    for i in range(1500):
        c = str(i % 211) if i % 3 else ("hot" if i % 30 else None)
        s = 0.5 if i % 5 < 2 else None if i % 97 == 0 else round(float(r.random()), 3)
        made.append((c, int(r.random() < 0.4), s, float("nan") if i % 50 == 0 else float(r.random())))
    df = spark.createDataFrame(made, "c string, y int, s double, t double")
    got = {(x.score, x.rep): x for x in A.resampled_auc(df, "c", ["s", "t"], "y", 70, 2, rows_a_range).collect()}
    assert len(got) == 140
    names = {x._c: x.cluster_no for x in S.numbered(df.select(F.coalesce("c", F.lit("\0null")).alias("_c")).distinct(), "_c").collect()}
    times = np.concatenate([A.draws_of(np.arange(len(names)), len(names), a, 64, 2) for a in (0, 64)], axis=1)
    no = np.array([names[c if c is not None else "\0null"] for c, *_ in made])
    for k, score in enumerate(("s", "t")):
        v = np.array([np.nan if x[2 + k] is None else np.inf if x[2 + k] != x[2 + k] else x[2 + k] for x in made])
        y, own = np.array([x[1] for x in made]), ~np.isnan(v)
        for rep in (0, 1, 63, 64, 69):
            w = times[no, rep]
            x = got[score, rep]
            assert (x.pos, x.neg) == ((w * y)[own].sum(), (w * (1 - y))[own].sum())
            assert x.auc == pytest.approx(plain_auc(v[own], (w * y)[own], (w * (1 - y))[own]), abs=1e-12)


def test_resampled_aucs_of_odd_tables(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.7), ("b", None, 0.1)], "c string, y int, s double")
    assert [(x.pos > 0, x.neg, x.auc) for x in A.resampled_auc(df, "c", ["s"], "y", 3).collect()] == [(True, 0, None)] * 3
    assert A.resampled_auc(df.limit(0), "c", ["s"], "y", 3).collect() == []


def test_auc_intervals_of_the_query(spark):
    got = {x.score: x for x in queries()["m17_resampled_auc"](spark, SF).collect()}
    cand = q_scores._cand(spark, SF).withColumn("early", -F.col("elapsed_day").cast("double"))
    for s in ("p", "early"):
        assert got[s].estimate == pytest.approx(auc(cand, [], s, "y").first().auc, abs=1e-8) and got[s].low < got[s].estimate < got[s].high
    assert got["p"].difference is None and got["early"].diff_low < got["early"].difference < got["early"].diff_high
    assert got["early"].difference == pytest.approx(got["early"].estimate - got["p"].estimate, abs=1e-8)


def test_large_clusters_get_the_same_draws(spark, monkeypatch):
    n = F.col("id")
    df = spark.range(800).select(F.when(n % 3 == 0, "large").otherwise((n % 50).cast("string")).alias("c"), (n % 7 < 3).cast("int").alias("y"), F.round(F.rand(5), 2).alias("s"))
    run = lambda: sorted((x.rep, x.pos, x.neg, x.auc) for x in A.resampled_auc(df, "c", ["s"], "y", 20, 1, 60).collect())
    usual, met = run(), []
    find = A.hot_hashes
    monkeypatch.setattr(A, "hot_hashes", lambda cells, keys: met.extend(find(cells, keys, share=10, few=0)) or met)
    assert run() == usual and len(met) == 1
