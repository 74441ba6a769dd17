"""Centroid clustering and hard negatives against plain loops, with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from durata.llm.centroids import Orchard, cluster
from durata.llm.mining import Bucket, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
INF, NAN = float("inf"), float("nan")


def whole(v):
    return [math.floor(256 * x) for x in v]


def fine(v, dim=None):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and dim in (None, len(v))


def kmeans(rows, k, rounds, dim, seed=2):
    """(id, cluster, distance, cluster inertia, inertia, hash), by the contract."""
    vs = [(i, whole(v)) for i, v, *_ in rows if fine(v, dim)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), w) for i, w in vs if i is not None)[:k]
    c = [w for _, w in first]
    if not c:
        return []
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda w: min((d2(w, x), n) for n, x in enumerate(c))
    for _ in range(rounds):
        at = [near(w)[1] for _, w in vs]
        own = {n: [w for (_, w), a in zip(vs, at, strict=True) if a == n] for n in set(at)}
        c = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else w for n, w in enumerate(c)]
    found = [(i, *near(w)[::-1]) for i, w in vs]
    inertia = {n: sum(d for _, a, d in found if a == n) for n in range(len(c))}
    text = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), text[n]) for i, n, d in found), key=str)


def clustered(df, **how):
    out = cluster(df, **how).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out), key=str)


def test_orchard_search_finds_the_nearest_and_tests_few():
    r = np.random.default_rng(1)
    c = np.concatenate([r.integers(-200, 200, (30, 8)), r.integers(-3, 3, (10, 8)), np.zeros((2, 8), int)])
    x = np.concatenate([c, c + r.integers(-9, 9, c.shape), r.integers(-300, 300, (500, 8))]).astype(np.int64)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    search = Orchard(c)
    at, best = search.nearest(x)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()  # argmin takes the smaller of equals
    tight = Orchard(np.arange(40)[:, None] * 1000 + np.zeros((1, 8), int))
    tight.nearest(np.repeat(tight.c, 50, axis=0) + 1)
    assert tight.tested < 2000 * 40 / 3


def test_clusters_equal_plain_loops(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(4)], 0) for i in range(150)]
    rows += [(i, rows[i % 3][1], 0) for i in range(150, 190)] + [rows[7], rows[7], (7, [0.5] * 4, 0)]
    rows += [(200, None, 0), (201, [0.1, None, 0.0, 0.0], 0), (202, [NAN] * 4, 0), (203, [INF, 0.0, 0.0, 0.0], 0), (204, [0.1], 0), (205, [], 0), (None, [0.1, 0.2, 0.3, 0.4], 0), (-3, [-1.0, -0.001, 0.001, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for k, rounds in ((6, 3), (1, 2), (6, 0), (400, 1)):
        assert clustered(df, k=k, rounds=rounds, dim=4) == kmeans(rows, k, rounds, 4)


def test_clusters_of_equal_and_too_long_vectors(spark):
    rows = [(i, [0.25, 0.5], 0) for i in range(30)] + [(99, [1e300, 0.0], 0), (98, [1e6, 0.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert clustered(df, k=5, rounds=2, dim=2) == kmeans([*rows[:30], rows[31]], 5, 2, 2)  # 1e300 is left out, as documented
    assert cluster(df.limit(0), dim=2).collect() == []
    odd = df.limit(30).selectExpr("*", "7 as CLUSTER", "8 as _w", "9 as _c", "10 as inertia")
    out = cluster(odd, k=2, rounds=1, dim=2)
    assert out.columns == [*odd.columns, "cluster_", "distance", "cluster_inertia", "inertia_", "centroid_sha256"]
    assert {(r.CLUSTER, r._w, r._c, r.inertia, r.cluster_) for r in out.collect()} == {(7, 8, 9, 10, 0)}


def negatives(rows, every, positives=5, k=5, low=80, high=100):
    """The contract, pair by pair."""
    vs = sorted({(i, tuple(whole(v)), y) for i, v, y in rows if i is not None and y is not None and fine(v)})
    out = []
    for i, a, y in vs:
        if i % every == 0:
            score = [(-sum(p * q for p, q in zip(a, b, strict=True)), j, z) for j, b, z in vs if j != i and len(b) == len(a)]
            for s, j, _ in sorted(x for x in score if x[2] == y)[:positives]:
                own = sorted(x for x in score if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:k]
                out += [(i, j, n, m, -s, -t) for n, (t, m, _) in enumerate(own, 1)]
    return sorted(out)


def mined(df, every, **how):
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **how).collect()))


@pytest.mark.parametrize("block", [40, 1 << 20])
def test_negatives_equal_plain_loops(spark, block):
    r = random.Random(8)
    near = [[r.gauss(0, 0.4) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.1) * r.choice((1, 3)) for x in r.choice(near)], r.randrange(4)) for i in range(240)]
    rows += [(i, rows[3][1], i % 2) for i in range(240, 280)] + [rows[10], rows[20], rows[20]]
    rows += [(300, None, 1), (310, [0.1] * 6, None), (None, [0.1] * 6, 1), (320, [NAN] + [0.1] * 5, 1), (330, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (340, [INF] * 6, 1), (350, [0.0] * 6, 1), (351, [0.0] * 6, 2), (352, [0.0] * 6, 1)]
    rows += [(360, [0.5, 0.5], 1), (361, [0.4, 0.5], 1), (362, [0.4, 0.4], 2), (370, [], 1), (371, [], 1), (372, [], 2), (380, [1e200, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = [x for x in rows if x[0] != 380]  # too long for exact products, as documented
    want = negatives(kept, 10)
    assert len(want) > 100 and mined(df, 10, block_numbers=block, least_rows=7) == want
    assert mined(df, 10, positives=2, negatives=3, low=90, high=99, block_numbers=block, least_rows=50) == negatives(kept, 10, 2, 3, 90, 99)


def test_coordinate_ranges_lose_nothing_and_prune():
    r = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, asked = unit(r.normal(size=(3000, 6))), unit(r.normal(size=(40, 6)))
    bucket, left = Bucket(rows, 1.0), 0
    for q in asked:
        for least in (0.6, 0.9, 0.99, 1.0):
            got = bucket.candidates(q, least)
            wanted = np.flatnonzero(rows @ q >= least)
            assert got is None or set(wanted) <= set(got)
            left += len(rows) if got is None else len(got) if least == 0.9 else 0
    assert left < 40 * 3000 / 2


def test_negatives_of_nothing_and_extra_columns(spark):
    df = spark.createDataFrame([(i, [0.1 * i, 0.2], i % 2) for i in range(1, 9)], SCHEMA)
    assert mined(df, 100) == [] and mined(df.limit(0), 1) == []
    odd = df.selectExpr("*", "1 as _id", "2 as RANK", "3 as _label", "4 as anchor_id", "5 as _e")
    assert mined(odd, 1) == mined(df, 1) == negatives([tuple(r) for r in df.collect()], 1)
