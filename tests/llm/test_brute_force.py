"""Classifiers and mixing against plain loops over dictionaries."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from durata.llm.classifiers import OPTIONS, classifier, scored
from durata.llm.mixing import mix_sources
from durata.llm.queries import queries
from tests.llm.test_table_operators import WORD, mix_frame


def toxic_features(text):
    w = [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    return {("w", x) for x in w} | {(gap, a, b) for gap in (1, 2, 3) for a, b in zip(w, w[gap:])}


def quality_features(text):
    w = WORD.findall(text or "")
    return {("w", x) for x in w} | {("w", a, b) for a, b in zip(w, w[1:])} | {("w", a, b, c) for a, b, c in zip(w, w[1:], w[2:])}


def brute_fit(examples, epochs=5, alpha=3.0, beta=1.0, l1=10.0, l2=1.0, min_docs=5):
    seen = Counter(f for features, _ in examples for f in features)
    share = sum(y for _, y in examples) / len(examples)
    z, n = Counter(), Counter()

    def weight(f):
        sparse = 0.0 if f is None else l1
        return 0.0 if abs(z[f]) <= sparse else (math.copysign(sparse, z[f]) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for features, y in examples:
            own = [None, *(f for f in features if seen[f] >= min_docs)]
            w = {f: weight(f) for f in own}
            g = (0.5 / share if y else 0.5 / (1 - share)) * (1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - y)
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in list(z)}


@pytest.mark.parametrize("name, label, folds, fold, features", [("op3_toxicity", "toxic", 5, 0, toxic_features), ("op7_quality", "quality", 3, 1, quality_features)])
def test_scores_equal_a_plain_learner(spark, tmp_path, name, label, folds, fold, features):
    rng = random.Random(5)
    pool = [f"word{i}" for i in range(60)] + ["Ünï", "A.B", "x,", "77"]
    rows = []
    for i in range(240):
        w = [rng.choice(pool) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            w = ["BAD!", *w, "vile", "stuff"] * 2
        rows.append((i * 7, " ".join(w), "l", "s", i))
    rows += [(5000, None, "l", "s", 0), (5001, "", "l", "s", 0), (None, "vile word1", "l", "s", 0)]
    labels = [(i * 7, int(i % 4 == 0), int(i % 4 == 0)) for i in range(240)] + [(9999, 1, 1), (None, 1, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _score int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    usable = [(i, t) for i, t, *_ in rows[:240] if zlib.crc32(str(i).encode()) % folds != fold]
    usable.sort(key=lambda r: ((r[0] + 1) * 0x9E3779B97F4A7C15 % 2**64, r[0]))
    w = brute_fit([(features(t), int(i // 7 % 4 == 0)) for i, t in usable], **OPTIONS[label])
    assert len([f for f, v in w.items() if v and f is not None]) > 3
    got = queries()[name](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for (i, t, *_), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0])), sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id))):
        margin = w[None] + sum(w.get(f, 0.0) for f in features(t))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9
        assert r.held_out == (zlib.crc32(str(i if i is not None else "").encode()) % folds == fold) and r.predicted == (r.score >= 0.5)


def test_training_texts_are_bounded(spark):
    rows = [(i, "bad words " * 50 if i % 2 else "good words " * 50) for i in range(100)] + [(7, "bad words " * 50)] * 5000
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    scorer = classifier(d, labels, "toxic", F.lit(True), most_bytes=20_000)
    assert scored(d, scorer, "toxic").filter("doc_id % 2 <> _predicted").isEmpty()
    none = classifier(d, labels, "toxic", F.lit(True), most_bytes=10)
    assert len(none.known) == 0
    odd = scored(d.limit(3).withColumn("_Score", F.lit(7)), scorer, "toxic")
    assert odd.columns == ["doc_id", "text", "_Score", "_score_", "_predicted"] and {r["_Score"] for r in odd.collect()} == {7}


def test_a_long_text_or_no_labels_do_not_undo_training(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, "bad words " * 50 if i % 2 else "good words " * 50) for i in range(60)]
    first = spark.range(60).orderBy(F.xxhash64("id"), "id").first().id
    rows[first] = (first, "a long text " * 20_000)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    scorer = classifier(d, labels, "toxic", F.lit(True), most_bytes=100_000)
    assert len(scorer.known) > 3
    assert scored(d.filter(F.col("doc_id") != first), scorer, "toxic").filter("doc_id % 2 <> _predicted").isEmpty()
    for name, some in (("none", labels.limit(0)), ("all", labels.withColumn("toxic", F.lit(1)))):
        some.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.toxicity(spark, d, f"{tmp_path}/{name}").count() == 60
    untrained = classifier(d, labels.limit(0), "toxic", F.lit(True))
    assert {r["_predicted"] for r in scored(d, untrained, "toxic").collect()} == {0}


def chained(*values):
    """Spark's xxhash64 of a row of integers (int, long) and texts; nulls leave it as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def small(v):
    return struct.pack("<i", v)


def large(v):
    return None if v is None else struct.pack("<q", v)


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_mixing_equals_a_plain_walk(spark, block_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"]), "w " * rng.randint(1, 50)) for i in range(700)]
    rows += [(9001, None, "a b c"), (9002, "big", None), (9003, "mid", ""), (None, "mid", "null id"), (9004, "void", "")]
    got = mix_sources(mix_frame(spark, rows), entropy_share=0.8, max_repetition=2.5, block_rows=block_rows).collect()
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(WORD.findall(t or ""))
    total = sum(tokens.values())
    p = {s: n / total for s, n in tokens.items() if n}

    def mix(a):
        norm = sum(x**a for x in p.values())
        return {s: x**a / norm for s, x in p.items()}

    def least(good, low, high):
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (low, middle) if good(middle) else (middle, high)
        return high

    goal = 0.8 * math.log(len(p))
    a = max(least(lambda a: -sum(w * math.log(w) for w in mix(a).values()) <= goal, 0, 8), least(lambda a: max(total * w / tokens[s] for s, w in mix(a).items()) <= 2.5, 0, 1))
    weight = {r.source: r._weight for r in got}
    assert weight["void"] == 0 and all(abs(weight[s] - w) < 1e-5 for s, w in mix(a).items())
    want = {}
    for s in tokens:
        own = [(i, t, len(WORD.findall(t or "")), chained(small(1), large(i), t)) for i, x, t in rows if x == s]
        quota = math.floor(weight[s] * total)
        whole, left = divmod(quota, tokens[s]) if tokens[s] else (1, 0)
        blocks = -(-len(own) // block_rows)
        for b in sorted(range(blocks), key=lambda b: (chained(small(2), s if s is not None else "\0", large(b)), b)):
            inside = sorted((r for r in own if r[3] % blocks == b), key=lambda r: (chained(small(3), large(r[3])), r[3]))
            room, size, used = left, sum(r[2] for r in inside), 0
            left -= size
            for i, t, n, _ in inside:
                used += n
                extra = room >= size if not 0 < room < size else used <= room
                want[i, s] = whole + extra if n else max(whole, 1)
    assert {(r.doc_id, r.source): r._draws for r in got} == want
