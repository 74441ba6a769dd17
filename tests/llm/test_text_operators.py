"""Text operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from durata.llm.decontaminate import benchmark_matches, without_matches
from durata.llm.jaccard_join import representatives, similar_documents
from durata.llm.recompression import anchors
from durata.llm.substring_dedup import repeated_passages
from durata.llm.wordhash import Words, mix, rolling, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, node string, key int"  # extra columns with clashing names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ünï", "x" * 40, "a b"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))
    rows = [None, "", "  \t\n ", "one", "same " * 80, "ab cd " * 40, *base]
    rows += [base[3], base[3], base[4] + " tail", passage + "\n" + base[5], base[6] + "\t" + passage, "same " * 37, "loooong" * 3000]
    rows += [" ".join(rng.choice(vocabulary) for _ in range(3000))]
    return list(enumerate(rows))


def brute_removed(rows, width):
    seen = {}
    for _, t in rows:
        w = words_of(t)
        for p in range(len(w) - width + 1):
            seen[tuple(w[p : p + width])] = seen.get(tuple(w[p : p + width]), 0) + 1
    out = {}
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] > 1:
                gone[p : p + width] = [True] * width
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), gone)
    return out


@pytest.mark.parametrize("width", [2, 7, 35])
def test_repeated_passages(spark, width):
    rows = corpus()
    want = brute_removed(rows, width)
    got = repeated_passages(docs(spark, rows).repartition(3), width=width, block_bytes=2000).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept, gone = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_text) == (n, removed, kept)
        marks = [False] * n
        for s in r.removed:
            assert s.start < s.end
            marks[s.start : s.end] = [True] * (s.end - s.start)
        assert marks == gone


@pytest.mark.parametrize("width", [7, 35])
def test_repeated_passages_at_long_runs(spark, width):
    rng = random.Random(4)
    rows = []
    for i in range(150):  # a passage that starts before or in a run or a period-two stretch, after different words, read by two texts
        x, y = f"x{i}", f"y{i}"
        stretch = ([x] if i % 2 else [x, y]) * 2 * width
        head = [f"h{i}.{j}" for j in range(rng.randint(0, 3))]
        passage = head + stretch[: rng.randint(width - len(head), width + 1)] + [f"t{i}.{j}" for j in range(rng.randint(0, 2))]
        for side in "ab":
            before = [f"{side}{i}.{j}" for j in range(rng.randint(1, 4))]
            rows.append((len(rows), " ".join([*before, *passage, f"{side}{i}.end"])))
    want = brute_removed(rows, width)
    got = repeated_passages(docs(spark, rows).repartition(3), width=width, block_bytes=2000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == {i: w[:3] for i, w in want.items()}


def test_repeated_passages_of_nothing(spark):
    assert repeated_passages(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        repeated_passages(docs(spark, []), width=1)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 3, 50):
        base = mix(rng.integers(0, letters, 300).astype(np.uint64))
        x = np.concatenate([base, mix(np.array([99], np.uint64)), base[20:90], np.repeat(base[:1], 60)])
        for width in (2, 10, 35):
            seen = {}
            for p, k, at in zip(*anchors(x, np.array([0, 300, len(x)]), width)):
                assert seen.setdefault(x[p : p + width].tobytes(), (k, at - p)) == (k, at - p)


def test_words_and_shingles():
    texts = ["Ab cD e\n\x0bf", None, "", "x", "a b c d a b c d", "y" * 1000 + " z"]
    w = Words(pa.array(texts), lower=True)
    assert np.diff(w.offsets).tolist() == [len(words_of(t)) for t in texts]
    plain = Words(pa.array(["ab cd e f"]))
    assert (w.hash[:3] == plain.hash).all()
    values, bounds = shingle_sets(w, 4)
    assert np.diff(bounds).tolist() == [1, 0, 0, 1, 4, 1]
    assert len(set(rolling(w.hash, 2).tolist())) > 5


def brute_components(rows, width, num, den):
    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("width, num", [(4, 85), (5, 80), (2, 60)])
def test_similar_documents(spark, width, num):
    rows = corpus(2)
    rng = random.Random(3)
    original = [f"t{rng.randint(0, 400)}" for _ in range(120)]
    for _ in range(60):  # a family of near copies, some of which link only through others
        copy = list(original)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"u{rng.randint(0, 9999)}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), "One TWO three"), (len(rows) + 1, "one two three"), (len(rows) + 2, "a b c d e f"), (len(rows) + 3, "a b c d e f")]
    want = brute_components(rows, width, num, 100)
    got = similar_documents(docs(spark, rows).repartition(3), width=width, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_similar_documents_edges(spark):
    assert similar_documents(docs(spark, [])).collect() == []
    got = similar_documents(docs(spark, [(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_representatives_keep_one_of_each_group(spark):
    five = "a b c d e f g"
    rows = [(5, five), (2, five), (9, None), (None, "q"), (7, "other words here now"), (2, five), (None, five), (None, "q"), (3, "p q r s t u"), (3, "p q r s t u"), (3, "some other text of id three"), (4, "p q r s t u"), (9, None)]
    d = docs(spark, rows).withColumnRenamed("key", "_row")
    kept = representatives(d.repartition(3))
    assert kept.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == sorted([("2", five), ("None", "q"), ("7", "other words here now"), ("3", "p q r s t u"), ("3", "some other text of id three")])
    assert kept.filter("text is null").count() == 2
    assert representatives(d.limit(0)).collect() == []


def brute_matches(rows, items, width=5, similarity=0.8):
    def lower(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]

    def counts(w, k):
        out = {}
        for i in range(len(w) - k + 1):
            out[tuple(w[i : i + k])] = out.get(tuple(w[i : i + k]), 0) + 1
        return out

    found = {}
    for d, t in rows:
        w = lower(t)
        for i, x in items:
            item = lower(x)
            n = len(item)
            if not n or not w:
                continue
            k = min(n, width)
            want = counts(item, k)
            best = (0.0, 0)
            for p in range(max(1, len(w) - n + 1)):
                have = counts(w[p : p + n], k)
                both = sum(min(c, want.get(s, 0)) for s, c in have.items())
                union = sum(have.values()) + sum(want.values()) - both
                if both and both / union > best[0]:
                    best = (both / union, p)
            if best[0] >= similarity - 1e-12:
                found[d, i] = (round(best[0], 9), best[1], min(n, len(w)))
    return found


def brute_matches_at(rows, items):
    """As :func:`brute_matches`, for the pairs of item i with documents 2i and 2i + 1 and no others (their words differ)."""
    return {k: v for i, x in items for k, v in brute_matches([r for r in rows if r[0] // 2 == i], [(i, x)]).items()}


@pytest.mark.parametrize("block_items", [3, 10_000])
def test_benchmark_matches(spark, block_items):
    rng = random.Random(7)
    pool = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([2, 6, 14, 14, 40])))) for i in range(9)]
    items += [(20, None), (21, ""), (22, items[3][1].upper())]
    rows = [(0, None), (1, ""), (2, " ".join(rng.choice(pool) for _ in range(400)))]
    for i, x in items[:9]:
        w = x.split()
        rows.append((100 + i, "before some words " + x + " and after"))
        rows.append((200 + i, x))
        near = list(w)
        near[len(near) // 2] = "changed"
        rows.append((300 + i, "lead " + " ".join(near[:-1]) + " trail of words"))
        rows.append((400 + i, " ".join(w[: len(w) // 2])))
    got = benchmark_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_items=block_items).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in got} == brute_matches(rows, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_benchmark_matches_with_repeated_tokens(spark):
    rng = random.Random(8)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    items, rows = [], [(0, "_ " * 300), (1, "a b " * 200)]
    for i in range(40):
        n = rng.randint(40, 120)
        tail = (n - 4) // 9  # the most that leaves a similarity of 0.8
        shared, other = [word() for _ in range(n - tail)], [word() for _ in range(tail)]
        run = [rng.choice(["_", "-", "Same"])] * tail
        items.append((i, " ".join(shared + (run if i % 4 == 0 else other))))
        rows.append((100 + i, " ".join(["lead", "words", *shared, *(other if i % 4 == 0 else run), *run[: i % 3], "end"])))
        rows.append((200 + i, " ".join([*shared, *run, word()][: n - i % 2 - 1])))
    items += [(50, "_ " * 60), (51, "a b " * 30), (52, "a b c " * 20 + "_ " * 5)]
    want = brute_matches(rows, items)
    got = benchmark_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in got} == want
    assert sum((100 + i, i) in want for i in range(40)) == 40


def test_fingerprints_decide_and_find_nearly_all(spark):
    rng = random.Random(12)
    word = lambda: f"v{rng.randint(0, 10**6)}"
    items, rows = [], []
    for i in range(120):
        w = [word() for _ in range(rng.randint(30, 150))]
        run, kind = rng.choice(["_", "the", "zz"]), i % 4
        items.append((i, " ".join(w + [run] * 12 * (kind == 3))))
        edits = max(1, len(w) // 50)
        for _ in range(edits):
            w[rng.randrange(len(w))] = word()
        if kind == 1:
            w[-(len(w) // 12) :] = [run] * (len(w) // 12)
        if kind == 2:
            del w[: len(w) // 12]
        rows.append((2 * i, " ".join(["lead", *w, *[run] * 12 * (kind == 3), "end"])))
    d, b = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = set(brute_matches_at(rows, items))
    pairs = lambda **how: {(r.doc_id, r.item_id) for r in benchmark_matches(d, b, **how).collect()}
    got = pairs()
    assert len(want) > 60 and got <= want and len(got) >= 0.97 * len(want)
    assert pairs(beyond_radius=True) == want
    assert len(pairs(radius=8)) < 0.8 * len(got)  # the radius decides


def test_benchmark_edges(spark):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    d = docs(spark, [(1, "x a b c d e f g y"), (1, "x a b c d e f g y"), (None, "a b c d e f g"), (3, "clean text")])
    found = benchmark_matches(d, items)
    assert sorted(str(r.doc_id) for r in found.collect()) == ["1", "1", "None"]
    more = d.unionByName(docs(spark, [(1, "a clean row of a repeated id"), (None, None), (4, "")])).withColumnRenamed("key", "_text")
    kept = without_matches(more, items)
    assert kept.columns == more.columns and kept.collect() == more.filter("not coalesce(text, '') like '%b c d%'").collect()
    assert benchmark_matches(docs(spark, []), items).collect() == [] and without_matches(docs(spark, []), items).collect() == []
    assert benchmark_matches(d, items.limit(0)).collect() == [] and without_matches(d, items.limit(0)).count() == 4
    odd = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "clean text"), (5, "")], "item_id long, text string")
    assert sorted(str((r.doc_id, r.item_id)) for r in benchmark_matches(d, odd).collect()) == ["(1, 1)", "(1, 1)", "(None, 1)"]


def test_overwritten_tail_is_found(spark):
    words = [f"w{i}" for i in range(204)]
    d = docs(spark, [(1, " ".join(words[:182] + ["zz"] * 22))])
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert [round(r.similarity, 4) for r in benchmark_matches(d, items).collect()] == [0.8018]
    assert without_matches(d, items).isEmpty()


def test_windows_at_the_edge_of_the_similarity(spark):
    rng = random.Random(12)
    pool = [f"v{i}" for i in range(3000)]
    items, rows = [], []
    for i in range(500):  # windows at a similarity of about 0.75 to 0.9, some items with repeated shingles
        n = rng.randint(30, 60)
        w = [rng.choice(pool) for _ in range(n)]
        if i % 3 == 0:
            w = (w[:6] * n)[: n // 2] + w[: n - n // 2]
        items.append((i, " ".join(w)))
        near = list(w)
        for _ in range(rng.randint(1, 2)):
            near[rng.choice([0, 1, 2, rng.randrange(n)])] = "zz"
        for j in range(2):
            rows.append((2 * i + j, " ".join([rng.choice(pool) for _ in range(rng.randint(0, 9))] + near[j:] + ["end"] * j)))
    want = brute_matches_at(rows, items)
    got = benchmark_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in got} == want
    assert sum(v[0] < 0.85 for v in want.values()) > 100


def test_very_long_text_is_searched_in_stretches(spark):
    rng = random.Random(13)
    words = [f"v{rng.randint(0, 40)}" for _ in range(120_000)]
    items = [(1, " ".join(words[70_000:70_040])), (2, " ".join(words[110_000:110_019] + ["other"])), (3, "v1 " * 40)]
    rows = [(1, " ".join(words))]
    got = benchmark_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_matches(rows, items)
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in got} == want
    # of item 2, the windows at 109 999 and 110 000 share the same 15 shingles: the first is told
    assert {i: start for (_, i), (_, start, _) in want.items()} == {1: 70_000, 2: 109_999}


def test_query_digests(spark, tmp_path):
    from durata.llm.queries import op1_substring_dedup

    docs(spark, corpus()).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_removed(corpus(), 35)
    for r in op1_substring_dedup(spark, str(tmp_path)).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()
