"""Shared lines against plain loops, with awkward rows."""

import hashlib
import random

from pyspark.sql import functions as F

from durata.llm import line_dedup as L


def brute(rows, least_chars=20, least_docs=3):
    """(id, text) rows to (id, lines, dropped, sha256), by the contract."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\x0b\x0c\r").translate(low)
    order = lambda d: (d is not None, d)
    where = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                where.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if len(where.get(key(x), ())) < least_docs or max(where[key(x)], key=order) == d]
        out.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    out = L.without_repeated_lines(df).withColumn("sha", F.sha2("kept_text", 256))
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.sha) for r in out.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_equal_plain_loops(spark):
    r = random.Random(3)
    pool = [f"A line of {i} that ÉCOLE many share" for i in range(12)] + ["short", "", "  ", "x" * 20, "y" * 19]
    pads = ["", " ", "\t", "\r", "\x0b\x0c", " "]
    rows = [(d, "\n".join(r.choice(pads) + r.choice((str.upper, str.lower, str))(r.choice(pool)) + r.choice(pads) for _ in range(r.randrange(1, 12)))) for d in range(60)]
    rows += [(60, None), (61, ""), (62, "\n"), (63, "\n\n"), (None, pool[0]), (None, pool[1] + "\n" + pool[0]), (5, rows[5][1]), (5, "other\n" + pool[2])]
    assert got(frame(spark, rows)) == brute(rows)
    assert any(n for _, _, n, _ in brute(rows))


def test_bitmaps_hold_runs_not_text(spark):
    common = [f"this line stands in all documents {i}" for i in range(5)]
    text = "\n".join([common[0], common[1], "own", common[2], "own", "own", common[3], common[4]])
    rows = [(d, text) for d in range(4)]
    out = {r.doc_id: r for r in L.line_bitmaps(frame(spark, rows)).collect()}
    assert set(out) == {0, 1, 2}  # the largest keeps its lines, so it has no bitmap
    assert [tuple(x) for x in out[0].cleared] == [(0, 2), (3, 1), (6, 2)] and out[0].n_dropped == 5
    assert set(out[0].asDict()) == {"doc_id", "text_hash", "n_dropped", "cleared"}


def test_hot_lines_and_a_very_long_text(spark):
    hot = "one line that a third of all rows hold"
    rows = [(d, f"{hot}\nown line number {d} of the documents\n{hot}") for d in range(9000)]
    rows.append((9000, "\n".join([hot, "z"] * 60_000 + [f"filler of the long text {i}" for i in range(20_000)])))
    df = frame(spark, rows).repartition(8)
    keys = df.select(F.explode(L.line_keys(F.col("text"))).alias("k"))
    assert len(L.hot_hashes(keys, ["k"])) == 2  # the line and the short one
    out = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.without_repeated_lines(df).collect()}
    assert out.pop(9000) == (140_000, 0) and set(out.values()) == {(3, 2)}


def test_empty_table_and_names(spark):
    empty = L.without_repeated_lines(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n_lines", "n_dropped", "cleared", "kept_text"]
    line = "some line that three documents hold"
    rows = frame(spark, [(i, line) for i in range(3)])
    odd = rows.selectExpr("*", "7 as N_LINES", "8 as _t", "9 as _bit_id", "10 as text_hash", "11 as cleared")
    out = L.without_repeated_lines(odd)
    assert out.columns == [*odd.columns, "n_lines_", "n_dropped", "cleared_", "kept_text"]
    for r in out.collect():
        assert (r.N_LINES, r._t, r._bit_id, r.text_hash, r.cleared) == (7, 8, 9, 10, 11)
        assert (r.n_lines_, r.n_dropped, r.kept_text) == ((1, 0, line) if r.doc_id == 2 else (1, 1, ""))
