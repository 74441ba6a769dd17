"""Rules of the table operators on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from durata.functions import clean as C
from durata.operators import bands as B
from durata.operators import episodes as I
from durata.operators import metrics as M
from durata.operators import periods as PP
from durata.operators import prepare as P
from durata.operators import ranking as R
from durata.operators import resample as S
from durata.operators import snapshots as N
from durata.operators import stats as G
from durata.operators import survival as K
from durata.sources import files


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_number_and_dates(spark):
    df = spark.createDataFrame([("1,234.5",), ("１２",), ("1d",), ("NaN",), ("inf",), ("",), (None,), ("-0.5",), ("abc",)], "x string")
    assert [r.v for r in df.select(C.number(F.col("x")).alias("v")).collect()] == [1234.5, 12.0, None, None, None, None, None, -0.5, None]
    df = spark.createDataFrame([("2020-02-30",), ("2020-02-29",), ("x",), (None,)], "x string")
    assert [r.v for r in df.select(C.day(F.col("x")).alias("v")).collect()] == [None, dt.date(2020, 2, 29), None, None]
    df = spark.createDataFrame([("201900",), ("201912.0",), ("20191",), ("2019-1",), (None,)], "x string")
    assert [r.v for r in df.select(C.year_month(F.col("x")).alias("v")).collect()] == [None, dt.date(2019, 12, 1), None, None, None]


def test_text_forms_agree(spark):
    df = spark.createDataFrame([("　ＬＤＫ　",), (None,), (" a b ",), ("Ｋ",)], "x string")
    rows = df.select(C.text(F.col("x")).alias("a"), C.text_nfkc(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == ["LDK", "", "a b", "K"]


def test_identifiers(spark):
    df = spark.createDataFrame([("0", "1"), (" NaN ", "1"), ("7", "<NA>"), (" 7 ", "2"), (None, "2")], "a string, b string")
    assert [r.k for r in df.select(C.entity_key(F.col("a"), F.col("b")).alias("k")).collect()] == [None, None, None, "7::2", None]


def test_prepare_adds_what_is_missing_and_refuses_what_it_needs(spark):
    df = spark.createDataFrame([("2020-01-01", "2020-01-05")], "pub_start_date string, pub_end_date string")
    r = P.prepare(df).first()
    assert (r.duration, r.rent, r.rent_missing, r.category_issue) == (4, None, True, "missing_kind")
    with pytest.raises(ValueError):
        P.prepare(df.drop("pub_end_date"))


def test_maximum_on_an_edge(spark):
    df = spark.createDataFrame([(0.0,), (40.0,), (-5.0,), (None,)], "x double")
    assert [(r.bin, r.lo, r.hi) for r in B.band_table(df, {"x": 20}).orderBy("bin").collect()] == [(0, 0.0, 20.0), (1, 20.0, 40.0), (2, 40.0, 60.0)]
    assert B.band_table(df, {"x": 20}, "ceil").count() == 2
    assert B.band_table(df.limit(0), {"x": 20}).count() == 1
    with pytest.raises(ValueError):
        B.band_table(df, {"x": 0})


def test_tied_modes(spark):
    s = G.exact_stats(spark.createDataFrame([(1,), (1,), (3,), (3,), (9,)], "v int"), "v")
    r = G.selected_stat(s, "mode").first()
    assert (r.modes, r.mode_ties, r.mode_freq, r.value, r.issue) == ("1|3", 2, 2, None, "tied: 1|3")
    assert G.selected_stat(s, "median").first().value == 3.0


def intervals(spark, rows):
    return spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(rows)], "row_id string, building_id string, unit_id string, layout string, area double, station string, start_date date, end_date date")


def test_episodes(spark):
    df = intervals(
        spark,
        [
            ("b", "1", "A", 20.0, "x", day(0), day(10)), ("b", "1", "A", 20.0, "y", day(5), day(6)), ("b", "1", "A", 20.0, "x", day(11), day(20)),
            ("b", "1", "A", 20.0, "x", day(40), day(50)), ("b", "2", "A", 20.0, "x", day(0), day(10)), ("b", "2", "B", 20.0, "x", day(5), day(12)),
            (None, "1", "A", 20.0, "x", day(0), day(5)), ("0", "1", "A", 20.0, "x", day(0), day(5)), ("c", "1", "A", 20.0, "x", day(9), day(5)),
        ],
    )
    got = sorted((r.entity or "", str(r.start_date), str(r.end_date), r.rows, r.status) for r in I.episodes(df).collect())
    d = lambda n: str(day(n))
    assert got == sorted([("b::1", d(0), d(20), 3, "merged"), ("b::1", d(40), d(50), 1, "single"), ("b::2", d(0), d(10), 1, "conflicting_metadata"), ("b::2", d(5), d(12), 1, "conflicting_metadata"), ("", d(0), d(5), 1, "missing_id"), ("", d(0), d(5), 1, "missing_id")])
    audit = {(r.key, r.segment): (r.blocked, r.secondary_differs) for r in I.audit(I.segments(df)).collect()}
    assert {r.gap: (r.rows, r.episodes, r.segments, r.blocked) for r in I.sensitivity(df, [0, 1]).collect()} == {0: (8, 7, 4, 1), 1: (8, 6, 3, 1)}
    assert audit == {("b::1", 0): (False, True), ("b::1", 1): (False, False), ("b::2", 0): (True, False)}
    assert sorted(map(str, I.episodes(df.repartition(7)).collect())) == sorted(map(str, I.episodes(df).collect()))


def test_area_may_differ_by_two(spark):
    df = intervals(spark, [("b", u, "A", 20.0, "x", day(0), day(9)) for u in "12"] + [("b", "1", "A", 22.0, "x", day(3), day(9)), ("b", "2", "A", 22.5, "x", day(3), day(9))])
    assert sorted(r.status for r in I.episodes(df).collect()) == ["conflicting_metadata", "conflicting_metadata", "merged"]
    unknown = intervals(spark, [("不明", "1", "A", 20.0, "x", day(0), day(9)), ("不明", "1", "A", 20.0, "x", day(3), day(9))])
    assert [r.status for r in I.episodes(unknown).collect()] == ["missing_id", "missing_id"]


def test_bands_and_kinds_are_the_studies(spark):
    df = spark.createDataFrame([(d, float(a)) for d, a in zip([0, 6, 7, 13, 14, 29, 30, 59, 60, 89, 90, 179, 180, 364, 365], [0, 9, 10, 19, 20, 29, 30, 39, 40, 50, 60, 70, 80, 90, -1])], "d int, a double")
    rows = df.select("d", "a", PP.time_band(F.col("d")).alias("t"), PP.age_band(F.col("a")).alias("g")).orderBy("d").collect()
    assert [r.t for r in rows] == ["0-6", "0-6", "7-13", "7-13", "14-29", "14-29", "30-59", "30-59", "60-89", "60-89", "90-179", "90-179", "180-364", "180-364", "365+"]
    assert [r.g for r in rows] == ["0-10", "0-10", "10-20", "10-20", "20-30", "20-30", "30-40", "30-40", "40+", "40+", "40+", "40+", "40+", "40+", None]
    kinds = spark.createDataFrame([("2", k) for k in "R K DK LK LDK SK SDK SLDK SLK".split()], "n string, k string")
    assert [r.c for r in kinds.select(C.category(F.col("n"), F.col("k"), P.KINDS).alias("c")).collect()] == ["2R", "2K", "2DK", "2LK", "2LDK", "2SK", "2SDK", "2SLDK", None]


def test_unknown_keys_have_no_history(spark):
    df = spark.createDataFrame([("r1", "k", day(0), day(5)), ("r2", "k", day(9), day(12)), ("r3", None, day(0), day(2)), ("r4", None, day(4), day(5))], "row_id string, k string, start_date date, end_date date")
    assert {r.row_id: (r.recent, r.prev_length, r.prev_gap) for r in N.look_back(df, ["k"]).collect()} == {"r1": (0, None, None), "r2": (1, 5, 4), "r3": (0, None, None), "r4": (0, None, None)}
    assert P.search(df, {"k": "k"}, {}, "R2", ["row_id"]).count() == 1


def test_survival(spark):
    df = spark.createDataFrame([("a", day(0), day(3)), ("a", day(0), day(5)), ("a", day(0), None), ("a", day(0), day(10)), ("b", day(9), day(30))], "g string, start_date date, end_date date")
    c = K.censored_at(df, day(10))
    assert sorted((r.t, r.event) for r in c.collect()) == [(1, 0), (3, 1), (5, 1), (10, 0), (10, 0)]
    curve = K.km_curve(c, ["g"])
    assert {(r.g, r.day): round(r.s, 6) for r in K.survival_at(curve, [0, 3, 7], ["g"]).collect()} == {("a", 0): 1.0, ("a", 3): 0.75, ("a", 7): 0.5, ("b", 0): 1.0, ("b", 3): 1.0, ("b", 7): 1.0}
    assert {(r.g, r.share): r.t for r in K.quantile_times(curve, [0.5, 0.9], ["g"]).collect()} == {("a", 0.5): 5, ("a", 0.9): None, ("b", 0.5): None, ("b", 0.9): None}
    points = spark.createDataFrame([("a", 3), ("a", 20), ("z", 3)], "g string, e int")
    got = {(r.g, r.e): r.p for r in K.two_level(points, c, "e", 4, ["g"]).collect()}
    assert round(got["a", 3], 6) == round(1 - 0.5 / 0.75, 6) and got["a", 20] == 0.0 and got["z", 3] is not None


def test_nothing_after_the_cutoff_is_seen(spark):
    df = spark.createDataFrame([(day(0), day(5)), (day(0), day(50)), (day(20), day(25))], "start_date date, end_date date")
    got = K.known_at(df, day(10))
    assert sorted((r.t, r.event) for r in got.collect()) == [(5, 1), (10, 0)]


def test_person_periods(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 2, 0), ("c", 0, 1)], "row_id string, t int, event int")
    pp = PP.person_periods(df)
    assert pp.count() == 8 and pp.agg(F.sum("event_in_day")).first()[0] == 2
    r = PP.validate_periods(df, pp, "row_id").first()
    assert (r.rows, r.period_rows, r.without_periods, r.wrong_days, r.wrong_events, r.wrong_range, r.event_not_last) == (3, 8, 0, 0, 0, 0, 0)
    assert PP.person_periods(df, cap=1).agg(F.sum("event_in_day")).first()[0] == 1
    with pytest.raises(Exception, match="negative"):
        PP.person_periods(df.withColumn("t", F.lit(-1))).collect()
    a = PP.sampled_periods(df, "row_id", 0.5).collect()
    assert sorted(map(str, a)) == sorted(map(str, PP.sampled_periods(df.repartition(3), "row_id", 0.5).collect()))


def test_unknown_targets_are_left_out(spark):
    df = spark.createDataFrame([("a", 10, 1), ("b", 10, 0), ("c", 30, 0), ("d", 5, 1)], "row_id string, t int, event int")
    got = {(r.row_id, r.target) for r in PP.landmark_labels(df, [7], [7]).collect()}
    assert got == {("a", 1), ("c", 0)}


def test_snapshot_refuses_unknown_targets(spark):
    df = intervals(spark, [("b", "1", "A", 20.0, "x", day(0), day(10))])
    with pytest.raises(ValueError):
        N.snapshot(df, [day(5)], [30], day(30))
    r = N.snapshot(df, [day(0), day(9), day(10)], [7], day(100)).collect()
    assert sorted((x.elapsed_day, x.target_7) for x in r) == [(0, 0), (9, 1)]


def test_active_count_equals_pairs(spark):
    import random

    rng = random.Random(1)
    rows = [("b", "1", rng.choice("AB"), 1.0, "x", day(a := rng.randint(0, 30)), day(a + rng.randint(0, 9))) for _ in range(80)]
    got = {r.row_id: r.active for r in N.active_count(intervals(spark, rows), ["layout"]).collect()}
    for i, r in enumerate(rows):
        live = sum(o[2] == r[2] and o[5] <= r[5] < o[6] for j, o in enumerate(rows) if j != i)
        assert got[f"r{i}"] == live


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.3, 1)], "g string, p double, y int")
    assert {r.g: r.auc for r in R.auc(df, ["g"], "p", "y").collect()} == {"a": 0.875, "b": None}
    assert round(M.roc(df, "p", "y").agg(F.max("area")).first()[0], 9) == round(R.auc(df, [], "p", "y").first().auc, 9)


def test_priority_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)], "id int, p double").withColumn("g", F.lit(1))
    assert {r.id: r.half for r in R.priority(df, ["g"], "p").collect()} == {1: "high", 2: "tied", 3: "tied", 4: "low"}


def test_pair_value_equals_pairs(spark):
    rows = [(i % 3, p, y) for i, (p, y) in enumerate([(0.1, 0), (0.9, 1), (0.4, 1), (0.6, 0), (0.7, 1), (0.2, 0), (0.8, 0), (0.3, 1), (0.95, 1)])]
    r = M.pair_value(spark.createDataFrame(rows, "s int, p double, y int"), ["s"], "p", "y", [0.5]).first()
    wins = losses = pairs = 0
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[0] == b[0]:
                pairs += 1
                hi, lo = (a, b) if a[1] >= 0.5 > b[1] else (b, a) if b[1] >= 0.5 > a[1] else (None, None)
                if hi:
                    wins += hi[2] > lo[2]
                    losses += hi[2] < lo[2]
    assert (r.pairs, r.wins, r.losses) == (pairs, wins, losses)


def test_bootstrap_is_the_same_under_any_partitioning(spark):
    df = spark.createDataFrame([(f"c{i % 17}", i % 2, (i * 7) % 3 % 2) for i in range(200)], "c string, hi int, y int")
    a = S.bootstrap_ratio(df, "c", F.col("y"), F.lit(1), 50).first()
    b = S.bootstrap_ratio(df.repartition(9), "c", F.col("y"), F.lit(1), 50).first()
    assert a == b and a.low <= a.estimate <= a.high and a.replicates == 50
    assert S.bootstrap_gap(df, "c", "hi", "y", 30).count() == 1


def test_files(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\tb\n1\tx\n２\ty\n", encoding="utf-8")
    df = files.read_text_table(spark, str(p), ["a", "b"], keep=["a"])
    assert df.columns == ["a"] and [r.a for r in df.collect()] == ["1", "２"]
    out = str(tmp_path / "out.csv")
    files.save_csv(df, out)
    with pytest.raises(Exception, match="(?i)exist"):
        files.save_csv(df, out)
    assert files.load_prepared(spark, out, df.schema).count() == 2
    with pytest.raises(ValueError):
        files.load_prepared(spark, out)
    built = []
    for _ in range(2):
        assert files.reuse(spark, str(tmp_path / "kept"), lambda: built.append(1) or df).count() == 2
    assert built == [1]
    assert P.fingerprint(df).first() == P.fingerprint(df.repartition(3)).first()


def test_model_is_saved_and_scores_unseen_values(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from durata.operators import hazard as H

    rows = [(f"r{i}", (i * 13) % 20, int(i % 3 > 0), 100.0 + i % 7, 20.0, None if i % 5 == 0 else 3.0, 1.0, "AB"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id string, t int, event int, rent double, area double, walk_distance double, age double, layout string")
    model = H.fit_hazard(PP.features(PP.person_periods(df)))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    new = df.limit(5).withColumns({"layout": F.lit("Z"), "elapsed": F.lit(2)})
    a = {r.row_id: r.p for r in H.horizon_risk(model, new, ["row_id"], "elapsed", 7).collect()}
    b = {r.row_id: r.p for r in H.horizon_risk(again, new, ["row_id"], "elapsed", 7).collect()}
    assert a == b and all(0 < p < 1 for p in a.values())
    boosted = H.boosted_hazard(PP.features(PP.person_periods(df)), "row_id", H.NUMERIC, H.CATEGORIES, rounds=3, depth=2, least=5)
    assert H.horizon_risk(boosted, new, ["row_id"], "elapsed", 7).count() == 5


def test_sessions_stream_and_batch(spark, tmp_path):
    from durata.streaming.sessions import sessions

    rows = [("a", dt.datetime(2024, 1, 1, 0, m)) for m in (0, 5, 50)] + [("b", dt.datetime(2024, 1, 1, 9))]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp")
    want = {("a", 2), ("a", 1), ("b", 1)}
    assert {(r.user_id, r.events) for r in sessions(df, gap="10 minutes").collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), gap="10 minutes")
    q = stream.writeStream.format("memory").queryName("sessions_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.events) for r in spark.table("sessions_out").collect()} == want


def test_hazards_fit_on_all_days(spark, monkeypatch):
    from durata.operators import hazard
    from durata.plans import q_time

    seen = []
    monkeypatch.setattr(hazard, "fit_hazard", lambda periods, *a, **k: seen.append(periods))
    rows, _ = q_time._trained(spark, "/root/testdata/sf0.001")
    train = K.known_at(rows, dt.date(2000, 1, 1)).filter(F.year("start_date").isin(1998, 1999))
    assert seen[0].count() == train.agg(F.sum(F.col("t") + 1)).first()[0]


def test_extract_and_source(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\tb\n" + "".join(f"{i}\tx\n" for i in range(9)))
    df = files.read_text_table(spark, str(p), ["a", "b"], keep=["a"], source=True)
    assert [(r.a, r.source_file, r.source_row) for r in df.collect()] == [(str(i), "t.tsv", i) for i in range(9)]
    files.extract(df, F.col("a") > "5", str(tmp_path / "x"), {"region": "r"})
    assert spark.read.parquet(str(tmp_path / "x" / "rows")).count() == 3
    assert spark.read.json(str(tmp_path / "x" / "about")).first().asDict() == {"region": "r", "seen": 9, "kept": 3}
    files.save_json(df.select("a"), str(tmp_path / "j"))
    assert files.load_json(spark, str(tmp_path / "j"), df.select("a").schema).count() == 9


def test_scores_fall_back_on_the_past(spark):
    from durata.operators import hazard as H

    requests = spark.createDataFrame([(1, "g"), (2, "h"), (3, "z")], "id int, g string")
    groups = spark.createDataFrame([("g", 9, 0.4), ("h", 2, 0.9)], "g string, n long, rate double")
    risk = spark.createDataFrame([(1, 0.2)], "id int, p double")
    out = H.scored_or_historical(requests, risk, groups, ["id"], ["g"], 3).orderBy("id").collect()
    assert [(r["mode"], r.risk, r.level, r.rate, r.status) for r in out] == [("model", 0.2, "hi", 0.4, "ok"), ("historical", None, None, None, "insufficient_data"), ("historical", None, None, None, "insufficient_data")]
    assert {r["mode"] for r in H.scored_or_historical(requests, None, groups, ["id"], ["g"], 3).collect()} == {"historical"}
    assert [r.g for r in H.frequent_or_other(requests.unionByName(requests.limit(1)), "g", 1).orderBy("id").collect()] == ["g", "g", "other", "other"]


def test_many_bands_are_refused(spark):
    with pytest.raises(Exception, match="bands"):
        B.band_table(spark.createDataFrame([(1e12,)], "x double"), {"x": 1}).count()


def test_running_sums_in_ranges(spark):
    from durata.operators.ordered import running

    rows = [(float(v) if v else None, v % 7) for v in [*range(0, 3000, 3)]]
    for down in (False, True):
        got = {r.v: (r.a, r.b) for r in running(spark.createDataFrame(rows, "v double, n int").repartition(5), "v", {"a": "n", "b": F.lit(1)}, down, ranges=9).collect()}
        order = sorted(rows, key=lambda r: -1.0 if r[0] is None else r[0], reverse=down)
        assert got == {v: (sum(n for _, n in order[:i]), i) for i, (v, _) in enumerate(order)}
    assert running(spark.createDataFrame([], "v double, n int"), "v", {"a": "n"}).collect() == []


def test_thinned_curve(spark):
    curve = spark.range(1001).select(F.col("id").alias("score"), (F.col("id") / 1000).alias("fpr"), (F.col("id") / 1000).alias("tpr"))
    assert M.thin(curve, 10).count() == 11


def test_bounded_periods(spark):
    df = spark.createDataFrame([(i, 9, i % 2) for i in range(200)], "row_id long, t int, event int")
    whole = PP.bounded_periods(df, "row_id", cap=50)
    assert whole.count() == 2000 and whole.filter("weight <> 1").isEmpty()
    some = PP.bounded_periods(df, "row_id", cap=50, most=950)
    assert some.filter("event_in_day = 1").count() == 100 and 800 < some.filter("event_in_day = 0").count() < 1100
    assert PP.bounded_periods(df.limit(0), "row_id").isEmpty()


def test_live_counts_at_any_day(spark):
    from durata.operators import snapshots as N

    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 5), ("a", 5, 9), ("a", 4, 4), ("a", None, 9), (None, 1, 3)], "g string, s int, e int")
    rows = rows.select("g", F.date_from_unix_date("s").alias("start_date"), F.date_from_unix_date("e").alias("end_date"))
    asked = [("a", 0), ("a", 3), ("a", 4), ("a", 5), ("a", 8), ("a", 9), ("a", -1), ("b", 3), (None, 2), (None, 3), ("a", None), ("a", 3)]
    q = spark.createDataFrame([(g, d, i) for i, (g, d) in enumerate(asked)], "g string, d int, _c int").withColumn("day", F.date_from_unix_date("d"))
    out = {r["_c"]: r.live for r in N.live_at(rows, q, ["g"], "day").collect()}
    assert [out[i] for i in range(len(asked))] == [1, 2, 2, 1, 1, 0, 0, 0, 1, 0, None, 2]
    assert N.live_at(rows.limit(0), q, ["g"], "day").filter("live > 0").isEmpty()


def test_changed_input_is_refused(spark, tmp_path):
    from durata.sources import files

    df = spark.range(200).select("id", (F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 3 > 0, F.lit("é")).alias("s"))
    mark = files.save_marked(df, str(tmp_path / "t"))
    assert mark == P.fingerprint(df.repartition(7).orderBy(F.desc("id"))).first().asDict() == files.marked(spark, str(tmp_path / "t"))
    assert files.load_same(spark, str(tmp_path / "t")).count() == 200
    P.require_same(P.fingerprint(df.select("s", "x", "id")).first().asDict(), mark)
    lost, other = df.filter("id <> 7"), df.withColumn("x", F.when(F.col("id") == 7, 0.1).otherwise(F.col("x")))
    swapped = df.withColumn("s", F.when(F.col("id") % 3 != 1, F.lit("é")))
    for changed, text in ((lost, "200 rows before, 199 now"), (other, "other values"), (swapped, "other values"), (df.limit(0), "0 now")):
        with pytest.raises(ValueError, match=text):
            P.require_same(P.fingerprint(changed).first().asDict(), mark)
    pair = spark.createDataFrame([("ab", None), (None, "ab"), ("a", "b")], "p string, q string")
    assert len({P.fingerprint(pair.filter(c)).first().content for c in ("q is null", "p is null", "p = 'a'")}) == 3
    kept = str(tmp_path / "kept")
    built = lambda: df.groupBy("s").count()
    assert files.reuse(spark, kept, built, df).count() == files.reuse(spark, kept, built, df.repartition(3)).count() == 2
    with pytest.raises(ValueError, match="199 now"):
        files.reuse(spark, kept, built, lost)
    files.reuse(spark, str(tmp_path / "plain"), built)
    with pytest.raises(ValueError, match="does not tell"):
        files.reuse(spark, str(tmp_path / "plain"), built, df)
    df.write.mode("overwrite").parquet(str(tmp_path / "t"))
    lost.write.mode("overwrite").parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="the table"):
        files.load_same(spark, str(tmp_path / "t"))


def test_rows_live_at_no_date_go_before_the_join(spark):
    left = spark.createDataFrame([(i, day(i), day(i + 2)) for i in range(20)], "k int, start_date date, end_date date")
    rows = left.join(spark.range(20).select(F.col("id").cast("int").alias("k")).hint("merge"), "k")
    out = N.snapshot(rows, [day(5), day(12)], [2], day(100))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "end_date" in plan[plan.index("Join") :].split("Filter", 1)[1].split("\n")[0]
    assert sorted((r.k, r.snapshot) for r in out.collect()) == [(4, day(5)), (5, day(5)), (11, day(12)), (12, day(12))]


def test_a_cut_above_all_scores_catches_null(spark):
    from durata.operators import metrics as M

    r = M.threshold_sweep(spark.createDataFrame([(0.1, 1), (0.3, 0)], "p double, y int"), [], "p", "y", [0.2, 0.9]).orderBy("cut").collect()
    assert [(x.n_hi, x.rate_hi, x.rate_lo, x.capture, x.gap) for x in r] == [(1, 0.0, 1.0, 0.0, -1.0), (0, None, 0.5, None, None)]


def test_cuts_of_several_numbers_of_tiers_come_from_one_table(spark):
    from durata.operators import metrics as M

    rows = spark.range(500).select((F.col("id") / 500).alias("p"), (F.col("id") * 7 % 500 < F.col("id")).cast("int").alias("y"))
    each = {r.tiers: tuple(r)[1:] for r in M.best_cuts_each(rows, "p", "y", [2, 3, 4]).collect()}
    assert each == {k: tuple(M.best_cuts(rows, "p", "y", k).first()) for k in (2, 3, 4)}


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    from durata.sources.scratch import stored

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    table = stored(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and table.count() == 7
