"""Hazard models: values against closed forms, exploded days and planted effects."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from durata.operators import hazard as H
from durata.operators import periods as PP
from durata.plans import q_time
from durata.plans.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    """Kind B ends three times as fast as A; walk_distance has nulls, and there is a kind that training does not see."""
    df = spark.range(900).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 2).alias("g"), F.rand(7).alias("u"))
    t = F.floor(F.log("u") / F.log(F.when(F.col("g") == 1, 0.7).otherwise(0.9)))
    return df.withColumns({
        "t": F.least(t, F.lit(60)).cast("int"), "event": (t <= 60).cast("int"), "layout": F.when(F.col("g") == 1, "B").otherwise("A"), "rent": 50 + F.col("u") * 0, "area": F.lit(20.0),
        "walk_distance": F.when(F.col("row_id").cast("int") % 5 > 0, (F.col("row_id").cast("int") % 7).cast("double")), "age": F.lit(None).cast("double"), "city": F.lit("x"), "station": F.lit("y"), "start_month": F.lit(1),
    }).cache()


@pytest.fixture(scope="module")
def model(rows):
    return H.fit_hazard(PP.features(PP.person_periods(rows)), strength=1e6)


def exploded(model, asked, horizon):
    """The long way: a row a day, and the product over them."""
    daily = PP.features(PP.future_days(asked, F.col("elapsed"), horizon))
    return {r.row_id: r.p for r in PP.end_probability(H.hazard_of(model, daily), ["row_id"], "hazard").collect()}


def test_fold_equals_exploded_days_without_a_shuffle(spark, rows, model, capsys):
    asked = rows.withColumns({"elapsed": (F.col("row_id").cast("int") % 30).cast("int"), "layout": F.when(F.col("row_id") == "7", "unseen").when(F.col("row_id") != "8", F.col("layout"))})
    out = H.horizon_risk(model, asked, ["row_id"], "elapsed", 9)
    got, want = {r.row_id: r.p for r in out.collect()}, exploded(model, asked, 9)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    out.explain()
    assert "Exchange" not in capsys.readouterr().out
    tree = H.boosted_hazard(PP.features(PP.person_periods(rows)), "row_id", rounds=6, least=50, held=0.0)
    out = H.horizon_risk(tree, asked, ["row_id"], "elapsed", 9)
    got, want = {r.row_id: r.p for r in out.collect()}, exploded(tree, asked, 9)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_closed_form_of_a_one_feature_model(spark):
    # one category and no penalty: the fitted hazard of a kind is its share of ending days
    df = spark.createDataFrame([("a", "A", 3, 1), ("b", "A", 1, 1), ("c", "A", 5, 0), ("d", "B", 0, 1), ("e", "B", 1, 1)], "row_id string, category string, t int, event int")
    periods = PP.person_periods(df)
    model = H.fit_hazard(periods.withColumn("zero", F.lit(0.0)), ["zero"], ["category"], strength=1e9)
    got = {r.category: r.hazard for r in H.hazard_of(model, periods.withColumn("zero", F.lit(0.0)), ["zero"]).select("category", "hazard").distinct().collect()}
    assert got["A"] == pytest.approx(2 / 12, abs=1e-4) and got["B"] == pytest.approx(2 / 3, abs=1e-4)
    asked = df.withColumns({"zero": F.lit(0.0), **{c: F.lit(1.0) for c in ("rent", "area", "age")}, "layout": F.col("category"), "elapsed": F.lit(0)})
    p = {r.category: r.p for r in H.horizon_risk(model, asked, ["category"], "elapsed", 4, ["zero"]).distinct().collect()}
    assert p["A"] == pytest.approx(1 - (10 / 12) ** 4, abs=1e-3) and p["B"] == pytest.approx(1 - (1 / 3) ** 4, abs=1e-3)


def test_a_planted_effect_is_found(rows, model):
    out = H.evaluate(model, rows, "row_id", [0, 3], [2, 6]).collect()
    assert len(out) == 4 and all(r.auc > 0.6 for r in out)
    assert all(abs(r.predicted - r.actual) < 0.08 for r in out)
    asked = rows.withColumn("elapsed", F.lit(2))
    by = lambda h: {r.g: r.p for r in H.horizon_risk(model, asked, ["g"], "elapsed", h).groupBy("g").agg(F.avg("p").alias("p")).collect()}
    near, far = by(3), by(10)
    assert near[1] == pytest.approx(1 - 0.7**3, abs=0.08) and near[0] == pytest.approx(1 - 0.9**3, abs=0.08)
    assert all(far[g] > near[g] for g in far)


def test_medians_fill_and_are_exact(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (10.0, None), (None, None)], "a double, b double")
    assert H.medians(df, ["a", "b"]) == {"a": 2.0, "b": 0.0}


@pytest.fixture(scope="module")
def known(spark):
    rows = q_time._aged(q_time.intervals(spark, SF))
    live = q_time.N.snapshot(rows, [dt.date(2000, 4, 1)], [14], q_time.OBS_END)
    return {r.row_id: r for r in live.collect()}


@pytest.mark.parametrize("name", ["p06_p11_hazard_risk", "p08_boosted_hazard"])
def test_risks_of_the_queries(spark, known, name):
    got = {r.row_id: r.p for r in queries()[name](spark, SF).collect()}
    assert set(got) == set(known) and all(0 < p < 1 for p in got.values())
    target = [(got[k], known[k].target_14) for k in got]
    pos, neg = [p for p, y in target if y], [p for p, y in target if not y]
    better = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert better > 0.55  # the time that has gone by tells the ends apart, which a constant cannot


def test_live_risk_chains_the_model_into_the_decision(spark, known):
    got = {r.row_id: r for r in queries()["l05_live_risk"](spark, SF).collect()}
    model = {r.row_id: r.p for r in queries()["p06_p11_hazard_risk"](spark, SF).collect()}
    assert set(got) == set(known) and {r["mode"] for r in got.values()} == {"model", "historical"}
    rows = q_time._aged(q_time.intervals(spark, SF))
    past = q_time.N.snapshot(rows, [dt.date(1999, 4, 1), dt.date(1999, 8, 1)], [14], q_time.OBS_END).collect()
    for k, r in got.items():
        group = [x.target_14 for x in past if (x.city, x.layout) == (r.city, r.layout)]
        assert (r.rate, r.status) == ((pytest.approx(sum(group) / len(group)), "ok") if len(group) >= 4 else (None, "insufficient_data"))
        if known[k].walk_distance is None or known[k].layout == "R":
            assert (r["mode"], r.risk, r.level) == ("historical", None, None)
        else:
            assert (r["mode"], r.risk, r.level) == ("model", pytest.approx(model[k], abs=2e-6), "hi" if r.risk >= 0.5 else "lo")


def test_live_risk_of_odd_requests(spark, rows, model, capsys):
    asked = rows.filter("row_id in ('3', '4')").withColumns({"elapsed_day": F.when(F.col("row_id") == "3", 2), "category": F.lit("own column"), "p": F.lit(9)})
    asked = asked.unionByName(asked)
    groups = spark.createDataFrame([("x", 9, 0.4)], "city string, n long, rate double")
    out = H.live_risk(model, asked, groups, ["city"], 3)
    assert sorted((r.row_id, r["mode"], r.category, r.p, r.rate) for r in out.collect()) == sorted(2 * [("3", "model", "own column", 9, 0.4), ("4", "historical", "own column", 9, 0.4)])
    assert out.filter("risk is not null").select("risk").distinct().count() == 1
    assert {r["mode"] for r in H.live_risk(model, asked, groups, ["city"], 3, F.lit(None).cast("boolean")).collect()} == {"historical"}
    assert [(r.risk, r.status) for r in H.live_risk(None, asked.limit(1), groups, ["city"], 30).collect()] == [(None, "insufficient_data")]
    assert H.live_risk(model, asked.limit(0), groups, ["city"], 3).collect() == []


@pytest.mark.parametrize("name", ["p07_city_hazard", "p14_evaluate_hazard", "p17_scope_comparison"])
def test_scores_of_the_queries(spark, name):
    out = queries()[name](spark, SF).collect()
    by = {}
    for r in out:
        assert r.n > 0 and 0 <= r.brier <= 1 and abs(r.predicted - r.actual) < 0.15 and 0 <= r.auc <= 1
        assert r.brier < 0.27
        if name != "p17_scope_comparison":
            by.setdefault(r.landmark, []).append((r.horizon, r.predicted, r.actual))
    for own in by.values():  # longer horizons hold more ends
        assert [p for _, p, _ in sorted(own)] == sorted(p for _, p, _ in own)
    if name == "p17_scope_comparison":
        assert len({round(r.predicted, 6) for r in out}) > 1 and len({r.n for r in out}) == 1


@pytest.mark.parametrize("name", ["p07_city_hazard", "p17_scope_comparison"])
def test_scores_come_from_all_days(spark, monkeypatch, name):
    figures = lambda: {tuple(r)[:2]: tuple(r)[2:] for r in queries()[name](spark, SF).collect()}
    whole, bounded = figures(), PP.bounded_periods
    monkeypatch.setattr(PP, "bounded_periods", lambda df, key: bounded(df, key, most=500))  # as if the table were much larger
    again = figures()
    assert set(again) == set(whole) and all(again[k] == pytest.approx(whole[k], abs=2e-6) for k in whole)


def test_trees_come_from_all_days(spark, monkeypatch):
    risks = lambda: {r.row_id: r.p for r in queries()["p08_boosted_hazard"](spark, SF).collect()}
    whole, bounded = risks(), PP.bounded_periods
    monkeypatch.setattr(PP, "bounded_periods", lambda df, key: bounded(df, key, most=500))  # as if the table were much larger
    assert risks() == whole


def test_static_classifier_of_the_query(spark):
    out = queries()["p09_static_classifier"](spark, SF).collect()
    assert out and all(0 < r.p < 1 for r in out) and len({r.p for r in out}) > len(out) / 2
    assert not math.isnan(sum(r.p for r in out))


def test_selection_finds_the_informed_model_and_tests_once(spark, rows, tmp_path):
    from durata.operators.selection import load_model, save_model, select_model

    part = lambda k: rows.filter(F.col("row_id").cast("int") % 3 == k)
    fits = {"blind": lambda p: H.fit_hazard(p, ["time_day"], ["time_band"]), "kind": lambda p: H.fit_hazard(p, ["time_day"], ["time_band", "category"])}
    asked, fitted = [], []
    fits = {name: (lambda p, f=f, name=name: fitted.append(name) or f(p)) for name, f in fits.items()}
    found = select_model(part(0), part(1), lambda: asked.append(list(fitted)) or part(2), fits, "row_id", [0, 2], [2, 5])
    assert found.winner == "kind" and found.mean_brier["kind"] < found.mean_brier["blind"]
    assert asked == [["blind", "kind", "kind"]]  # the test rows are read once, after the winner was refit
    out = {(r.model, r.part): r.n for r in found.scores.groupBy("model", "part").agg(F.count("*").alias("n")).collect()}
    assert out == {("blind", "validation"): 4, ("kind", "validation"): 4, ("kind", "test"): 4}
    source = part(0).unionByName(part(1)).select("row_id", "t", "event")
    save_model(found.model, str(tmp_path / "m"), source)
    again = load_model(str(tmp_path / "m"), source.repartition(2))
    same = lambda m: sorted((r.row_id, r.p) for r in H.horizon_risk(m, part(2).withColumn("elapsed", F.lit(1)), ["row_id"], "elapsed", 3).collect())
    assert same(again) == same(found.model)
    with pytest.raises(ValueError, match="has changed"):
        load_model(str(tmp_path / "m"), source.filter("row_id <> '1'"))


def test_selection_of_whole_rows_multiplies_nothing_out(spark, monkeypatch):
    from durata.operators import selection

    unread = lambda df, cap=None, own=PP.person_periods: own(df, cap).filter(F.raise_error(F.lit("multiplied out")).isNull())
    monkeypatch.setattr(PP, "person_periods", unread)
    monkeypatch.setattr(selection, "person_periods", unread)
    assert len(queries()["p15_model_selection"](spark, SF).collect()) == 16
    with pytest.raises(ValueError, match="cap"):
        selection.select_model(None, None, None, {"a": None}, "row_id", [7], [7], 179, whole=True)


def test_selection_of_the_query(spark):
    out = queries()["p15_model_selection"](spark, SF).collect()
    means = {}
    for r in out:
        assert 0 <= r.brier <= 0.27 and r.n > 0
        if r.part == "validation":
            means.setdefault(r.model, []).append(r.brier)
    assert {k: len(v) for k, v in means.items()} == {"time": 4, "category": 4, "all": 4}
    winner = min(means, key=lambda m: (sum(means[m]), m))
    assert {(r.model, r.part) for r in out if r.part == "test"} == {(winner, "test")}
