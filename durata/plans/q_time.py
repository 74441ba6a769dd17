"""Queries of episodes, survival, person-periods and snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.clean import years_between
from ..operators import episodes as I
from ..operators import periods as PP
from ..operators import snapshots as N
from ..operators import survival as K
from ..operators.prepare import frequent_keys
from ..sources.scratch import scratch, stored
from ..sources.views import intervals
from .registry import query

OBS_END = dt.date(2001, 10, 1)
_r = lambda c, k=9: F.round(c, k)

_SEG = """
seg0 AS (SELECT *, CASE WHEN building_id <> '0' THEN building_id || '::' || unit_id END AS key, coalesce(key, 'row ' || row_id) AS part FROM iv),
seg1 AS (SELECT *, g.gap AS gap, max(end_date) OVER (PARTITION BY g.gap, part ORDER BY start_date, end_date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM seg0, (SELECT unnest({gaps})::INT AS gap) g),
seg2 AS (SELECT *, sum(CASE WHEN start_date > latest + gap THEN 1 ELSE 0 END) OVER (PARTITION BY gap, part ORDER BY start_date, end_date, row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM seg1),
aud AS (SELECT gap, key, part, segment, count(*) AS rows, min(start_date) AS start_date, max(end_date) AS end_date, count(DISTINCT layout) > 1 AS category_conflict, max(area) - min(area) > 0.5 AS area_conflict, count(DISTINCT station) > 1 AS secondary_differs FROM seg2 GROUP BY gap, key, part, segment),
epi AS (SELECT s.gap, s.key AS entity, min_by(s.row_id, (s.start_date, s.end_date, s.row_id)) AS row_id, min_by(s.layout, (s.start_date, s.end_date, s.row_id)) AS layout, min(s.start_date) AS start_date, max(s.end_date) AS end_date, count(*) AS rows, bool_or((category_conflict OR area_conflict) AND s.key IS NOT NULL) AS blocked
        FROM seg2 s JOIN aud a ON a.gap = s.gap AND a.part = s.part AND a.segment = s.segment GROUP BY s.gap, s.key, s.part, s.segment, CASE WHEN category_conflict OR area_conflict THEN s.row_id END)
"""
_ONE, _FOUR = _SEG.format(gaps="[1]"), _SEG.format(gaps="[0, 1, 7, 14]")


@query(f"WITH {_ONE} SELECT row_id, segment FROM seg2")
def i01_segments(spark, d):
    return I.segments(intervals(spark, d)).select("row_id", "segment")


@query(f"WITH {_ONE} SELECT key, segment, rows, start_date, end_date, category_conflict, area_conflict, secondary_differs, category_conflict OR area_conflict AS blocked FROM aud WHERE key IS NOT NULL")
def i02_i05_segment_audit(spark, d):
    return I.audit(I.segments(intervals(spark, d)), 0.5).drop("gap")


@query(f"WITH {_ONE} SELECT entity, row_id, layout, start_date, end_date, (end_date - start_date)::INT AS duration, rows, CASE WHEN entity IS NULL THEN 'missing_id' WHEN blocked THEN 'conflicting_metadata' WHEN rows > 1 THEN 'merged' ELSE 'single' END AS status FROM epi")
def i03_i04_episodes(spark, d):
    return I.episodes(intervals(spark, d), area_tolerance=0.5).select("entity", "row_id", "layout", "start_date", "end_date", "duration", "rows", "status")


@query(f"WITH {_FOUR} SELECT e.gap, e.rows::BIGINT AS rows, episodes, merged, segments, several, blocked, round(days / episodes, 6) AS mean_days FROM (SELECT gap, sum(rows) AS rows, count(*) AS episodes, count(*) FILTER (NOT blocked AND rows > 1) AS merged, sum(end_date - start_date)::DOUBLE AS days FROM epi GROUP BY gap) e JOIN (SELECT gap, count(*) AS segments, count(*) FILTER (rows > 1) AS several, count(*) FILTER (category_conflict OR area_conflict) AS blocked FROM aud WHERE key IS NOT NULL GROUP BY gap) a ON a.gap = e.gap")
def i06_gap_sensitivity(spark, d):
    return I.sensitivity(intervals(spark, d), area_tolerance=0.5).withColumn("mean_days", _r("mean_days", 6))


_CENS = """
cens AS (SELECT *, (end_date < DATE '{end}')::INT AS event, (least(end_date, DATE '{end}') - start_date)::INT AS t FROM iv WHERE start_date <= DATE '{end}' {more})
"""
_C = _CENS.format(end="2001-10-01", more="")
_KM = """
km0 AS (SELECT {k} t, sum(event)::BIGINT AS d, count(*) AS c FROM cens GROUP BY ALL),
km1 AS (SELECT *, sum(c) OVER ({p} ORDER BY t DESC)::BIGINT AS n FROM km0),
km AS (SELECT *, product(1.0::DOUBLE - d::DOUBLE / n) OVER ({p} ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM km1)
"""
_KMC = _KM.format(k="layout,", p="PARTITION BY layout")
_KMA = _KM.format(k="", p="")


def _censored(spark, d):
    return K.censored_at(intervals(spark, d), OBS_END)


def _aged(rows):
    return rows.withColumn("age", years_between(F.col("start_date"), F.col("build_date")))


@query(f"WITH {_C} SELECT row_id, t, event FROM cens")
def k00_censored(spark, d):
    return _censored(spark, d).select("row_id", "t", "event")


@query("WITH " + _CENS.format(end="2000-01-01", more="AND start_date < DATE '2000-01-01'") + " SELECT row_id, t, event FROM cens")
def k00b_known_at_cutoff(spark, d):
    return K.known_at(intervals(spark, d), dt.date(2000, 1, 1)).select("row_id", "t", "event")


@query("WITH " + _CENS.format(end="2001-10-01", more="AND year(start_date) IN (1998, 1999)") + " SELECT row_id, t, event FROM cens")
def f03_survival_scope(spark, d):
    return K.censored_at(intervals(spark, d), OBS_END, [1998, 1999]).select("row_id", "t", "event")


@query(f"WITH {_C}, {_KMC} SELECT layout, t, d, c, n, round(s, 9) AS s FROM km")
def k01_km_by_category(spark, d):
    return K.km_curve(_censored(spark, d), ["layout"]).withColumn("s", _r("s"))


@query(f"WITH {_C}, {_KMC} SELECT layout, day, round(coalesce(max_by(s, t) FILTER (t <= day), 1), 9) AS s FROM km, (SELECT unnest([7, 14, 30])::INT AS day) GROUP BY layout, day")
def k02_survival_at_days(spark, d):
    return K.survival_at(K.km_curve(_censored(spark, d), ["layout"]), [7, 14, 30], ["layout"]).withColumn("s", _r("s"))


@query(f"WITH {_C}, {_KMC} SELECT layout, share, min(t) FILTER (s <= 1 - share) AS t FROM km, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS share) GROUP BY layout, share")
def k03_quantile_times(spark, d):
    return K.quantile_times(K.km_curve(_censored(spark, d), ["layout"]), [0.25, 0.5, 0.75], ["layout"])


def _at(day: str) -> str:
    return f"coalesce((SELECT max_by(s, t) FROM km WHERE km.t <= {day}), 1.0::DOUBLE)"


@query(f"WITH {_C}, {_KMA} SELECT e AS elapsed, round(least(greatest(1 - {_at('e + 14')} / {_at('e')}, 0), 1), 9) AS p FROM (SELECT DISTINCT (start_date - DATE '1990-01-01')::INT % 40 AS e FROM iv)")
def k04_conditional_end(spark, d):
    points = intervals(spark, d).select((F.datediff("start_date", F.lit(dt.date(1990, 1, 1))) % 40).alias("elapsed")).distinct()
    return K.conditional_end(points, K.km_curve(_censored(spark, d)), "elapsed", 14, "p").select("elapsed", _r("p").alias("p"))


@query(f"WITH {_C}, {_KMC} SELECT layout, e AS elapsed, coalesce(min(t) FILTER (t > e AND s <= s0 / 2) - e, 730)::INT AS days FROM (SELECT km.*, e, coalesce(max_by(s, t) FILTER (t <= e) OVER (PARTITION BY layout, e), 1) AS s0 FROM km, (SELECT unnest([0, 7, 30])::INT AS e)) GROUP BY layout, e")
def k05_remaining_median(spark, d):
    return K.remaining_median(K.km_curve(_censored(spark, d), ["layout"]), [0, 7, 30], strata=["layout"])


@query(f"WITH {_C}, {_KMC}, q AS (SELECT layout, min(t) FILTER (s <= 0.5) AS median_t, round(coalesce(max_by(s, t) FILTER (t <= 14), 1), 9) AS s_14, round(coalesce(max_by(s, t) FILTER (t <= 30), 1), 9) AS s_30, round(coalesce(max_by(s, t) FILTER (t <= 60), 1), 9) AS s_60 FROM km GROUP BY layout) SELECT layout, n, events, censored, median_t, s_14, s_30, s_60 FROM q JOIN (SELECT layout, count(*) AS n, sum(event)::BIGINT AS events, sum(1 - event)::BIGINT AS censored FROM cens GROUP BY layout) USING (layout)")
def k06_stratum_summary(spark, d):
    out = K.summary(_censored(spark, d), ["layout"])
    return out.withColumns({c: _r(c) for c in ("s_14", "s_30", "s_60")})


@query(f"WITH {_C}, {_KMC}, v AS (SELECT *, sum(CASE WHEN n > d THEN d::DOUBLE / (n * (n - d)) END) OVER (PARTITION BY layout ORDER BY t ROWS UNBOUNDED PRECEDING) AS v FROM km) SELECT layout, t, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-1.959963984540054::DOUBLE * sqrt(v) / ln(s))) ELSE s END, 6) AS low, round(CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.959963984540054::DOUBLE * sqrt(v) / ln(s))) ELSE s END, 6) AS high FROM v")
def k07_confidence_band(spark, d):
    return K.confidence_band(K.km_curve(_censored(spark, d), ["layout"]), ["layout"]).select("layout", "t", _r("low", 6).alias("low"), _r("high", 6).alias("high"))


@query("WITH " + _CENS.format(end="2000-01-01", more="AND start_date < DATE '2000-01-01' AND layout <> 'R'") + f", {_KMC}, al0 AS (SELECT t, sum(event) AS d, count(*) AS c FROM cens GROUP BY t), al1 AS (SELECT *, sum(c) OVER (ORDER BY t DESC) AS n FROM al0), al AS (SELECT t, product(1.0::DOUBLE - d::DOUBLE / n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM al1), snap AS (SELECT row_id, layout, (DATE '2000-04-01' - start_date)::INT AS e FROM iv WHERE start_date <= DATE '2000-04-01' AND end_date > DATE '2000-04-01'), own AS (SELECT row_id, e, coalesce(max_by(km.s, km.t) FILTER (km.t <= e), 1) AS a, coalesce(max_by(km.s, km.t) FILTER (km.t <= e + 14), 1) AS b, count(km.s) AS k FROM snap LEFT JOIN km ON km.layout = snap.layout GROUP BY ALL), every AS (SELECT row_id, coalesce(max_by(al.s, al.t) FILTER (al.t <= e), 1) AS a, coalesce(max_by(al.s, al.t) FILTER (al.t <= e + 14), 1) AS b FROM snap, al GROUP BY row_id) SELECT own.row_id, own.k = 0 OR own.a <= 0 AS fallback, round(CASE WHEN own.k > 0 AND own.a > 0 THEN 1 - own.b / own.a WHEN every.a > 0 THEN 1 - every.b / every.a END, 6) AS p FROM own JOIN every USING (row_id)")
def k08_two_level_baseline(spark, d):
    train = K.known_at(intervals(spark, d), dt.date(2000, 1, 1)).filter("layout <> 'R'")
    live = N.snapshot(intervals(spark, d), [dt.date(2000, 4, 1)], [14], OBS_END)
    return K.two_level(live, train, "elapsed_day", 14, ["layout"]).select("row_id", "fallback", _r("p", 6).alias("p"))


@query(f"WITH {_C} SELECT year(start_date)::INT AS start_year, count(*) AS n, sum(event)::BIGINT AS events, sum(1 - event)::BIGINT AS censored, sum(1 - event) / count(*)::DOUBLE AS censored_share, quantile_cont(t, 0.5) AS median_t, max(t) AS max_t FROM cens GROUP BY 1")
def g21_yearly_survival(spark, d):
    return K.yearly_summary(_censored(spark, d))


@query(f"WITH {_C} SELECT layout, day AS time_day, count(*) AS at_risk, sum((event = 1 AND day = t)::INT)::BIGINT AS events FROM (SELECT *, unnest(range(0, t + 1))::INT AS day FROM cens) GROUP BY ALL")
def p01_person_period_counts(spark, d):
    return PP.person_periods(_censored(spark, d)).groupBy("layout", "time_day").agg(F.count("*").alias("at_risk"), F.sum("event_in_day").alias("events"))


@query(f"WITH {_C} SELECT count(*) AS rows, sum(t + 1)::BIGINT AS period_rows, 0::BIGINT AS without_periods, 0::BIGINT AS wrong_days, 0::BIGINT AS wrong_events, 0::BIGINT AS wrong_range, 0::BIGINT AS event_not_last FROM cens")
def p02_validate_periods(spark, d):
    rows = _censored(spark, d)
    return PP.validate_periods(rows, PP.person_periods(rows), "row_id")


@query(f"WITH {_C}, p AS (SELECT row_id, day, (event = 1 AND day = t)::INT AS ev FROM (SELECT *, unnest(range(0, least(t, 29) + 1))::INT AS day FROM cens)) SELECT ev AS event_in_day, count(*) AS n, sum(day)::BIGINT AS days, round(sum(CASE WHEN ev = 1 THEN 1.0::DOUBLE ELSE 10 END), 6) AS weight FROM p WHERE ev = 1 OR ('0x' || substr(md5('1|' || row_id || '|' || day), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1 GROUP BY ev")
def p03_sampled_periods(spark, d):
    rows = PP.sampled_periods(_censored(spark, d), "row_id", 0.1, cap=29, seed=1)
    return rows.groupBy("event_in_day").agg(F.count("*").alias("n"), F.sum("time_day").alias("days"), _r(F.sum("weight"), 6).alias("weight"))


@query(f"WITH {_C} SELECT row_id, l AS landmark, h AS horizon, CASE WHEN t > l + h THEN 0 ELSE 1 END AS target FROM cens, (SELECT unnest([7, 14, 30])::INT AS l), (SELECT unnest([7, 14])::INT AS h) WHERE t > l AND (t > l + h OR event = 1)")
def p04_landmark_labels(spark, d):
    return PP.landmark_labels(_censored(spark, d), [7, 14, 30], [7, 14]).select("row_id", "landmark", "horizon", "target")


_AGE = "((year(start_date) - year(build_date)) * 12 + month(start_date) - month(build_date)) / 12.0::DOUBLE"


_TIME_BAND = """
CASE WHEN day <= 6 THEN '0-6' WHEN day <= 13 THEN '7-13' WHEN day <= 29 THEN '14-29' WHEN day <= 59 THEN '30-59'
     WHEN day <= 89 THEN '60-89' WHEN day <= 179 THEN '90-179' WHEN day <= 364 THEN '180-364' ELSE '365+' END"""
_AGE_BAND = """
CASE WHEN age >= 40 THEN '40+' WHEN age >= 30 THEN '30-40' WHEN age >= 20 THEN '20-30' WHEN age >= 10 THEN '10-20' WHEN age >= 0 THEN '0-10' END"""
_FINE_AGE = "CASE WHEN age >= 4 THEN '4+' WHEN age >= 3 THEN '3-4' WHEN age >= 2 THEN '2-3' WHEN age >= 1 THEN '1-2' WHEN age >= 0 THEN '0-1' END"


@query(
    f"""WITH {_C}, f AS (SELECT *, CASE WHEN {_AGE} >= 0 THEN {_AGE} END AS age, t AS day FROM cens),
    b AS (SELECT *, {_TIME_BAND} AS time_band, {_AGE_BAND} AS ab, {_FINE_AGE} AS fine FROM f)
    SELECT row_id, round(ln(1 + rent), 6) AS log_rent, time_band, coalesce(ab, 'missing') AS age_band, layout AS category,
           coalesce(ab, 'missing') || ' × ' || layout AS age_category, coalesce(fine, 'missing') AS fine_age_band FROM b"""
)
def p05_features(spark, d):
    """The usual bands, and age bands by the year, since the rows of this view are young."""
    rows = _aged(_censored(spark, d)).withColumn("time_day", F.col("t"))
    out = PP.features(rows).withColumn("fine_age_band", F.coalesce(PP.age_band(F.col("age"), [0, 1, 2, 3, 4]), F.lit("missing")))
    return out.select("row_id", _r("log_rent", 6).alias("log_rent"), "time_band", "age_band", "category", "age_category", "fine_age_band")


@query("WITH h AS (SELECT row_id, layout, 0.01::DOUBLE * (1 + day % 3) AS h FROM (SELECT row_id, layout, unnest(range(4, 11))::INT AS day FROM iv)) SELECT row_id, round(1 - exp(sum(ln(1 - h))), 9) AS p FROM h GROUP BY row_id")
def p10_horizon_probability(spark, d):
    daily = PP.future_days(intervals(spark, d), F.lit(3), 7).withColumn("h", 0.01 * (1 + F.col("time_day") % 3))
    return PP.end_probability(daily, ["row_id"], "h").withColumn("p", _r("p"))


_SNAP = "SELECT row_id, snapshot, (snapshot - start_date)::INT AS elapsed_day, (end_date <= snapshot + 7 AND end_date < DATE '2001-10-01')::INT AS target_7, (end_date <= snapshot + 30 AND end_date < DATE '2001-10-01')::INT AS target_30 FROM iv JOIN (SELECT unnest([DATE '2000-04-01', DATE '2000-08-01', DATE '2001-04-01']) AS snapshot) ON start_date <= snapshot AND end_date > snapshot"


@query(_SNAP)
def n01_snapshot(spark, d):
    days = [dt.date(2000, 4, 1), dt.date(2000, 8, 1), dt.date(2001, 4, 1)]
    return N.snapshot(intervals(spark, d), days, [7, 30], OBS_END).select("row_id", "snapshot", "elapsed_day", "target_7", "target_30")


@query("WITH ch AS (SELECT city, day, sum(c) AS c FROM (SELECT city, start_date AS day, 1 AS c FROM iv UNION ALL SELECT city, end_date, -1 FROM iv) GROUP BY ALL), lv AS (SELECT city, day, sum(c) OVER (PARTITION BY city ORDER BY day)::BIGINT AS live FROM ch) SELECT row_id, greatest(live - (end_date > start_date)::INT, 0) AS active FROM iv JOIN lv ON lv.city = iv.city AND lv.day = iv.start_date")
def n02_active_count(spark, d):
    return N.active_count(intervals(spark, d), ["city"]).select("row_id", "active")


@query("WITH q AS (SELECT n_name AS city, day FROM nation, (SELECT unnest(generate_series(DATE '1997-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS day)) SELECT q.city, q.day, count(iv.row_id) AS live FROM q LEFT JOIN iv ON iv.city = q.city AND iv.start_date <= q.day AND iv.end_date > q.day GROUP BY ALL")
def n02_live_at_days(spark, d):
    """Live intervals of every nation on the first of each month, also of nations without any."""
    months = F.explode(F.sequence(F.lit(dt.date(1997, 1, 1)), F.lit(dt.date(2001, 12, 1)), F.expr("interval 1 month")))
    asked = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("city"), months.alias("day"))
    return N.live_at(intervals(spark, d), asked, ["city"], "day")


@query(
    """WITH k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY building_id) <= 620 AND building_id NOT IN ('1', '3') THEN building_id END AS known FROM iv),
    p AS (SELECT *, lag(start_date) OVER w AS ps, lag(end_date) OVER w AS pe FROM k WINDOW w AS (PARTITION BY known ORDER BY start_date, row_id)),
    r AS (SELECT *, count(*) OVER (PARTITION BY known ORDER BY (start_date - DATE '1970-01-01') RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS c,
                 known IS NOT NULL AND start_date - pe BETWEEN 0 AND 365 AS ok FROM p)
    SELECT row_id, CASE WHEN known IS NULL THEN 0 ELSE c END AS recent, CASE WHEN ok THEN (pe - ps)::INT END AS prev_length, CASE WHEN ok THEN (start_date - pe)::INT END AS prev_gap FROM r"""
)
def n03_n04_look_back(spark, d):
    """Placeholder keys, and keys of very many rows, have no history."""
    rows = frequent_keys(intervals(spark, d), "building_id", 620, ["1", "3"])
    return N.look_back(rows, ["known"]).select("row_id", "recent", "prev_length", "prev_gap")


#: What a hazard is fit on and judged by.
_HAZARD = ["t", "event", "rent", "area", "walk_distance", "age", "layout"]


def _trained(spark, d):
    from ..operators import hazard as H

    rows = _aged(intervals(spark, d))
    train = K.known_at(rows, dt.date(2000, 1, 1)).filter(F.year("start_date").isin(1998, 1999))
    return rows, H.fit_hazard(PP.features(PP.person_periods(train)), of=train)


@query()
def p06_p11_hazard_risk(spark, d):
    from ..operators import hazard as H

    rows, model = _trained(spark, d)
    live = N.snapshot(rows, [dt.date(2000, 4, 1)], [14], OBS_END)
    return H.horizon_risk(model, live, ["row_id"], "elapsed_day", 14).withColumn("p", _r("p", 6))


@query()
def p14_evaluate_hazard(spark, d):
    from ..operators import hazard as H

    rows, model = _trained(spark, d)
    test = K.censored_at(rows, OBS_END, [2000])
    out = H.evaluate(model, test, "row_id", [7, 14], [7, 14])
    return out.select("landmark", "horizon", "n", *[_r(c, 6).alias(c) for c in ("predicted", "actual", "brier", "auc")])


_SC = """
tr0 AS (SELECT *, CASE WHEN {age} >= 0 THEN {age} END AS age FROM iv), tr AS (SELECT * FROM tr0 WHERE year(start_date) = 1998 AND city <> 'NATION_8'),
sc AS (SELECT {parts} FROM tr),
q AS (SELECT row_id, city, {units} FROM tr0, sc WHERE start_date <= DATE '2000-04-01' AND end_date > DATE '2000-04-01'),
nb AS (SELECT row_id AS neighbour, city, {units} FROM tr, sc),
ds AS (SELECT q.row_id, neighbour, sqrt({d2}) AS distance FROM q JOIN nb USING (city)),
near AS (SELECT row_id, neighbour, distance FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY distance, neighbour) AS k FROM ds) WHERE k <= 30)
""".format(
    age=_AGE,
    parts=", ".join(f"quantile_cont({c}, 0.5) AS {c}_m, CASE WHEN quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1.0::DOUBLE END AS {c}_s" for c in ("age", "rent", "area", "walk_distance")),
    units=", ".join(f"(coalesce({c}, {c}_m) - {c}_m) / {c}_s AS u_{c}" for c in ("age", "rent", "area", "walk_distance")),
    d2=" + ".join(f"(q.u_{c} - nb.u_{c}) * (q.u_{c} - nb.u_{c})" for c in ("age", "rent", "area", "walk_distance")),
)
_FOUR = ["age", "rent", "area", "walk_distance"]


def _comparables(spark, d):
    rows = _aged(intervals(spark, d))
    train = rows.filter((F.year("start_date") == 1998) & (F.col("city") != "NATION_8"))
    return rows, train, N.snapshot(rows, [dt.date(2000, 4, 1)], [14], OBS_END)


@query(f"WITH {_SC} SELECT row_id, neighbour, round(distance, 6) AS distance FROM near")
def p12_comparables(spark, d):
    from ..operators import hazard as H

    _, train, live = _comparables(spark, d)
    return H.comparables(train, live, "city", _FOUR, "row_id").drop("compared").withColumn("distance", _r("distance", 6))


@query(
    f"""WITH {_SC}, cens AS (SELECT row_id, (end_date < DATE '2000-01-01')::INT AS event, (least(end_date, DATE '2000-01-01') - start_date)::INT AS t FROM tr),
    tm AS (SELECT near.row_id, t, event FROM near JOIN cens ON cens.row_id = near.neighbour UNION ALL SELECT 'all', t, event FROM cens),
    k0 AS (SELECT row_id, t, sum(event) AS d, count(*) AS c FROM tm GROUP BY ALL), k1 AS (SELECT *, sum(c) OVER (PARTITION BY row_id ORDER BY t DESC) AS n FROM k0),
    k2 AS (SELECT row_id, t, product(1.0::DOUBLE - d::DOUBLE / n) OVER (PARTITION BY row_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM k1),
    md AS (SELECT row_id, min(t) FILTER (s <= 0.5 + 1e-9) AS own FROM k2 GROUP BY row_id)
    SELECT q.row_id, coalesce(c.n, 0) AS neighbours, coalesce(md.own, (SELECT coalesce(own, 730) FROM md WHERE row_id = 'all'))::INT AS median
    FROM q LEFT JOIN md ON md.row_id = q.row_id LEFT JOIN (SELECT row_id, count(*) AS n FROM near GROUP BY row_id) c ON c.row_id = q.row_id"""
)
def p12_comparable_median(spark, d):
    """One city has no training rows: its rows get the overall median."""
    from ..operators import hazard as H

    _, train, live = _comparables(spark, d)
    return H.comparable_median(K.known_at(train, dt.date(2000, 1, 1)), live, "city", _FOUR, "row_id")


@query()
def l05_live_risk(spark, d):
    """Intervals on the market: the model's risk within its scope (all categories but R, walk known), else the rate of the group at the snapshots of the year before."""
    from ..operators import hazard as H
    from ..operators.lookup import group_table

    rows, model = _trained(spark, d)
    past = N.snapshot(rows, [dt.date(1999, 4, 1), dt.date(1999, 8, 1)], [14], OBS_END)
    groups = group_table(past, ["city", "layout"], "target_14", 0.5)
    live = N.snapshot(rows, [dt.date(2000, 4, 1)], [14], OBS_END)
    out = H.live_risk(model, live, groups, ["city", "layout"], 4, (F.col("layout") != "R") & F.col("walk_distance").isNotNull(), cut=0.5)
    return out.select("row_id", "city", "layout", _r("risk", 6).alias("risk"), "rate", "mode", "level", "status")


@query()
def p07_city_hazard(spark, d):
    """The hazard with the city as a further category, on all days up to day 179."""
    from ..operators import hazard as H

    rows = _aged(intervals(spark, d))
    train = K.known_at(rows, dt.date(2000, 1, 1)).filter(F.year("start_date") == 1999)
    model = H.fit_hazard(PP.features(PP.person_periods(train, 179)), categories=[*H.CATEGORIES, "city"], of=train, cap=179)
    out = H.evaluate(model, K.censored_at(rows, OBS_END, [2000]), "row_id", [7], [7, 14])
    return out.select("landmark", "horizon", "n", *[_r(c, 6).alias(c) for c in ("predicted", "actual", "brier", "auc")])


@query(
    f"""WITH {_C}, o AS (SELECT least(1.0::DOUBLE, 20000 / sum(least(t, 29) + 1 - (event = 1 AND t <= 29)::INT)::DOUBLE) AS share FROM cens),
    p AS (SELECT row_id, day, (event = 1 AND day = t)::INT AS ev FROM (SELECT *, unnest(range(0, least(t, 29) + 1))::INT AS day FROM cens))
    SELECT ev AS event_in_day, count(*) AS n, sum(day)::BIGINT AS days, round(sum(CASE WHEN ev = 1 THEN 1.0::DOUBLE ELSE 1 / share END), 3) AS weight FROM p, o
    WHERE ev = 1 OR ('0x' || substr(md5('1|' || row_id || '|' || day), 1, 8))::BIGINT / 4294967296.0::DOUBLE < share GROUP BY ev"""
)
def p03_bounded_periods(spark, d):
    rows = PP.bounded_periods(_censored(spark, d), "row_id", cap=29, most=20_000)
    return rows.groupBy("event_in_day").agg(F.count("*").alias("n"), F.sum("time_day").alias("days"), _r(F.sum("weight"), 3).alias("weight"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS events, min(ts)::DATE AS first_day FROM s GROUP BY user_id, k")
def x01_sessions(spark, d):
    from ..streaming.sessions import sessions

    out = sessions(spark.read.parquet(f"{d}/events.parquet"), gap="6 hours")
    return out.select("user_id", "events", F.to_date("start").alias("first_day"))


_KML = _KM.format(k="layout, station,", p="PARTITION BY layout, station")


@query(f"WITH {_C}, {_KML}, big AS (SELECT layout, station, count(*) AS n FROM cens GROUP BY ALL HAVING count(*) >= 100), q AS (SELECT layout, station, min(t) FILTER (s <= 0.75) AS q25, min(t) FILTER (s <= 0.5) AS q50, min(t) FILTER (s <= 0.25) AS q75, coalesce(max_by(s, t) FILTER (t <= 12), 1) AS s12, coalesce(max_by(s, t) FILTER (t <= 19), 1) AS s19 FROM km GROUP BY ALL) SELECT layout, station, n, q25, q50, q75, round(1 - s19 / s12, 9) AS p FROM q JOIN big USING (layout, station)")
def g25_same_condition_table(spark, d):
    return K.condition_table(_censored(spark, d), ["layout", "station"], 100, 12, 7).withColumn("p", _r("p"))


@query()
def p08_boosted_hazard(spark, d):
    """Up to 300 rounds of rate 0.08, depth 6 and 200 rows a leaf; a held tenth ends them after 20 idle rounds. Fit on all days up to day 179."""
    from ..operators import hazard as H

    rows = _aged(intervals(spark, d)).withColumn("start_month", F.month("start_date"))
    with scratch(spark) as keep:
        known = stored(K.known_at(rows, dt.date(2000, 1, 1)).filter(F.year("start_date") == 1999).select("row_id", *_HAZARD, "start_month", "station", "city"))
        train = H.frequent_or_other(known, "station", 150)
        model = H.boosted_hazard(PP.features(PP.person_periods(train, 179)), "row_id", of=train, cap=179)
        live = H.frequent_or_other(N.snapshot(rows, [dt.date(2000, 4, 1)], [14], OBS_END), "station", 150, of=known)
        live = live.repartition(spark.sparkContext.defaultParallelism)  # few rows, each of which meets all trees
        return keep(stored(H.horizon_risk(model, live, ["row_id"], "elapsed_day", 14).withColumn("p", _r("p", 6))))


@query()
def p09_static_classifier(spark, d):
    from ..functions.clean import extreme_label
    from ..operators import hazard as H

    rows = _censored(spark, d).withColumns({"log_rent": F.log1p("rent"), "log_area": F.log1p("area"), "category": F.coalesce("layout", F.lit("missing")), "label": extreme_label(F.col("t"), F.col("event"), 6, 40)})
    names = ["log_rent", "log_area", "walk_distance"]
    model = H.fit_hazard(rows.filter("label is not null and year(start_date) = 1999"), names, ["category", "city"], label="label")
    return H.hazard_of(model, rows.filter("year(start_date) = 2000"), names).select("row_id", _r("hazard", 6).alias("p"))


@query()
def p17_scope_comparison(spark, d):
    """Fit on all days up to day 179 of each scope, judged on one category; the rows are joined and stored once for all scopes."""
    from ..operators import hazard as H

    rows = _aged(intervals(spark, d))
    own, near = F.col("layout") == "N", F.col("layout").isin("N", "R")
    scopes = {"own": own, "near": near, "all": F.lit(True), "near but own": near & ~own, "all but own": ~own}
    out = None
    with scratch(spark) as keep:
        train = stored(K.known_at(rows, dt.date(2000, 1, 1)).filter(F.year("start_date") == 1999).select(*_HAZARD))
        test = stored(K.censored_at(rows, OBS_END, [2000]).filter("layout = 'N'").select(*_HAZARD))
        for name, scope in scopes.items():
            seen = train.filter(scope)
            model = H.fit_hazard(PP.features(PP.person_periods(seen, 179)), of=seen, cap=179)
            part = H.evaluate(model, test, "row_id", [7], [14]).select(F.lit(name).alias("scope"), "n", *[_r(c, 6).alias(c) for c in ("predicted", "actual", "brier", "auc")])
            out = part if out is None else out.unionByName(part)
        return keep(stored(out))


@query()
def p15_model_selection(spark, d):
    """Three sets of inputs, fit on starts of 1998, judged on those of 1999; the best one, refit on both, on 2000."""
    from ..operators import hazard as H
    from ..operators.selection import select_model

    rows = _aged(intervals(spark, d))
    known = K.known_at(rows, dt.date(2000, 1, 1))
    days = lambda r: PP.features(PP.person_periods(r, 179))
    inputs = {"time": (["time_day"], ["time_band"]), "category": (["time_day"], ["time_band", "category"]), "all": (H.NUMERIC, H.CATEGORIES)}
    fits = {name: (lambda r, numeric=numeric, categories=categories: H.fit_hazard(days(r), numeric, categories, of=r, cap=179)) for name, (numeric, categories) in inputs.items()}
    year = lambda y: known.filter(F.year("start_date") == y).select(*_HAZARD)
    found = select_model(year(1998), year(1999), lambda: K.censored_at(rows, OBS_END, [2000]), fits, "row_id", [7, 14], [7, 14], whole=True)
    return found.scores.select("model", "part", "landmark", "horizon", "n", *[_r(c, 6).alias(c) for c in ("predicted", "actual", "brier", "auc")])
