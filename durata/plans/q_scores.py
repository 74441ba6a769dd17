"""Queries of ranking, metrics, resampling and lookup, over snapshots scored by last year's rates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup as L
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import resample as S
from ..operators import snapshots as N
from ..operators.bands import floor_code
from ..operators.resampled_auc import resampled_auc_intervals
from ..sources.views import intervals
from .registry import query

OBS_END = dt.date(2001, 10, 1)
_r = lambda c, k=9: F.round(c, k)

_CAND = """
snap AS (SELECT iv.*, snapshot, (snapshot - start_date)::INT AS elapsed_day, (end_date <= snapshot + 14 AND end_date < DATE '2001-10-01')::INT AS y, floor(rent / 20000)::INT::STRING AS rent_band
         FROM iv JOIN (SELECT unnest([DATE '1999-04-01', DATE '1999-08-01', DATE '2000-04-01', DATE '2000-08-01']) AS snapshot) ON start_date <= snapshot AND end_date > snapshot),
tr AS (SELECT * FROM snap WHERE year(snapshot) = 1999), own AS (SELECT city, rent_band, sum(y) / count(*)::DOUBLE AS own FROM tr GROUP BY ALL),
cand AS (SELECT s.*, coalesce(own, (SELECT sum(y) / count(*)::DOUBLE FROM tr)) AS p FROM snap s LEFT JOIN own ON own.city = s.city AND own.rent_band = s.rent_band WHERE year(snapshot) = 2000)
"""


def _snaps(spark: SparkSession, d: str) -> DataFrame:
    days = [dt.date(1999, 4, 1), dt.date(1999, 8, 1), dt.date(2000, 4, 1), dt.date(2000, 8, 1)]
    return N.snapshot(intervals(spark, d), days, [14], OBS_END).withColumnRenamed("target_14", "y").withColumn("rent_band", floor_code(F.col("rent"), 20000))


def _cand(spark: SparkSession, d: str) -> DataFrame:
    rows = _snaps(spark, d)
    return R.rate_score(rows.filter(F.year("snapshot") == 1999), rows.filter(F.year("snapshot") == 2000), ["city", "rent_band"], "y")


@query(f"WITH {_CAND} SELECT row_id, snapshot, y, round(p, 9) AS p FROM cand")
def p13_rate_score(spark, d):
    return _cand(spark, d).select("row_id", "snapshot", "y", _r("p").alias("p"))


@query(f"WITH {_CAND} SELECT row_id, snapshot, layout FROM (SELECT *, count(*) OVER (PARTITION BY snapshot, city, layout) AS n FROM cand) WHERE n >= 5")
def f04_complete_sets(spark, d):
    return R.complete_sets(_cand(spark, d), ["snapshot", "city", "layout"], ["p"], 5).select("row_id", "snapshot", "layout")


_SETS = "s AS (SELECT scenario, set_id, cand.* FROM cand, LATERAL (SELECT 'all' AS scenario, snapshot::STRING AS set_id UNION ALL SELECT 'layout', snapshot::STRING || '|' || layout))"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return R.set_rows(_cand(spark, d), {"all": [], "layout": ["layout"]})


@query(f"WITH {_CAND}, {_SETS} SELECT scenario, set_id, count(*) AS n FROM s GROUP BY ALL")
def n05_segments(spark, d):
    return _sets(spark, d).groupBy("scenario", "set_id").agg(F.count("*").alias("n"))


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, city ORDER BY p DESC, row_id) AS rank, ceil(count(*) OVER (PARTITION BY snapshot, city) / 2)::BIGINT AS h FROM cand), b AS (SELECT *, max(p) FILTER (rank = h) OVER (PARTITION BY snapshot, city) AS a, max(p) FILTER (rank = h + 1) OVER (PARTITION BY snapshot, city) AS z FROM r) SELECT row_id, snapshot, rank::INT AS rank, CASE WHEN abs(a - z) <= 1e-12 AND abs(p - a) <= 1e-12 THEN 'tied' WHEN rank <= h THEN 'high' ELSE 'low' END AS half FROM b")
def n06_priority(spark, d):
    return R.priority(_cand(spark, d), ["snapshot", "city"], "p", "row_id").select("row_id", "snapshot", "rank", "half")


_AUC = "c AS (SELECT {k} p, sum(y) AS a, sum(1 - y) AS b FROM {t} GROUP BY ALL), c2 AS (SELECT *, coalesce(sum(b) OVER ({w} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), au AS (SELECT {k} sum(a)::BIGINT AS pos, sum(b)::BIGINT AS neg, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * (below + b / 2.0::DOUBLE)) / (sum(a) * sum(b)) END AS auc FROM c2 {g})"


@query(f"WITH {_CAND}, {_AUC.format(k='snapshot, city,', t='cand', w='PARTITION BY snapshot, city', g='GROUP BY snapshot, city')}, t AS (SELECT *, max(p) OVER (PARTITION BY snapshot, city) AS top FROM cand) SELECT t.snapshot, t.city, count(*) AS n, sum(y)::BIGINT AS ended, round(avg(y) FILTER (abs(p - top) <= 1e-12), 9) AS top_rate, round(avg(y), 9) AS base_rate, round(max(p) - min(p), 9) AS span, round(any_value(auc), 9) AS auc, any_value(pos * neg) AS pairs FROM t JOIN au ON au.snapshot = t.snapshot AND au.city = t.city GROUP BY t.snapshot, t.city")
def n07_set_metrics(spark, d):
    out = R.set_metrics(_cand(spark, d), ["snapshot", "city"], "p", "y")
    return out.withColumns({c: _r(c) for c in ("top_rate", "base_rate", "span", "auc")})


@query(f"WITH {_CAND}, {_SETS}, {_AUC.format(k='scenario, set_id,', t='s', w='PARTITION BY scenario, set_id', g='GROUP BY scenario, set_id')} SELECT scenario, round(sum(auc * pos * neg) / sum(pos * neg), 9) AS value, count(*) AS sets FROM au WHERE auc IS NOT NULL GROUP BY scenario")
def n08_pair_weighted_auc(spark, d):
    a = R.auc(_sets(spark, d), ["scenario", "set_id"], "p", "y").withColumn("pairs", F.col("pos") * F.col("neg"))
    return R.weighted_mean(a, ["scenario"], "auc", "pairs").withColumn("value", _r("value"))


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot, city ORDER BY p DESC, row_id) AS r, count(*) OVER (PARTITION BY snapshot, city) AS n FROM cand), g AS (SELECT count(*) AS n, avg(y) FILTER (r <= n // 2) AS hi, avg(y) FILTER (r > n - n // 2) AS lo FROM r GROUP BY snapshot, city) SELECT count(*) AS sets, round(sum((hi - lo) * n) / sum(n), 9) AS gap FROM g WHERE n >= 2")
def n09_half_gap(spark, d):
    return R.half_gap(_cand(spark, d), ["snapshot", "city"], "p", "y", "row_id").withColumn("gap", _r("gap"))


def _n10(w: str) -> str:
    return f"WITH {_CAND}, g AS (SELECT count(*) AS n, sum((p >= 0.5)::INT) AS nh, sum((p >= 0.5)::INT * y) AS yh, sum((p < 0.5)::INT * y) AS yl FROM cand GROUP BY snapshot, city) SELECT count(*) AS sets, sum(n)::BIGINT AS rows, round(sum((yh / nh::DOUBLE - yl / (n - nh)::DOUBLE) * {w}) / sum({w}), 9) AS gap FROM g WHERE n >= 3 AND nh > 0 AND n > nh"


@query(_n10("n"))
def n10_label_gap_by_size(spark, d):
    rows = _cand(spark, d).withColumn("hi", (F.col("p") >= 0.5).cast("int"))
    return R.label_gap(rows, ["snapshot", "city"], "hi", "y").withColumn("gap", _r("gap"))


@query(_n10("least(nh, n - nh)"))
def n10_label_gap_by_smaller(spark, d):
    rows = _cand(spark, d).withColumn("hi", (F.col("p") >= 0.5).cast("int"))
    return R.label_gap(rows, ["snapshot", "city"], "hi", "y", weighting="smaller").withColumn("gap", _r("gap"))


@query(
    f"""WITH {_CAND}, g AS (SELECT max(p) - min(p) >= 0.2 AS wide, count(*) AS n, sum((p >= 0.5)::INT) AS nh, sum((p >= 0.5)::INT * y) AS yh, sum((p < 0.5)::INT * y) AS yl FROM cand GROUP BY snapshot, city)
    SELECT wide, count(*) AS sets, sum(n)::BIGINT AS rows, round(sum((yh / nh::DOUBLE - yl / (n - nh)::DOUBLE) * n) / sum(n), 9) AS gap FROM g WHERE n >= 3 AND nh > 0 AND n > nh GROUP BY wide"""
)
def n10_label_gap_by_spread(spark, d):
    rows = _cand(spark, d).withColumn("hi", (F.col("p") >= 0.5).cast("int"))
    return R.label_gap(rows, ["snapshot", "city"], "hi", "y", score="p", spread=0.2).withColumn("gap", _r("gap"))


@query(f"WITH {_CAND} SELECT row_id, snapshot, (row_number() OVER (PARTITION BY snapshot ORDER BY p DESC, ('0x' || substr(md5('1|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, row_id) <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY snapshot), 0))::INT AS chosen FROM cand")
def n11_same_share(spark, d):
    return R.same_share(_cand(spark, d), ["snapshot"], "p", 0.3).select("row_id", "snapshot", "chosen")


@query(f"WITH {_CAND} SELECT snapshot, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(y), 9) AS actual, round(avg((y - p) * (y - p)), 9) AS brier FROM cand GROUP BY snapshot")
def m01_brier(spark, d):
    return M.brier(_cand(spark, d), ["snapshot"], "p", "y").withColumns({c: _r(c) for c in ("predicted", "actual", "brier")})


@query(f"WITH {_CAND}, {_AUC.format(k='', t='cand', w='', g='')} SELECT pos, neg, round(auc, 9) AS auc FROM au")
def m02_auc(spark, d):
    return R.auc(_cand(spark, d), [], "p", "y").withColumn("auc", _r("auc"))


@query(f"WITH {_CAND}, c AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM cand GROUP BY p), t AS (SELECT sum(a) AS aa, sum(b) AS bb FROM c), pts AS (SELECT p AS score, sum(b) OVER w / bb::DOUBLE AS fpr, sum(a) OVER w / aa::DOUBLE AS tpr FROM c, t WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), st AS (SELECT *, (fpr - coalesce(lag(fpr) OVER (ORDER BY score DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY score DESC), 0)) / 2 AS s FROM pts) SELECT round(score, 9) AS score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(sum(s) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING), 9) AS area FROM st")
def m03_roc(spark, d):
    return M.roc(_cand(spark, d), "p", "y").select(*[_r(c).alias(c) for c in ("score", "fpr", "tpr", "area")])


@query(f"WITH {_CAND}, w AS (SELECT p, 1.0::DOUBLE / count(*) OVER (PARTITION BY row_id) AS w FROM cand), c AS (SELECT p, round(sum(w), 9) AS w FROM w GROUP BY p), r AS (SELECT p, sum(w) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER () AS t FROM c) SELECT share, round(min(p) FILTER (cw >= share * t - 1e-9), 9) AS value FROM r, (SELECT unnest([0.333::DOUBLE, 0.5, 0.667]) AS share) GROUP BY share")
def m04_weighted_quantile(spark, d):
    return M.weighted_quantile(_cand(spark, d), "p", "row_id", [0.333, 0.5, 0.667]).withColumn("value", _r("value"))


@query(f"WITH {_CAND}, s AS (SELECT snapshot, p, y, 'two' AS scheme, CASE WHEN p >= 0.5 THEN 'high' ELSE 'low' END AS tier FROM cand UNION ALL SELECT snapshot, p, y, 'three', CASE WHEN p >= 0.6 THEN 'high' WHEN p >= 0.4 THEN 'middle' ELSE 'low' END FROM cand), g AS (SELECT snapshot, scheme, tier, count(*) AS n, round(avg(y), 9) AS rate, round(avg(p), 9) AS mean_score FROM s GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY snapshot, scheme)::DOUBLE AS share FROM g")
def m05_m13_tier_table(spark, d):
    from ..functions.clean import tier

    rows = _cand(spark, d).withColumns({"two": tier(F.col("p"), [0.5], ["low", "high"]), "three": tier(F.col("p"), [0.4, 0.6], ["low", "middle", "high"])})
    return M.tier_table(rows, ["snapshot"], {"two": "two", "three": "three"}, "p", "y").withColumns({"rate": _r("rate"), "mean_score": _r("mean_score")})


@query(f"WITH {_CAND}, g AS (SELECT cut, count(*) AS n, count(*) FILTER (p >= cut) AS n_hi, sum(y) FILTER (p >= cut) AS yh, sum(y) AS yy FROM cand, (SELECT unnest([0.2::DOUBLE, 0.4, 0.5, 0.6]) AS cut) GROUP BY cut) SELECT cut, n, n_hi, n_hi / n::DOUBLE AS share, yh / n_hi::DOUBLE AS rate_hi, (yy - coalesce(yh, 0)) / nullif(n - n_hi, 0)::DOUBLE AS rate_lo, yh / yy::DOUBLE AS capture, yh / n_hi::DOUBLE - (yy - coalesce(yh, 0)) / nullif(n - n_hi, 0)::DOUBLE AS gap FROM g")
def m06_m07_threshold_sweep(spark, d):
    return M.threshold_sweep(_cand(spark, d), [], "p", "y", [0.2, 0.4, 0.5, 0.6])


@query(f"WITH {_CAND}, c AS (SELECT quantile_cont(p, 0.7) AS cut FROM cand), g AS (SELECT round(cut, 9) AS cut, count(*) FILTER (p >= cut) AS n_hi, avg(y) FILTER (p >= cut) AS h, avg(y) FILTER (p < cut) AS l, avg(y) AS a FROM cand, c GROUP BY c.cut) SELECT cut, n_hi, round(h, 9) AS rate_hi, round(l, 9) AS rate_lo, round(a, 9) AS rate, round(h / l, 9) AS lift, round(h / a, 9) AS lift_all FROM g")
def m08_lift(spark, d):
    return M.lift(_cand(spark, d), "p", "y").withColumns({c: _r(c) for c in ("cut", "rate_hi", "rate_lo", "rate", "lift", "lift_all")})


@query(f"WITH {_CAND}, c AS (SELECT quantile_cont(p, 0.7) AS cut FROM cand WHERE month(snapshot) = 4) SELECT CASE WHEN month(snapshot) = 4 THEN 'tune' ELSE 'test' END AS part, round(cut, 9) AS cut, round(avg((p >= cut)::INT), 9) AS share, round(avg(y) FILTER (p >= cut), 9) AS rate_hi, round(avg(y) FILTER (p < cut), 9) AS rate_lo FROM cand, c GROUP BY 1, c.cut")
def m09_share_cut(spark, d):
    rows = _cand(spark, d)
    out = M.share_cut(rows.filter(F.month("snapshot") == 4), rows.filter(F.month("snapshot") == 8), "p", "y", 0.3)
    return out.withColumns({c: _r(c) for c in ("cut", "share", "rate_hi", "rate_lo")})


@query(f"WITH {_CAND}, s AS (SELECT cut, count(*) AS n, sum((p >= cut)::INT) AS h, sum((p >= cut)::INT * y) AS yh, sum((p < cut)::INT * y) AS yl FROM cand, (SELECT unnest([0.4::DOUBLE, 0.5, 0.6]) AS cut) GROUP BY snapshot, city, cut), t AS (SELECT cut, sum(n * (n - 1) // 2)::BIGINT AS pairs, sum(h * (n - h))::BIGINT AS differing, sum(yh * (n - h - yl))::BIGINT AS wins, sum((h - yh) * yl)::BIGINT AS losses FROM s GROUP BY cut) SELECT *, (wins - losses) / pairs::DOUBLE AS v, wins / nullif(wins + losses, 0)::DOUBLE AS win_rate FROM t")
def m10_m11_pair_value(spark, d):
    return M.pair_value(_cand(spark, d), ["snapshot", "city"], "p", "y", [0.4, 0.5, 0.6])


_QS = "[" + ", ".join(repr(round(0.1 + 0.02 * i, 2)) for i in range(41)) + "]"


@query(f"WITH {_CAND}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, {_QS}))) AS e FROM cand), k AS (SELECT len(list_filter(e, lambda x: x <= p)) AS cell, sum(y) AS a, count(*) - sum(y) AS b, count(*) AS n FROM cand, e GROUP BY 1), cut AS (SELECT unnest(e) AS cut, generate_subscripts(e, 1) AS i FROM e), pr AS (SELECT x.cut AS low, z.cut AS high, CASE WHEN cell >= z.i THEN 2 WHEN cell >= x.i THEN 1 ELSE 0 END AS t, a, b, n FROM cut x JOIN cut z ON x.i < z.i, k), g AS (SELECT low, high, coalesce(sum(a) FILTER (t = 0), 0) AS p0, coalesce(sum(a) FILTER (t = 1), 0) AS p1, coalesce(sum(a) FILTER (t = 2), 0) AS p2, coalesce(sum(b) FILTER (t = 0), 0) AS q0, coalesce(sum(b) FILTER (t = 1), 0) AS q1, coalesce(sum(b) FILTER (t = 2), 0) AS q2, coalesce(sum(n) FILTER (t = 0), 0)::BIGINT AS n0, coalesce(sum(n) FILTER (t = 1), 0)::BIGINT AS n1, coalesce(sum(n) FILTER (t = 2), 0)::BIGINT AS n2 FROM pr GROUP BY ALL) SELECT round(low, 9) AS low, round(high, 9) AS high, round((p1 * (q0 + q1 / 2.0::DOUBLE) + p0 * q0 / 2.0::DOUBLE + p2 * (q0 + q1 + q2 / 2.0::DOUBLE)) / ((p0 + p1 + p2) * (q0 + q1 + q2)), 9) AS auc, n0 AS n_low, n1 AS n_mid, n2 AS n_high FROM g WHERE least(n0, n1, n2) >= 0.1 * (n0 + n1 + n2) ORDER BY auc DESC, low, high LIMIT 1")
def m12_best_cuts(spark, d):
    out = M.best_cuts(_cand(spark, d), "p", "y")
    return out.select(_r(F.col("cuts")[0]).alias("low"), _r(F.col("cuts")[1]).alias("high"), _r("auc").alias("auc"), *[F.col("sizes")[i].alias(f"n_{name}") for i, name in enumerate(("low", "mid", "high"))])


def _cuts_sql(k: int) -> str:
    """All combinations of ``k - 1`` cuts, scored one by one."""
    names = [f"i{j}" for j in range(1, k)]
    tables = " JOIN ".join(f"cut x{j}" + (f" ON x{j - 1}.i < x{j}.i" if j > 1 else "") for j in range(1, k))
    tier = " + ".join(f"(cell >= x{j}.i)::INT" for j in range(1, k))
    picked = ", ".join(f"x{j}.i AS {n}" for j, n in enumerate(names, 1))
    by = ", ".join(names)
    return f"""(SELECT {k} AS tiers, [{', '.join(f'round(e[{n}], 9)' for n in names)}] AS cuts, round(won / (2 * tp * tq), 9) AS auc, sizes
      FROM (SELECT {by}, sum(a * (2 * (coalesce(lag_q, 0)) + b)) AS won, sum(a) AS tp, sum(b) AS tq, list(n ORDER BY t) AS sizes, min(n) AS small, count(*) AS filled
        FROM (SELECT *, sum(b) OVER (PARTITION BY {by} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lag_q
          FROM (SELECT {picked}, {tier} AS t, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(n)::BIGINT AS n FROM {tables}, k GROUP BY {by}, t)) GROUP BY {by}), e
      WHERE filled = {k} AND small >= 0.1::DOUBLE * (tp + tq) ORDER BY won DESC, {by} LIMIT 1)"""


@query(f"WITH {_CAND}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, {_QS}))) AS e FROM cand), k AS (SELECT len(list_filter(e, lambda x: x <= p)) AS cell, sum(y) AS a, count(*) - sum(y) AS b, count(*) AS n FROM cand, e GROUP BY 1), cut AS (SELECT unnest(e) AS cut, generate_subscripts(e, 1) AS i FROM e) " + " UNION ALL ".join(f"SELECT * FROM {_cuts_sql(k)}" for k in (2, 3, 4)))
def m12_best_cuts_by_tiers(spark, d):
    """The best two, three and four tiers."""
    out = M.best_cuts_each(_cand(spark, d), "p", "y", [2, 3, 4])
    return out.select("tiers", F.transform("cuts", lambda c: _r(c)).alias("cuts"), _r("auc").alias("auc"), "sizes")


@query(f"WITH {_CAND}, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0.2, 0.4, 0.6, 0.8]))) AS e FROM cand) SELECT len(list_filter(e, lambda x: x < p))::INT AS band, count(*) AS n, round(avg(p), 9) AS predicted, round(avg(y), 9) AS actual FROM cand, e GROUP BY 1")
def m14_calibration(spark, d):
    return M.calibration(_cand(spark, d), "p", "y", 5).withColumns({"predicted": _r("predicted"), "actual": _r("actual")})


_BOOT = """
cl AS (SELECT city, {sums} FROM cand GROUP BY city), no AS (SELECT *, row_number() OVER (ORDER BY substr(md5(city), 1, 2), md5(city), city) - 1 AS cluster_no, count(*) OVER () AS k FROM cl),
dr AS (SELECT id // k AS rep, floor(('0x' || substr(md5('1|' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * k)::BIGINT AS cluster_no FROM (SELECT unnest(range(0, (SELECT any_value(k) FROM no) * 200)) AS id), (SELECT any_value(k) AS k FROM no)),
ms AS (SELECT rep, cluster_no, count(*) AS m FROM dr GROUP BY ALL)
"""


@query(f"WITH {_CAND}, {_BOOT.format(sums='sum(y) AS a, count(*) AS b')}, x AS (SELECT rep, sum(m * a) / sum(m * b)::DOUBLE AS x FROM ms JOIN no USING (cluster_no) GROUP BY rep) SELECT round((SELECT sum(a) / sum(b)::DOUBLE FROM no), 9) AS estimate, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high, count(x) AS replicates FROM x")
def m15_cluster_bootstrap(spark, d):
    out = S.bootstrap_ratio(_cand(spark, d), "city", F.col("y"), F.lit(1))
    return out.withColumns({c: _r(c) for c in ("estimate", "low", "high")})


@query(f"WITH {_CAND}, {_BOOT.format(sums='sum((p >= 0.5)::INT) AS nh, sum((p >= 0.5)::INT * y) AS yh, sum((p < 0.5)::INT) AS nl, sum((p < 0.5)::INT * y) AS yl')}, x AS (SELECT rep, sum(m * yh) / nullif(sum(m * nh), 0)::DOUBLE AS h, sum(m * yl) / nullif(sum(m * nl), 0)::DOUBLE AS l FROM ms JOIN no USING (cluster_no) GROUP BY rep), o AS (SELECT sum(yh) / sum(nh)::DOUBLE AS h, sum(yl) / sum(nl)::DOUBLE AS l FROM no) SELECT round((SELECT h - l FROM o), 9) AS gap, round(quantile_cont(h - l, 0.025), 9) AS gap_low, round(quantile_cont(h - l, 0.975), 9) AS gap_high, round((SELECT h / l FROM o), 9) AS ratio, round(quantile_cont(h / nullif(l, 0), 0.025), 9) AS ratio_low, round(quantile_cont(h / nullif(l, 0), 0.975), 9) AS ratio_high FROM x")
def m16_entity_bootstrap_gap(spark, d):
    out = S.bootstrap_gap(_cand(spark, d).withColumn("hi", (F.col("p") >= 0.5).cast("int")), "city", "hi", "y")
    return out.select(*[_r(c).alias(c) for c in out.columns])


@query()
def m15_m16_split_bootstrap(spark, d):
    """The end rate with buildings drawn a thousand times, without a table of draws."""
    out = S.resampled_interval(_cand(spark, d), "building_id", F.col("y"), F.lit(1), replicates=1000)
    return out.withColumns({c: _r(c) for c in ("estimate", "low", "high")})


_HIGH = "sum(y) AS a, count(*) AS b, sum((p >= 0.5)::INT * y) AS ah, sum((p >= 0.5)::INT) AS bh"


@query(
    f"""WITH {_CAND}, {_BOOT.format(sums=_HIGH)},
    x AS (SELECT rep, sum(m * a) / sum(m * b)::DOUBLE AS xa, sum(m * ah) / nullif(sum(m * bh), 0)::DOUBLE AS xh FROM ms JOIN no USING (cluster_no) GROUP BY rep),
    o AS (SELECT sum(a) / sum(b)::DOUBLE AS oa, sum(ah) / sum(bh)::DOUBLE AS oh FROM no)
    SELECT 'all' AS method, round(any_value(oa), 9) AS estimate, round(quantile_cont(xa, 0.025), 9) AS low, round(quantile_cont(xa, 0.975), 9) AS high,
           NULL::DOUBLE AS difference, NULL::DOUBLE AS diff_low, NULL::DOUBLE AS diff_high FROM x, o
    UNION ALL SELECT 'high', round(any_value(oh), 9), round(quantile_cont(xh, 0.025), 9), round(quantile_cont(xh, 0.975), 9),
           round(any_value(oh - oa), 9), round(quantile_cont(xh - xa, 0.025), 9), round(quantile_cont(xh - xa, 0.975), 9) FROM x, o"""
)
def m15_bootstrap_differences(spark, d):
    """The end rate of high scores and of all rows, and their difference in the same draws."""
    hi = (F.col("p") >= 0.5).cast("int")
    out = S.bootstrap_differences(_cand(spark, d), "city", {"all": (F.col("y"), F.lit(1)), "high": (hi * F.col("y"), hi)}, "all")
    return out.select("method", *[_r(c).alias(c) for c in out.columns[1:]])


_AUCS = "CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(pos * (below + (n - pos) / 2.0::DOUBLE)) / (sum(pos) * sum(n - pos)) END"
_BELOW = "coalesce(sum(n - pos) OVER (PARTITION BY {k} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below"


@query(
    f"""WITH {_CAND}, {_BOOT.format(sums='count(*) AS b')},
    cells AS (SELECT city, score, v, count(*) AS n, sum(y) AS pos FROM (SELECT city, 'p' AS score, p AS v, y FROM cand UNION ALL SELECT city, 'early', -elapsed_day::DOUBLE, y FROM cand) GROUP BY ALL),
    w0 AS (SELECT score, v, sum(n) AS n, sum(pos) AS pos FROM cells GROUP BY ALL), w1 AS (SELECT *, {_BELOW.format(k='score')} FROM w0),
    whole AS (SELECT score, {_AUCS} AS x FROM w1 GROUP BY score),
    r0 AS (SELECT rep, score, v, sum(m * n) AS n, sum(m * pos) AS pos FROM ms JOIN no USING (cluster_no) JOIN cells USING (city) WHERE rep < 50 GROUP BY ALL),
    r1 AS (SELECT *, {_BELOW.format(k='rep, score')} FROM r0), reps AS (SELECT rep, score, {_AUCS} AS x FROM r1 GROUP BY rep, score),
    d AS (SELECT reps.*, ref.x AS r FROM reps JOIN (SELECT rep, x FROM reps WHERE score = 'p') ref USING (rep))
    SELECT score, round(any_value(w.x), 9) AS estimate, round(quantile_cont(d.x, 0.025), 9) AS low, round(quantile_cont(d.x, 0.975), 9) AS high,
           CASE WHEN score <> 'p' THEN round(any_value(w.x - (SELECT x FROM whole WHERE score = 'p')), 9) END AS difference,
           CASE WHEN score <> 'p' THEN round(quantile_cont(d.x - d.r, 0.025), 9) END AS diff_low, CASE WHEN score <> 'p' THEN round(quantile_cont(d.x - d.r, 0.975), 9) END AS diff_high
    FROM d JOIN whole w USING (score) GROUP BY score"""
)
def m17_bootstrap_auc(spark, d):
    rows = _cand(spark, d).withColumn("early", -F.col("elapsed_day").cast("double"))
    out = S.bootstrap_auc(rows, "city", ["p", "early"], "y", replicates=50)
    return out.select("score", *[_r(c).alias(c) for c in out.columns[1:]])


@query()
def m17_resampled_auc(spark, d):
    """AUCs of two scores and their difference with buildings drawn a thousand times, without a table of draws."""
    rows = _cand(spark, d).withColumn("early", -F.col("elapsed_day").cast("double"))
    out = resampled_auc_intervals(rows, "building_id", ["p", "early"], "y")
    return out.select("score", *[_r(c).alias(c) for c in out.columns[1:]])


_TWO = "sc AS (SELECT 'rate' AS model, city, p, y FROM cand UNION ALL SELECT 'flat', city, 0.5::DOUBLE, y FROM cand), br AS (SELECT model, city, avg(p) AS predicted, avg(y) AS actual, avg((y - p) * (y - p)) AS brier FROM sc GROUP BY ALL)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    rows = _cand(spark, d)
    both = rows.withColumn("model", F.lit("rate")).unionByName(rows.withColumns({"model": F.lit("flat"), "p": F.lit(0.5)}))
    return M.brier(both, ["model", "city"], "p", "y").join(R.auc(both, ["model", "city"], "p", "y"), ["model", "city"])


@query(f"WITH {_CAND}, {_TWO}, {_AUC.format(k='model, city,', t='sc', w='PARTITION BY model, city', g='GROUP BY model, city')} SELECT model, count(*) AS conditions, round(avg(brier), 9) AS mean_brier, round(quantile_cont(brier, 0.5), 9) AS median_brier, round(avg(abs(predicted - actual)), 9) AS mean_error, round(avg(auc), 9) AS mean_auc FROM br JOIN au USING (model, city) GROUP BY model")
def g26_model_summary(spark, d):
    return M.model_summary(_two(spark, d)).withColumns({c: _r(c) for c in ("mean_brier", "median_brier", "mean_error", "mean_auc")})


@query(f"WITH {_CAND}, {_TWO} SELECT city, model FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round(brier, 9), model) AS r FROM br) WHERE r = 1")
def g27_winners(spark, d):
    return M.winners(_two(spark, d).withColumn("brier", _r("brier")), ["city"], "brier", "model").select("city", "model")


@query(f"WITH {_CAND}, a AS (SELECT layout, avg(y) AS v FROM cand GROUP BY layout), b AS (SELECT layout, avg(p) AS v FROM cand GROUP BY layout) SELECT layout, round(a.v, 9) AS reported, round(b.v, 9) AS computed, coalesce(abs(a.v - b.v) <= 0.05, false) AS ok FROM a FULL JOIN b USING (layout)")
def m19_agreement(spark, d):
    rows = _cand(spark, d)
    a, b = rows.groupBy("layout").agg(F.avg("y").alias("value")), rows.groupBy("layout").agg(F.avg("p").alias("value"))
    return M.agreement(a, b, ["layout"], 0.05).withColumns({"reported": _r("reported"), "computed": _r("computed")})


@query("WITH h AS (SELECT *, row_number() OVER (ORDER BY rent, row_id) - 1 AS position, count(*) OVER () AS total FROM iv WHERE layout = 'A' AND rent <= 30000) SELECT row_id, round(rent / 10000, 2) AS rent_10k, position::INT AS position, total FROM h WHERE position >= 20 AND position < 40")
def l01_page(spark, d):
    out = L.page(intervals(spark, d), (F.col("layout") == "A") & (F.col("rent") <= 30000), ["rent", "row_id"], 20, 20)
    return out.select("row_id", _r(F.col("rent") / 10000, 2).alias("rent_10k"), "position", "total")


@query("SELECT row_id, city, position::INT AS position FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM iv) WHERE position = 7")
def l02_record_by_number(spark, d):
    return L.page(intervals(spark, d), F.lit(True), ["row_id"], 7, 1).select("row_id", "city", "position")


@query(f"WITH {_CAND} SELECT city, rent_band, count(*) AS n, sum(y) / count(*)::DOUBLE AS rate, CASE WHEN sum(y) / count(*)::DOUBLE >= 0.5 THEN 'high' ELSE 'low' END AS level FROM tr GROUP BY ALL")
def l03_group_table(spark, d):
    return L.group_table(_snaps(spark, d).filter(F.year("snapshot") == 1999), ["city", "rent_band"], "y", 0.5)


@query(f"WITH {_CAND}, g AS (SELECT city, rent_band, count(*) AS n, sum(y) / count(*)::DOUBLE AS rate FROM tr GROUP BY ALL HAVING count(*) >= 4) SELECT c.row_id, c.snapshot, g.rate, CASE WHEN g.rate IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status FROM cand c LEFT JOIN g ON g.city = c.city AND g.rent_band = c.rent_band")
def l04_risk_lookup(spark, d):
    rows = _snaps(spark, d)
    groups = L.group_table(rows.filter(F.year("snapshot") == 1999), ["city", "rent_band"], "y", 0.5)
    return L.risk_lookup(rows.filter(F.year("snapshot") == 2000), groups, ["city", "rent_band"], 4).select("row_id", "snapshot", "rate", "status")


@query(
    f"""WITH {_CAND}, g AS (SELECT city, rent_band, count(*) AS n, sum(y) / count(*)::DOUBLE AS rate FROM tr GROUP BY ALL HAVING count(*) >= 4)
    SELECT c.row_id, c.snapshot, CASE WHEN layout <> 'R' THEN round(p, 9) END AS risk, g.rate, CASE WHEN layout <> 'R' THEN 'model' ELSE 'historical' END AS mode,
           CASE WHEN layout <> 'R' THEN CASE WHEN p >= 0.5 THEN 'hi' ELSE 'lo' END END AS level, CASE WHEN g.rate IS NULL THEN 'insufficient_data' ELSE 'ok' END AS status
    FROM cand c LEFT JOIN g ON g.city = c.city AND g.rent_band = c.rent_band"""
)
def l05_model_or_historical(spark, d):
    """Rows of one category have no model: they get the past rate of their group alone."""
    from ..operators.hazard import scored_or_historical

    rows, groups = _cand(spark, d), L.group_table(_snaps(spark, d).filter(F.year("snapshot") == 1999), ["city", "rent_band"], "y", 0.5)
    risk = rows.filter("layout <> 'R'").select("row_id", "snapshot", "p")
    out = scored_or_historical(rows.drop("p"), risk, groups, ["row_id", "snapshot"], ["city", "rent_band"], 4, 0.5)
    return out.select("row_id", "snapshot", _r("risk").alias("risk"), "rate", "mode", "level", "status")


_G = "g AS (SELECT city, rent_band, city || ' | ' || rent_band AS group_id, count(*) AS n, sum(y) / count(*)::DOUBLE AS rate FROM tr GROUP BY ALL)"


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return L.group_table(_snaps(spark, d).filter(F.year("snapshot") == 1999), ["city", "rent_band"], "y", 0.5)


@query(f"WITH {_CAND}, {_G} SELECT group_id, n, rate FROM g WHERE city IN ('NATION_8', 'NATION_12', 'NATION_19') AND contains(lower(group_id), 'on_1')")
def l06_group_filter(spark, d):
    cities = {"city": ["NATION_8", "NATION_12", "NATION_19"]}
    return L.filter_groups(_groups(spark, d), ["city", "rent_band"], cities, "ON_1", order="count").select("group_id", "n", "rate")


@query(f"WITH {_CAND}, {_G} SELECT group_id, n, rate FROM g ORDER BY rate, group_id LIMIT 5")
def l06_lowest_rates(spark, d):
    return L.filter_groups(_groups(spark, d), ["city", "rent_band"], {}, order="low_rate").select("group_id", "n", "rate").limit(5)


_SAVED = [f"{city} | {band}" for city in ("NATION_8", "NATION_12") for band in range(3)]


@query(f"WITH {_CAND}, {_G} SELECT group_id, n, rate FROM g WHERE group_id IN {tuple(_SAVED)}")
def l06_saved_side_by_side(spark, d):
    return L.filter_groups(_groups(spark, d), ["city", "rent_band"], {}, saved=_SAVED, order="name").select("group_id", "n", "rate")
