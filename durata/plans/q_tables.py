"""Queries of sources, cleaning, scope, bands and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import bands as B
from ..operators import prepare as P
from ..operators import stats as G
from ..sources.scratch import scratch, stored
from ..sources.views import intervals, raw_text
from .registry import query

_DUR = "CAST(end_date - start_date AS BIGINT)"
_NUM = "CASE WHEN regexp_full_match({0}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({0} AS DOUBLE) END"
_TXT = "trim(translate(coalesce({0}, ''), 'ＫＬＤ　', 'KLD '))"
_KIND = "upper(replace(" + _TXT.format("madori_kind_all_label") + ", ' ', ''))"
_KINDS = "('R','K','DK','LK','LDK','SK','SDK','SLDK')"
_ROOM = _NUM.format("madori_number_all")
_YM = "CASE WHEN regexp_full_match(regexp_replace(kenchiku_date, '\\.0$', ''), '\\d{6}') THEN CAST(try_strptime(regexp_replace(kenchiku_date, '\\.0$', '') || '01', '%Y%m%d') AS DATE) END"


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spark, sf_dir).withColumn("duration", F.datediff("end_date", "start_date"))


@query("SELECT row_id, id, city, start_date FROM iv WHERE city = 'NATION_8'")
def s02_region_extract(spark, d):
    return intervals(spark, d).filter(C.text(F.col("city")) == "NATION_8").select("row_id", "id", "city", "start_date")


@query("SELECT count(*) AS seen, count(*) FILTER (city = 'NATION_8') AS kept FROM iv")
def s02_region_extract_counts(spark, d):
    return intervals(spark, d).agg(F.count("*").alias("seen"), F.count_if(C.text(F.col("city")) == "NATION_8").alias("kept"))


@query("SELECT row_id, city FROM iv WHERE city = 'NATION_12' AND layout = 'A'")
def s03_plain_extract(spark, d):
    return intervals(spark, d).filter((F.col("city") == "NATION_12") & (F.col("layout") == "A")).select("row_id", "city")


@query("SELECT row_id, city, pub_start_date FROM raw WHERE NOT ends_with(city, '8') AND substr(pub_start_date, 1, 4) IN ('1998', '1999')")
def s04_cities_and_years(spark, d):
    keep = ~F.col("city").endswith("8") & F.substring("pub_start_date", 1, 4).isin("1998", "1999")
    return raw_text(spark, d).filter(keep).select("row_id", "city", "pub_start_date")


@query("SELECT row_id, id, rent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_id) AS rn FROM iv) WHERE rn = 1")
def s05_first_per_id(spark, d):
    return P.first_per_id(intervals(spark, d), F.col("id"), ["row_id"]).select("row_id", "id", "rent")


_PRINT = ["row_id", "id", "city", "layout", "start_date", "end_date", "station"]
_PRINT_SQL = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _PRINT)


@query(f"SELECT count(*) AS rows, sum(('0x' || substr(md5({_PRINT_SQL}), 1, 15))::BIGINT)::VARCHAR AS content FROM iv")
def s11_fingerprint(spark, d):
    return P.fingerprint(intervals(spark, d), _PRINT)


@query("SELECT row_id, id, city, layout, rent FROM iv WHERE id = '13'")
def s12_keyed_lookup(spark, d):
    return intervals(spark, d).filter(F.col("id") == "13").select("row_id", "id", "city", "layout", "rent")


@query(f"SELECT row_id, {_TXT.format('madori_kind_all_label')} AS kind FROM raw")
def c01_text(spark, d):
    return raw_text(spark, d).select("row_id", C.text(F.col("madori_kind_all_label")).alias("kind"))


@query(f"SELECT row_id, {_TXT.format('madori_kind_all_label')} AS kind FROM raw")
def c01_text_exact(spark, d):
    return raw_text(spark, d).select("row_id", C.text_nfkc(F.col("madori_kind_all_label")).alias("kind"))


@query("SELECT row_id, " + _NUM.format("replace(money_room, ',', '')") + " AS rent FROM raw")
def c02_number(spark, d):
    return raw_text(spark, d).select("row_id", C.number(F.col("money_room")).alias("rent"))


@query("SELECT row_id, CASE WHEN area - 20 > 0 THEN area - 20 END AS above, CASE WHEN area - 20 >= 0 THEN area - 20 END AS not_below, (walk_distance IS NULL) AS walk_missing FROM iv")
def c03_c04_ranges_and_flags(spark, d):
    x = F.col("area") - 20
    return intervals(spark, d).select("row_id", C.positive(x).alias("above"), C.non_negative(x).alias("not_below"), (~C.flag(F.col("walk_distance").isNotNull())).alias("walk_missing"))


@query("SELECT row_id, CAST(pub_start_date AS DATE) AS start_date, CAST(CAST(pub_end_date AS DATE) - CAST(pub_start_date AS DATE) AS INTEGER) AS duration, CAST(year(CAST(pub_start_date AS DATE)) AS INTEGER) AS y, CAST(month(CAST(pub_start_date AS DATE)) AS INTEGER) AS m FROM raw")
def c05_c06_dates(spark, d):
    a, b = C.day(F.col("pub_start_date")), C.day(F.col("pub_end_date"))
    return raw_text(spark, d).select("row_id", a.alias("start_date"), F.datediff(b, a).alias("duration"), F.year(a).alias("y"), F.month(a).alias("m"))


@query(f"SELECT row_id, {_YM} AS built FROM raw")
def c07_year_month(spark, d):
    return raw_text(spark, d).select("row_id", C.year_month(F.col("kenchiku_date")).alias("built"))


@query("WITH m AS (SELECT row_id, (year(start_date) - year(build_date)) * 12 + month(start_date) - month(build_date) AS m FROM iv) SELECT row_id, CASE WHEN m >= 0 THEN m / 12.0::DOUBLE END AS age, m < 0 AS built_later FROM m")
def c08_age(spark, d):
    age = C.years_between(F.col("start_date"), F.col("build_date"))
    return intervals(spark, d).select("row_id", age.alias("age"), age.isNull().alias("built_later"))


@query(f"SELECT row_id, CASE WHEN {_ROOM} >= 1 AND {_ROOM} % 1 = 0 AND {_KIND} IN {_KINDS} THEN CAST(CAST({_ROOM} AS INT) AS STRING) || {_KIND} END AS category, CASE WHEN {_KIND} = '' THEN 'missing_kind' WHEN {_KIND} NOT IN {_KINDS} THEN 'unsupported_kind' WHEN NOT ({_ROOM} >= 1 AND {_ROOM} % 1 = 0) THEN 'invalid_rooms' END AS issue FROM raw")
def c09_c10_category(spark, d):
    a, k = F.col("madori_number_all"), F.col("madori_kind_all_label")
    return raw_text(spark, d).select("row_id", C.category(a, k, P.KINDS).alias("category"), C.category_issue(a, k, P.KINDS).alias("issue"))


@query("SELECT row_id, id = '' AS missing_id, count(*) OVER (PARTITION BY id) > 1 AND id <> '' AS repeated_id FROM iv")
def c11_repeated_ids(spark, d):
    return P.prepare(raw_text(spark, d)).select("row_id", "missing_id", "repeated_id")


@query("SELECT row_id, CASE WHEN building_id <> '0' THEN building_id || '::' || unit_id END AS entity FROM iv")
def c12_entity_key(spark, d):
    return intervals(spark, d).select("row_id", C.entity_key(F.col("building_id"), F.col("unit_id")).alias("entity"))


@query("SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY building_id) <= 620 AND building_id NOT IN ('1', '3') THEN building_id END AS known FROM iv")
def c13_placeholder_keys(spark, d):
    return P.frequent_keys(intervals(spark, d), "building_id", 620, ["1", "3"]).select("row_id", "known")


@query("SELECT row_id, round(ln(1 + rent), 6) AS log_rent, coalesce(CAST(walk_distance AS STRING), 'missing') = 'missing' AS no_walk, CASE WHEN end_date - start_date <= 6 THEN 1 WHEN end_date - start_date >= 40 THEN 0 END AS label FROM iv")
def c14_c15_logs_and_extreme_label(spark, d):
    return _iv(spark, d).select("row_id", _r(F.log1p("rent")).alias("log_rent"), F.col("walk_distance").isNull().alias("no_walk"), C.extreme_label(F.col("duration"), F.lit(1), 6, 40).alias("label"))


@query("SELECT row_id, coalesce(CASE WHEN walk_distance < 5000 THEN 'near' WHEN walk_distance >= 5000 THEN 'far' END, 'missing') || ' × ' || layout AS cell FROM iv")
def c16_interaction(spark, d):
    near = F.when(F.col("walk_distance") < 5000, "near").when(F.col("walk_distance") >= 5000, "far")
    return intervals(spark, d).select("row_id", C.interaction(near, F.col("layout")).alias("cell"))


@query("SELECT row_id, (rent >= 20000)::INT + (rent >= 60000)::INT AS level, CASE WHEN rent >= 60000 THEN 'high' WHEN rent >= 20000 THEN 'middle' ELSE 'low' END AS tier, least(greatest(rent, 5000), 90000) AS clipped FROM iv")
def c17_c18_levels(spark, d):
    x = F.col("rent")
    return intervals(spark, d).select("row_id", C.level(x, [20000, 60000]).alias("level"), C.tier(x, [20000, 60000], ["low", "middle", "high"]).alias("tier"), C.clip(x, 5000.0, 90000.0).alias("clipped"))


@query("WITH p AS (SELECT layout, avg(CASE WHEN end_date - start_date <= 7 THEN 1.0::DOUBLE ELSE 0.0 END) AS p FROM iv GROUP BY layout) SELECT layout, day, round(pow(1 - (1 - pow(1 - p, 1.0::DOUBLE / 7)), day), 9) AS left_open FROM p, (SELECT unnest(range(1, 8))::INT AS day)")
def c19_daily_rate(spark, d):
    p = _iv(spark, d).groupBy("layout").agg(F.avg((F.col("duration") <= 7).cast("double")).alias("p"))
    return p.select("layout", C.daily_rate(F.col("p"), 7).alias("q"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("day")).select("layout", "day", _r(F.pow(1 - F.col("q"), F.col("day")), 9).alias("left_open"))


_FLOW = """
WITH s AS (SELECT count(*) AS n0, count(*) FILTER (year(start_date) IN (1998, 1999)) AS n1, count(*) FILTER (year(start_date) IN (1998, 1999) AND layout IN ('A', 'R')) AS n2,
                  count(*) FILTER (year(start_date) IN (1998, 1999) AND layout IN ('A', 'R') AND walk_distance IS NOT NULL) AS n3 FROM iv)
SELECT 1 AS step_no, 'years' AS step, n0 AS before, n0 - n1 AS excluded, n1 AS remaining FROM s UNION ALL
SELECT 2, 'types', n1, n1 - n2, n2 FROM s UNION ALL SELECT 3, 'walk known', n2, n2 - n3, n3 FROM s
"""


def _steps():
    return [("years", F.year("start_date").isin(1998, 1999)), ("types", F.col("layout").isin("A", "R")), ("walk known", F.col("walk_distance").isNotNull())]


@query(_FLOW)
def f01_scope_flow(spark, d):
    return P.flow(intervals(spark, d), _steps())[1]


@query("SELECT row_id FROM iv WHERE year(start_date) IN (1998, 1999) AND layout IN ('A', 'R') AND walk_distance IS NOT NULL")
def f01_scope_rows(spark, d):
    return P.flow(intervals(spark, d), _steps())[0].select("row_id")


@query("SELECT row_id, id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM iv) WHERE year(start_date) = 1998 AND n = 1")
def f02_without_repeated(spark, d):
    rows = P.prepare(raw_text(spark, d)).filter((F.col("start_year") == 1998) & (F.col("duration") >= 0) & ~F.col("repeated_id"))
    return rows.select("row_id", "id")


@query("SELECT city, layout, count(*) AS n FROM iv GROUP BY ALL HAVING count(*) >= 800")
def f05_cells_of_size(spark, d):
    return intervals(spark, d).groupBy("city", "layout").agg(F.count("*").alias("n")).filter("n >= 800")


@query("SELECT city, count(*) AS count FROM iv GROUP BY city ORDER BY count DESC, city LIMIT 6")
def f06_top_values(spark, d):
    return P.top_values(intervals(spark, d), "city", 6)


@query(
    """WITH a AS (SELECT *, (year(start_date) - year(build_date)) * 12 + month(start_date) - month(build_date) AS m FROM iv)
    SELECT row_id, city, station FROM a WHERE layout = 'A' AND rent <= 60000 AND m >= 0 AND m / 12.0::DOUBLE <= 0.25 AND (contains(lower(city), 'on_1') OR contains(lower(station), 'on_1'))"""
)
def f07_search(spark, d):
    """Equality, upper bounds of rent and age, and a text that either of two columns holds."""
    rows = intervals(spark, d).withColumn("age", C.years_between(F.col("start_date"), F.col("build_date")))
    return P.search(rows, {"layout": "A"}, {"rent": 60000, "age": 0.25}, "on_1", ["city", "station"]).select("row_id", "city", "station")


_BAND = """
WITH m AS (SELECT floor(max(rent) / 20000)::INT AS r, floor(max(area) / 2)::INT AS a FROM iv)
SELECT 'rent' AS attr, b::INT AS bin, b * 20000.0::DOUBLE AS lo, (b + 1) * 20000.0::DOUBLE AS hi, (b * 20000)::STRING || '-' || ((b + 1) * 20000)::STRING AS label, (b // 10)::INT AS page FROM (SELECT unnest(range(0, r + 1)) AS b FROM m) UNION ALL
SELECT 'area', b::INT, b * 2.0::DOUBLE, (b + 1) * 2.0::DOUBLE, (b * 2)::STRING || '-' || ((b + 1) * 2)::STRING, (b // 10)::INT FROM (SELECT unnest(range(0, a + 1)) AS b FROM m)
"""


@query(_BAND)
def b01_b02_b11_full_range_bands(spark, d):
    return B.band_table(intervals(spark, d), {"rent": 20000, "area": 2})


@query("SELECT row_id, (floor(rent / 20000)::BIGINT * 20000)::STRING || '-' || ((floor(rent / 20000)::BIGINT + 1) * 20000)::STRING AS rent_band FROM iv")
def b03_apply_bands(spark, d):
    rows = intervals(spark, d)
    return B.apply_bands(rows, "rent", 20000, "rent_band").select("row_id", "rent_band")


@query("WITH m AS (SELECT greatest(ceil(max(area) / 2) - 1, 0)::INT AS a FROM iv) SELECT b::INT AS bin, b * 2.0::DOUBLE AS lo, (b + 1) * 2.0::DOUBLE AS hi FROM (SELECT unnest(range(0, a + 1)) AS b FROM m)")
def b04_ceil_edge_bands(spark, d):
    return B.band_table(intervals(spark, d), {"area": 2}, edge_rule="ceil").select("bin", "lo", "hi")


@query("SELECT row_id, CASE WHEN area >= 26 THEN '26+' WHEN area >= 23 THEN '23-26' WHEN area >= 21 THEN '21-23' END AS left_band, CASE WHEN d <= 0 THEN '0' WHEN d <= 7 THEN '1-7' WHEN d <= 30 THEN '8-30' ELSE '31+' END AS right_band, coalesce(floor(walk_distance / 2000)::INT::STRING, 'unknown') AS code FROM (SELECT *, end_date - start_date AS d FROM iv)")
def b05_b08_irregular_bands(spark, d):
    return _iv(spark, d).select("row_id", B.left_closed(F.col("area"), [21, 23, 26], ["21-23", "23-26", "26+"]).alias("left_band"), B.right_closed(F.col("duration"), [0, 7, 30], ["0", "1-7", "8-30", "31+"]).alias("right_band"), B.floor_code(F.col("walk_distance"), 2000).alias("code"))


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(area, [0.2, 0.4, 0.6, 0.8]))) AS e FROM iv) SELECT row_id, len(list_filter(e, lambda x: x < area))::INT AS band FROM iv, e")
def b09_quantile_bands(spark, d):
    return B.quantile_bands(intervals(spark, d), "area", 5).select("row_id", "band")


@query("WITH h AS (SELECT least(floor((end_date - start_date) / 10), 3)::INT AS bin, count(*) AS n FROM iv GROUP BY 1) SELECT bin, n, n / sum(n) OVER () AS share FROM h")
def b10_histogram(spark, d):
    return B.histogram(_iv(spark, d), "duration", 10, 4)


_STATS = """
WITH v AS (SELECT {by} end_date - start_date AS v FROM iv {where}), c AS (SELECT {by} v, count(*) AS c FROM v GROUP BY ALL), t AS (SELECT *, max(c) OVER ({over}) AS top FROM c),
m AS (SELECT {by} string_agg(v::STRING, '|' ORDER BY v) AS modes, count(*) AS mode_ties, max(c) AS mode_freq, min(v)::INT AS mode FROM t WHERE c = top {group}),
s AS (SELECT {by} count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, min(v)::INT AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, max(v)::INT AS max FROM v {group})
SELECT {out} n, mean, median, modes, mode_ties, mode_freq, min, q1, q3, max, mode FROM s {join} m {on}
"""


@query(_STATS.format(by="", where="", over="", group="", out="", join="CROSS JOIN", on=""))
def g01_exact_stats(spark, d):
    return G.exact_stats(_iv(spark, d), "duration").withColumn("mean", _r("mean"))


@query(_STATS.format(by="city, ", where="", over="PARTITION BY city", group="GROUP BY city", out="s.city, ", join="JOIN", on="ON s.city = m.city"))
def g01_exact_stats_by_city(spark, d):
    return G.exact_stats(_iv(spark, d), "duration", ["city"]).withColumn("mean", _r("mean"))


@query("WITH c AS (SELECT city, end_date - start_date AS v, count(*) AS c FROM iv GROUP BY ALL), t AS (SELECT city, v FROM c QUALIFY c = max(c) OVER (PARTITION BY city)) SELECT city, CASE WHEN count(*) = 1 THEN min(v)::DOUBLE END AS value, CASE WHEN count(*) > 1 THEN 'tied: ' || string_agg(v::STRING, '|' ORDER BY v) END AS issue FROM t GROUP BY city")
def g02_selected_mode(spark, d):
    return G.selected_stat(G.exact_stats(_iv(spark, d), "duration", ["city"]), "mode").select("city", "value", "issue")


@query("WITH b AS (SELECT unnest(range(0, (SELECT floor(max(rent) / 5000)::INT FROM iv) + 1)) AS bin), s AS (SELECT floor(rent / 5000)::INT AS bin, count(*) AS n, round(avg(end_date - start_date), 6) AS mean, quantile_cont(end_date - start_date, 0.5) AS median FROM iv GROUP BY 1) SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, mean, median FROM b LEFT JOIN s ON s.bin = b.bin")
def g03_full_range_stats(spark, d):
    rows = _iv(spark, d).withColumn("rent_bin", B.equal_width(F.col("rent"), 5000))
    return G.full_range_stats(rows, B.band_table(rows, {"rent": 5000}), "rent_bin", "duration").select("bin", "n", _r("mean").alias("mean"), "median")


@query("SELECT city, layout, count(*) AS n, round(avg(end_date - start_date), 6) AS mean, quantile_cont(end_date - start_date, 0.5) AS median FROM iv GROUP BY ALL")
def g04_cross_stats(spark, d):
    return G.exact_stats(_iv(spark, d), "duration", ["city", "layout"]).select("city", "layout", "n", _r("mean").alias("mean"), "median")


_GRID = """
WITH b AS (SELECT unnest(range(0, (SELECT floor(max(rent) / 20000)::INT FROM iv) + 1)) AS bin), k AS (SELECT DISTINCT city FROM iv),
s AS (SELECT floor(rent / 20000)::INT AS bin, city, count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, round(coalesce(stddev_samp(v), 0), 6) AS std, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM (SELECT *, end_date - start_date AS v FROM iv) GROUP BY ALL)
SELECT b.bin::INT AS bin, k.city, coalesce(n, 0) AS n, mean, median, std, q1, q3, q3 - q1 AS iqr FROM b CROSS JOIN k LEFT JOIN s ON s.bin = b.bin AND s.city = k.city
"""


@query(_GRID)
def g05_cross_table(spark, d):
    rows = _iv(spark, d).withColumn("rent_bin", B.equal_width(F.col("rent"), 20000))
    with scratch(spark) as keep:
        rows = stored(rows.select("rent", "rent_bin", "city", "duration"))
        out = keep(G.cross_table(rows, B.band_table(rows, {"rent": 20000}), rows.select("city").distinct(), "rent_bin", "city", "duration"))
    return out.withColumns({"mean": _r("mean"), "std": _r("std")})


@query("SELECT CASE WHEN walk_distance >= 5000 THEN 'far' WHEN walk_distance < 5000 THEN 'near' END AS walk, count(*) AS n FROM iv GROUP BY 1")
def g06_value_counts(spark, d):
    return intervals(spark, d).groupBy(F.when(F.col("walk_distance") >= 5000, "far").when(F.col("walk_distance") < 5000, "near").alias("walk")).agg(F.count("*").alias("n"))


@query("SELECT 'no_walk' AS flag, count(*) FILTER (walk_distance IS NULL) AS whole, count(*) FILTER (walk_distance IS NULL AND year(start_date) = 1998) AS in_scope FROM iv UNION ALL SELECT 'built_later', count(*) FILTER (build_date > start_date), count(*) FILTER (build_date > start_date AND year(start_date) = 1998) FROM iv")
def g07_flag_counts(spark, d):
    rows = intervals(spark, d).withColumns({"no_walk": F.col("walk_distance").isNull(), "built_later": C.flag(F.col("build_date") > F.col("start_date"))})
    return G.flag_counts(rows, ["no_walk", "built_later"], F.year("start_date") == 1998)


@query("SELECT city, layout, station, count(*) AS n FROM iv WHERE walk_distance IS NULL GROUP BY ALL")
def g08_flag_context(spark, d):
    return intervals(spark, d).filter("walk_distance is null").groupBy("city", "layout", "station").agg(F.count("*").alias("n"))


@query("SELECT 'walk_distance' AS \"column\", count(*) AS rows, count(walk_distance) AS present, count(*) - count(walk_distance) AS missing, (count(*) - count(walk_distance)) / count(*)::DOUBLE AS missing_rate FROM iv UNION ALL SELECT 'rent', count(*), count(rent), count(*) - count(rent), (count(*) - count(rent)) / count(*)::DOUBLE FROM iv")
def g09_missing_summary(spark, d):
    return G.missing_summary(intervals(spark, d), ["walk_distance", "rent"])


@query("WITH v AS (SELECT 'area' AS variable, area AS v FROM iv UNION ALL SELECT 'duration', (end_date - start_date)::DOUBLE FROM iv) SELECT variable, count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS min, max(v) AS max FROM v GROUP BY variable")
def g10_describe_many(spark, d):
    return G.describe_many(_iv(spark, d), ["area", "duration"]).select("variable", "n", _r("mean").alias("mean"), "median", "min", "max")


@query("SELECT layout, count(*) AS n, quantile_cont(end_date - start_date, 0.5) AS median, quantile_cont(end_date - start_date, 0.75) AS q3 FROM iv GROUP BY layout")
def g11_group_quantiles(spark, d):
    return G.group_quantiles(_iv(spark, d), "duration", {"median": 0.5, "q3": 0.75}, ["layout"])


@query("SELECT count(*) AS n, round(corr(walk_distance, rent), 6) AS r FROM iv WHERE walk_distance IS NOT NULL")
def g12_pearson(spark, d):
    return G.pearson(intervals(spark, d), "walk_distance", "rent").withColumn("r", _r("r"))


@query("WITH p AS (SELECT walk_distance AS x, end_date - start_date AS y FROM iv WHERE walk_distance IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM p) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r")
def g13_spearman(spark, d):
    return G.spearman(_iv(spark, d), "walk_distance", "duration").withColumn("rho", _r("rho"))


@query("WITH g AS (SELECT city, count(*) AS n, sum(end_date - start_date)::DOUBLE AS s, sum((end_date - start_date) * (end_date - start_date))::DOUBLE AS ss FROM iv GROUP BY city HAVING count(*) >= 30) SELECT count(*) AS groups, sum(n)::BIGINT AS n, round(sqrt((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n))), 6) AS eta FROM g")
def g14_correlation_ratio(spark, d):
    return G.correlation_ratio(_iv(spark, d), "city", "duration", 30).withColumn("eta", _r("eta"))


@query("WITH r AS (SELECT count(*) AS n, corr(walk_distance, v) AS xy, corr(rent, v) AS zy, corr(walk_distance, rent) AS xz FROM (SELECT *, (end_date - start_date)::DOUBLE AS v FROM iv) WHERE walk_distance IS NOT NULL) SELECT n, round((xy * xy + zy * zy - 2 * xy * zy * xz) / (1 - xz * xz), 6) AS r2 FROM r")
def g15_pair_r2(spark, d):
    return G.pair_r2(_iv(spark, d), "walk_distance", "rent", "duration").withColumn("r2", _r("r2"))


@query("WITH g AS (SELECT layout, count(*) AS n, sum(area) AS x, sum(v) AS y, sum(area * area) AS xx, sum(v * v) AS yy, sum(area * v) AS xy FROM (SELECT *, (end_date - start_date)::DOUBLE AS v FROM iv) GROUP BY layout), t AS (SELECT sum(n)::BIGINT AS n, sum(xx - x * x / n) AS sxx, sum(yy - y * y / n) AS syy, sum(xy - x * y / n) AS sxy, sum(yy) AS yy, sum(y) AS y FROM g) SELECT n, round(1 - (syy - sxy * sxy / sxx) / (yy - y * y / n), 6) AS r2 FROM t")
def g15_pair_r2_category(spark, d):
    return G.pair_r2_category(_iv(spark, d), "area", "layout", "duration").withColumn("r2", _r("r2"))


@query("WITH c AS (SELECT city, layout, count(*) AS n, quantile_cont(end_date - start_date, 0.5) AS median FROM iv GROUP BY ALL) SELECT city, round(sum(median * n) / sum(n), 6) AS value, sum(n)::BIGINT AS n FROM c GROUP BY city")
def g16_weighted_medians(spark, d):
    cells = G.exact_stats(_iv(spark, d), "duration", ["city", "layout"])
    return G.weighted_medians(cells, "city").withColumn("value", _r("value"))


@query("WITH c AS (SELECT city, quantile_cont(end_date - start_date, 0.5) AS median, count(*) AS n FROM iv GROUP BY city) SELECT city, n, median FROM c ORDER BY n DESC, city LIMIT 5")
def g17_extreme_cells(spark, d):
    return G.extremes(G.exact_stats(_iv(spark, d), "duration", ["city"]), 5, "n", "city", True).select("city", "n", "median")


@query("SELECT year(start_date)::INT AS start_year, count(*) AS n, count(*) FILTER (end_date IS NOT NULL) AS known_ends, quantile_cont(end_date - start_date, 0.5) AS median, round(avg(end_date - start_date), 6) AS mean, min(start_date) AS first_start, max(end_date) AS last_end FROM iv GROUP BY 1")
def g18_year_audit(spark, d):
    rows = _iv(spark, d).withColumn("start_year", F.year("start_date"))
    with scratch(spark) as keep:
        rows = stored(rows.select("start_year", "start_date", "end_date", "duration"))
        sums = rows.groupBy("start_year").agg(F.count("end_date").alias("known_ends"), _r(F.avg("duration")).alias("mean"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end"))
        return keep(stored(G.meet(sums, G.group_quantiles(rows, "duration", {"median": 0.5}, ["start_year"]), ["start_year"])))


@query("WITH m AS (SELECT max(end_date) AS top FROM iv) SELECT top, count(*) FILTER (end_date = top) AS last_day, count(*) FILTER (end_date > top - 7) AS last_7, count(*) FILTER (end_date > top - 30) AS last_30 FROM iv, m GROUP BY top")
def g19_end_concentration(spark, d):
    rows = intervals(spark, d).select("end_date")
    top = rows.agg(F.max("end_date").alias("top"))
    near = lambda k: F.count_if(F.col("end_date") > F.date_sub("top", k))
    return rows.crossJoin(F.broadcast(top)).groupBy("top").agg(near(1).alias("last_day"), near(7).alias("last_7"), near(30).alias("last_30"))


@query("SELECT count(*) AS n, round(avg(end_date - start_date), 6) AS mean, quantile_cont(end_date - start_date, 0.5) AS median, count(DISTINCT building_id) AS entities FROM iv WHERE year(start_date) = 1998")
def g20_scope_summary(spark, d):
    rows = _iv(spark, d).filter(F.year("start_date") == 1998)
    sums = rows.agg(_r(F.avg("duration")).alias("mean"), F.countDistinct("building_id").alias("entities"))
    return sums.crossJoin(G.group_quantiles(rows, "duration", {"median": 0.5}))


@query("WITH g AS (SELECT 'layout' AS kind, layout AS code, end_date - start_date AS v FROM iv UNION ALL SELECT 'station', station, end_date - start_date FROM iv) SELECT kind, code, count(*) AS n, quantile_cont(v, 0.5) AS median FROM g GROUP BY ALL")
def g23_long_groups(spark, d):
    return G.long_groups(_iv(spark, d), {"layout": F.col("layout"), "station": F.col("station")}, "duration")


@query("SELECT count(*) AS rows, count(DISTINCT CASE WHEN building_id <> '0' THEN building_id || '::' || unit_id END) AS entities, count(walk_distance) AS with_walk FROM iv")
def g24_distinct_counts(spark, d):
    return intervals(spark, d).agg(F.count("*").alias("rows"), F.countDistinct(C.entity_key(F.col("building_id"), F.col("unit_id"))).alias("entities"), F.count("walk_distance").alias("with_walk"))


_RHO = "(SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM (SELECT walk_distance AS x, end_date - start_date AS y FROM iv WHERE walk_distance IS NOT NULL)))"
_ETA = "(WITH g AS (SELECT layout, count(*) AS n, sum(end_date - start_date)::DOUBLE AS s, sum((end_date - start_date) * (end_date - start_date))::DOUBLE AS ss FROM iv GROUP BY layout) SELECT sqrt((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (sum(ss) - sum(s) * sum(s) / sum(n))) FROM g)"


@query(f"SELECT 'walk_distance' AS attribute, avg((walk_distance IS NULL)::INT) AS missing_rate, quantile_cont(walk_distance, 0.5) AS median, min(walk_distance) AS min, max(walk_distance) AS max, round({_RHO}, 6) AS strength, NULL::BIGINT AS distinct_values, NULL::VARCHAR AS top_value, NULL::DOUBLE AS top_share FROM iv UNION ALL SELECT 'layout', 0.0, NULL, NULL, NULL, round({_ETA}, 6), count(*), max_by(layout, (n, layout)), max(n) / sum(n)::DOUBLE FROM (SELECT layout, count(*) AS n FROM iv GROUP BY layout)")
def g22_attribute_table(spark, d):
    return G.attribute_table(_iv(spark, d), ["walk_distance"], ["layout"], "duration").withColumn("strength", _r("strength"))


@query("SELECT 'a' AS source, layout, count(*) AS n, NULL::DOUBLE AS mean FROM iv GROUP BY layout UNION ALL SELECT 'b', layout, NULL, round(avg(end_date - start_date), 6) FROM iv GROUP BY layout")
def m18_comparison_table(spark, d):
    rows = _iv(spark, d)
    a = rows.groupBy("layout").agg(F.count("*").alias("n")).withColumn("source", F.lit("a"))
    b = rows.groupBy("layout").agg(_r(F.avg("duration")).alias("mean")).withColumn("source", F.lit("b"))
    return G.union_all([a, b]).orderBy("source", "layout")


@query("SELECT city, count(*) FILTER (layout = 'A') AS a, count(*) FILTER (layout = 'N') AS n, count(*) FILTER (layout = 'R') AS r FROM iv GROUP BY city")
def v01_pivot(spark, d):
    wide = intervals(spark, d).groupBy("city").pivot("layout", ["A", "N", "R"]).count()
    return wide.select("city", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in ("A", "N", "R")])
