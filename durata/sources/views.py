"""Interval and text views over the driver's order tables.

Roles: ``row_id`` unique tie-break, ``id`` record id (repeats), ``building_id`` and
``unit_id`` the entity, ``start_date``/``end_date`` the interval, ``layout`` a
category, ``station`` a secondary one, then numerics, a group and a build date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import small

#: The same statement runs in Spark and DuckDB; it is the base of every oracle.
INTERVALS_SQL = """
SELECT md5(concat_ws('|', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING),
                     CAST(l.l_suppkey AS STRING), CAST(CAST(l.l_shipdate AS DATE) AS STRING),
                     CAST(CAST(round(l.l_extendedprice*100) AS BIGINT) AS STRING))) AS row_id,
       CAST(l.l_orderkey*10 + l.l_linenumber AS STRING) AS id,
       CAST(l.l_suppkey AS STRING) AS building_id, CAST(l.l_linenumber AS STRING) AS unit_id,
       CAST(l.l_shipdate AS DATE) AS start_date,
       CAST(l.l_shipdate AS DATE) + CAST(l.l_quantity AS INT) AS end_date,
       l.l_returnflag AS layout, l.l_linestatus AS station,
       CAST(round(20 + 100*l.l_tax) AS DOUBLE) AS area, l.l_extendedprice AS rent,
       CASE WHEN s.s_acctbal >= 0 THEN s.s_acctbal END AS walk_distance,
       n.n_name AS city, CAST(o.o_orderdate AS DATE) AS build_date
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
"""

#: DuckDB's form of :func:`raw_text`.
RAW_SQL = f"""
SELECT row_id, id, building_id, unit_id, CAST(start_date AS STRING) AS pub_start_date, CAST(end_date AS STRING) AS pub_end_date,
       format('{{:,.2f}}', rent) AS money_room,
       concat(strftime(build_date, '%Y%m'), CASE WHEN unit_id IN ('3', '6') THEN '.0' ELSE '' END) AS kenchiku_date,
       CASE layout WHEN 'A' THEN ' ldk ' WHEN 'R' THEN 'Ｋ' ELSE 'UNKNOWN' END AS madori_kind_all_label,
       unit_id AS madori_number_all, city, CAST(area AS STRING) AS house_area
FROM ({INTERVALS_SQL})
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("lineitem", "orders", "supplier", "nation")}
    # three numbers a supplier, so up to a million of them are some tens of MB in a task; of more, both sides are shuffled
    t["supplier"] = small(t["supplier"].select("s_suppkey", "s_nationkey", "s_acctbal"), 1_000_000)
    return spark.sql(INTERVALS_SQL.replace("FROM lineitem l JOIN orders o", "FROM {lineitem} l JOIN {orders} o").replace("JOIN supplier s", "JOIN {supplier} s").replace("JOIN nation n", "JOIN {nation} n"), **t)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals as an all-text source would deliver them."""
    kind = F.when(F.col("layout") == "A", " ldk ").when(F.col("layout") == "R", "Ｋ").otherwise("UNKNOWN")
    return intervals(spark, sf_dir).select(
        "row_id", "id", "building_id", "unit_id", F.col("start_date").cast("string").alias("pub_start_date"), F.col("end_date").cast("string").alias("pub_end_date"),
        F.format_number("rent", 2).alias("money_room"), F.concat(F.date_format("build_date", "yyyyMM"), F.when(F.col("unit_id").isin("3", "6"), ".0").otherwise("")).alias("kenchiku_date"),
        kind.alias("madori_kind_all_label"), F.col("unit_id").alias("madori_number_all"), "city", F.col("area").cast("string").alias("house_area"),
    )
