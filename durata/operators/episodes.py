"""Episodes: intervals of one entity that follow each other closely become one, unless they contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import entity_key
from .hot import hot_hashes
from .prepare import require

_ORDER = ["start_date", "end_date", "row_id"]
_SEGMENT = ["gap", "_part", "segment"]


def _dated(df: DataFrame, gaps: list[int]) -> DataFrame:
    df = require(df, ["row_id", "building_id", "unit_id", "start_date", "end_date"])
    if any(g < 0 for g in gaps):
        raise ValueError("gaps must not be negative")
    rows = df.filter("start_date is not null and end_date is not null and end_date >= start_date")
    rows = rows.withColumn("key", entity_key(F.col("building_id"), F.col("unit_id")))
    return rows.withColumn("_part", F.coalesce("key", F.concat(F.lit("row "), "row_id")))


def _numbered(rows: DataFrame, gaps: list[int]) -> DataFrame:
    """Segment numbers by one sort of each entity."""
    w = Window.partitionBy("_part").orderBy(*_ORDER)
    latest = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_apart", F.datediff("start_date", latest))
    number = lambda g: F.count_if(F.col("_apart") > g).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _by_gap(rows.withColumns({f"_s{g}": number(g) for g in gaps}), gaps)


def _numbered_in_ranges(rows: DataFrame, gaps: list[int], ranges: int) -> DataFrame:
    """The same for few entities of very many rows, in ranges of start days.

    Each range is sorted by itself.  What it has to know of the ranges before is
    the latest end, which carries over as a running maximum, and how many segments
    began, a running sum; both are tables of entities x ranges.
    """
    day = F.unix_date("start_date")
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.groupBy("_part").agg(F.array_distinct(F.percentile_approx(day, shares, 20 * ranges)).alias("_cuts"))
    rows = rows.join(F.broadcast(cuts), "_part").withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= day))).drop("_cuts")
    before = Window.partitionBy("_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part", "_range").agg(F.max("end_date").alias("_end")).select("_part", "_range", F.max("_end").over(before).alias("_carried"))
    w = Window.partitionBy("_part", "_range").orderBy(*_ORDER)
    latest = F.greatest(F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    rows = rows.join(F.broadcast(ends), ["_part", "_range"]).withColumn("_apart", F.datediff("start_date", latest)).drop("_carried")
    began = rows.groupBy("_part", "_range").agg(*[F.count_if(F.col("_apart") > g).alias(f"_n{g}") for g in gaps])
    began = began.select("_part", "_range", *[F.coalesce(F.sum(f"_n{g}").over(before), F.lit(0)).alias(f"_b{g}") for g in gaps])
    own = lambda g: F.count_if(F.col("_apart") > g).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumns({f"_s{g}": own(g) for g in gaps}).join(F.broadcast(began), ["_part", "_range"])
    return _by_gap(out.withColumns({f"_s{g}": F.col(f"_s{g}") + F.col(f"_b{g}") for g in gaps}).drop("_range", *[f"_b{g}" for g in gaps]), gaps)


def _by_gap(rows: DataFrame, gaps: list[int]) -> DataFrame:
    grid = F.array(*[F.struct(F.lit(g).alias("gap"), F.col(f"_s{g}").alias("segment")) for g in gaps])
    return rows.select("*", F.inline(grid)).drop("_apart", *[f"_s{g}" for g in gaps])


def _parts(df: DataFrame, gaps: list[int], share: int, few: int, ranges: int) -> tuple[DataFrame, DataFrame | None]:
    """(segments of all usual entities, those of entities with more than one in ``share`` of the rows, None without such)."""
    rows = _dated(df, gaps)
    hot = hot_hashes(rows.filter("key is not null").select("key"), ["key"], share, few)  # a known key is its part
    if not hot:
        return _numbered(rows, gaps), None
    is_hot = F.xxhash64("_part").isin(hot)
    return _numbered(rows.filter(~is_hot), gaps), _numbered_in_ranges(rows.filter(is_hot), gaps, ranges)


def segments(df: DataFrame, gaps: list[int] = (1,), share: int = 500, few: int = 100_000, ranges: int = 200) -> DataFrame:
    """Rows with ``gap``, ``key`` and ``segment``, its number within the key.

    A segment begins where a start lies more than ``gap`` days after the latest
    end so far.  Rows without dates or with end before start are left out; rows
    without an entity have a null key and stay single.  The latest end does not
    depend on the gap, so all gaps share one shuffle and one sort, and rows are
    multiplied only afterwards.  An entity with more than one in ``share`` of the
    rows (of tables above ``few`` rows) is cut into ``ranges`` of start days.
    """
    cold, hot = _parts(df, list(gaps), share, few, ranges)
    return cold if hot is None else cold.unionByName(hot)


def _spread(column: str, over=None) -> Column:
    """Whether a column has more than one value; nulls do not count."""
    low, high = (F.min(column), F.max(column)) if over is None else (F.min(column).over(over), F.max(column).over(over))
    return F.coalesce(low < high, F.lit(False))


def audit(parts: DataFrame, area_tolerance: float = 2.0) -> DataFrame:
    """One row a segment of a known entity: its size and conflicts.  More than one category or too wide a range blocks."""
    out = parts.filter("key is not null").groupBy(*_SEGMENT).agg(
        F.count("*").alias("rows"), F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), _spread("layout").alias("category_conflict"),
        F.coalesce(F.max("area") - F.min("area") > area_tolerance, F.lit(False)).alias("area_conflict"), _spread("station").alias("secondary_differs"),
    )
    return out.withColumnRenamed("_part", "key").withColumn("blocked", F.col("category_conflict") | F.col("area_conflict"))


def episodes(df: DataFrame, gaps: list[int] = (1,), area_tolerance: float = 2.0, share: int = 500, few: int = 100_000, ranges: int = 200) -> DataFrame:
    """Merged intervals: the first row's attributes, least start, latest end, rows merged and a status.

    Blocked segments give their rows unchanged (``conflicting_metadata``), rows
    without an entity too (``missing_id``).  What a segment needs are aggregates
    over its own partition, so one exchange serves all steps, and only the columns
    that are asked for travel.  Segments of very large entities (see
    :func:`segments`) are aggregated before they are shuffled.
    """
    cold, hot = _parts(df, list(gaps), share, few, ranges)
    facts = {"rows": F.count("*"), "_last": F.max("end_date"), "_kinds": F.min("layout") < F.max("layout"), "_wide": F.max("area") - F.min("area") > area_tolerance}
    own = Window.partitionBy(*_SEGMENT)
    parts = cold.withColumns({"_no": F.row_number().over(own.orderBy(*_ORDER)), **{name: _over(name, own, area_tolerance) for name in facts}})
    if hot is not None:
        first = F.min(F.struct(*_ORDER)).alias("_first")
        sums = hot.groupBy(*_SEGMENT).agg(first, *[c.alias(name) for name, c in facts.items()])
        met = hot.join(sums.hint("merge"), _SEGMENT)  # a segment of very many rows is dealt out where the join is skewed
        parts = parts.unionByName(met.withColumn("_no", F.when(F.struct(*_ORDER) == F.col("_first"), 1).otherwise(2)).drop("_first").select(*parts.columns))
    parts = parts.withColumn("_blocked", (F.coalesce("_kinds", F.lit(False)) | F.coalesce("_wide", F.lit(False))) & F.col("key").isNotNull())
    out = parts.filter("_blocked or _no = 1")
    status = F.when(F.col("key").isNull(), "missing_id").when(F.col("_blocked"), "conflicting_metadata").when(F.col("rows") > 1, "merged").otherwise("single")
    kept = [c for c in df.columns if c not in ("start_date", "end_date", "duration", "start_year", "start_month", "rows", "status", "gap", "entity")]
    out = out.withColumns({"status": status, "end_date": F.when(F.col("_blocked"), F.col("end_date")).otherwise(F.col("_last")), "rows": F.when(F.col("_blocked"), F.lit(1)).otherwise(F.col("rows"))})
    return out.select(
        "gap", F.col("key").alias("entity"), *kept, "start_date", "end_date", F.datediff("end_date", "start_date").alias("duration"), F.year("start_date").alias("start_year"),
        F.month("start_date").alias("start_month"), "rows", "status",
    )


def _over(name: str, own, area_tolerance: float) -> Column:
    if name == "rows":
        return F.count("*").over(own)
    if name == "_last":
        return F.max("end_date").over(own)
    if name == "_kinds":
        return F.min("layout").over(own) < F.max("layout").over(own)
    return F.max("area").over(own) - F.min("area").over(own) > area_tolerance


def sensitivity(df: DataFrame, gaps: list[int] = (0, 1, 7, 14), area_tolerance: float = 2.0) -> DataFrame:
    """Per gap: rows, episodes, merged and blocked segments, mean duration.

    One segmentation of the few columns that count; segments are aggregated where they lie.
    """
    narrow = df.select("row_id", "building_id", "unit_id", "start_date", "end_date", "layout", "area")
    days = F.datediff("end_date", "start_date")
    s = segments(narrow, gaps).groupBy(*_SEGMENT).agg(
        F.count("*").alias("n"), F.first("key").isNotNull().alias("known"), F.sum(days).alias("single_days"), F.datediff(F.max("end_date"), F.min("start_date")).alias("merged_days"),
        _spread("layout").alias("kinds"), F.coalesce(F.max("area") - F.min("area") > area_tolerance, F.lit(False)).alias("wide"),
    )
    s = s.withColumn("blocked", F.col("known") & (F.col("kinds") | F.col("wide")))
    out = s.groupBy("gap").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(1)).alias("episodes"), F.count_if(~F.col("blocked") & (F.col("n") > 1)).alias("merged"),
        F.count_if("known").alias("segments"), F.count_if(F.col("known") & (F.col("n") > 1)).alias("several"), F.count_if("blocked").alias("blocked"),
        F.sum(F.when(F.col("blocked"), F.col("single_days")).otherwise(F.col("merged_days"))).alias("days"),
    )
    return out.select("gap", "rows", "episodes", "merged", "segments", "several", "blocked", (F.col("days") / F.col("episodes")).alias("mean_days"))
