"""Raw text to typed rows with flags, the scope filter with its flow table, and small extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean as C
from .hot import with_count

# Kinds that make a category.
KINDS = ["R", "K", "DK", "LK", "LDK", "SK", "SDK", "SLDK"]


def require(df: DataFrame, columns: list[str], optional: list[str] = ()) -> DataFrame:
    """Raise on missing columns; optional ones that are missing are added as ''."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit("") for c in optional if c not in df.columns})


def prepare(df: DataFrame, strict_walk: bool = False) -> DataFrame:
    """Typed columns beside the text ones; ids are counted, all else is row by row.

    Missing ids are no key: their rows do not meet, however many there are, nor do
    those of an id that very many rows share.
    """
    df = require(df, ["pub_start_date", "pub_end_date"], ["id", "money_room", "house_area", "kenchiku_date", "madori_number_all", "madori_kind_all_label"])
    start, end = C.day(F.col("pub_start_date")), C.day(F.col("pub_end_date"))
    rent = C.number(F.col("money_room"))
    built = C.year_month(F.col("kenchiku_date"))
    rooms, kind = F.col("madori_number_all"), F.col("madori_kind_all_label")
    out = df.withColumns({"start_date": start, "end_date": end, "rent_raw": rent, "area_raw": C.number(F.col("house_area")), "built": built})
    known = C.text(F.col("id"))
    out = with_count(out, F.when(known != "", known), "_same")
    return out.withColumns(
        {
            "duration": F.datediff("end_date", "start_date"),
            "start_year": F.year("start_date"),
            "start_month": F.month("start_date"),
            "rent": C.positive(F.col("rent_raw")),
            "area": C.positive(F.col("area_raw")),
            "rent_missing": ~C.flag(F.col("rent_raw") > 0),
            "area_missing": ~C.flag(F.col("area_raw") > 0),
            "age": C.years_between(F.col("start_date"), F.col("built")),
            "age_build_after_start": C.flag(F.trunc("start_date", "month") < F.col("built")),
            "category": C.category(rooms, kind, KINDS),
            "category_issue": C.category_issue(rooms, kind, KINDS),
            "missing_id": C.text(F.col("id")) == "",
            "repeated_id": F.coalesce(F.col("_same") > 1, F.lit(False)),
        }
    ).drop("_same")


def flow(df: DataFrame, steps: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every step, flow table): what each step saw, took out and left, in one pass."""
    kept, sums = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, condition) in enumerate(steps, 1):
        kept = kept & C.flag(condition)
        sums.append(F.count_if(kept).alias(f"n{i}"))
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i - 1}").alias("before"), (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("excluded"), F.col(f"n{i}").alias("remaining")) for i, (name, _) in enumerate(steps, 1)]
    return df.filter(kept), df.agg(*sums).select(F.inline(F.array(*rows)))


def first_per_id(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each valid id."""
    w = Window.partitionBy("_key").orderBy(*order)
    out = df.withColumn("_key", C.identifier(key)).filter("_key is not null").withColumn("_rn", F.row_number().over(w))
    return out.filter("_rn = 1").drop("_rn", "_key")


def frequent_keys(df: DataFrame, key: str, most: int, placeholders: list[str]) -> DataFrame:
    """``known``: the key, or null if it is a placeholder or occurs in more than ``most`` rows.

    Rows of placeholders are not counted, and those of very frequent keys do not meet in a task.
    """
    real = F.when(~F.col(key).cast("string").isin(placeholders), F.col(key)) if placeholders else F.col(key)
    counted = with_count(df, real, "_n")
    return counted.withColumn("known", F.when(F.col("_n") <= most, F.col(key))).drop("_n")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent values (ties to the smaller), with counts."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def search(df: DataFrame, equal: dict[str, str], most: dict[str, float], text: str = "", text_columns: list[str] = ()) -> DataFrame:
    """Rows that have the given values, stay within upper bounds (nulls do not), and hold ``text`` in one of the columns, whatever its case."""
    keep = F.lit(True)
    for c, v in equal.items():
        keep = keep & (F.col(c) == v)
    for c, v in most.items():
        keep = keep & (F.col(c) <= v)
    if text and text_columns:
        held = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(text.lower()) for c in text_columns]
        keep = keep & F.greatest(*held, F.lit(False))
    return df.filter(keep)


def _row_number(df: DataFrame, columns: list[str] | None) -> Column:
    """60 bits of a digest of a row's texts, their lengths and its nulls."""
    part = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.conv(F.substring(F.md5(F.concat(*[part(c) for c in (sorted(df.columns) if columns is None else columns)])), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint_columns(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """The aggregates of :func:`fingerprint`, which can also be observed while a table is written."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_row_number(df, columns)), F.lit(0)).cast("string").alias("content")]


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-free content sum over the columns (all, by name), to tell whether two tables hold the same rows."""
    return df.agg(*fingerprint_columns(df, columns))


def require_same(found: dict, expected: dict, what: str = "input") -> None:
    """Refuse tables whose fingerprints differ, telling whether rows or values did."""
    if found["rows"] != expected["rows"]:
        raise ValueError(f"{what} has changed: {expected['rows']} rows before, {found['rows']} now")
    if found["content"] != expected["content"]:
        raise ValueError(f"{what} has changed: other values in {found['rows']} rows")
