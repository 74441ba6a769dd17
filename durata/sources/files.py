"""Text, CSV, Parquet and JSON in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prepare import fingerprint, fingerprint_columns, require_same

_MARK = T.StructType([T.StructField("rows", T.LongType()), T.StructField("content", T.StringType())])


def read_text_table(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", keep: list[str] | None = None, source: bool = False) -> DataFrame:
    """All columns as text by position, never inferred; a malformed line fails the read.  Only ``keep`` is parsed.

    With ``source``, each row also tells where it was read: ``source_file``,
    ``source_block`` (the first byte of its part of the file) and ``source_row``,
    its number within the part.  The three name a row for as long as the file and
    the size of the parts stay as they are.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    chosen = [F.col(c) for c in keep or columns]
    if not source:
        return df.select(*chosen)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(*chosen, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"), row.alias("source_row"))


def extract(df: DataFrame, condition: Column, path: str, about: dict[str, str]) -> None:
    """Write the rows that meet ``condition`` as Parquet to ``path/rows``, and ``about`` with the numbers of rows seen and kept as one JSON row to ``path/about``.

    Both numbers are observed while the rows are written: the source is read once.
    """
    seen = Observation()
    kept = F.coalesce(condition, F.lit(False))
    watched = df.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(kept).alias("kept"))
    watched.filter(kept).write.mode("errorifexists").parquet(f"{path}/rows")
    row = {**about, "seen": seen.get["seen"], "kept": seen.get["kept"]}
    df.sparkSession.createDataFrame([row]).coalesce(1).write.mode("errorifexists").json(f"{path}/about")


def load_prepared(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or CSV (gzip too) with a schema; an empty table is an error."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("CSV needs a schema")
        df = spark.read.schema(schema).option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def save_csv(df: DataFrame, path: str) -> None:
    """Refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_marked(df: DataFrame, path: str) -> dict:
    """Write Parquet and, beside it, the fingerprint of what was written, observed in the same pass.  Refuses to overwrite."""
    seen = Observation("fingerprint")
    df.observe(seen, *fingerprint_columns(df)).write.mode("errorifexists").parquet(path)
    mark = {"rows": seen.get["rows"], "content": seen.get["content"]}
    _mark(df.sparkSession, path, "table", mark)
    return mark


def _mark(spark: SparkSession, path: str, of: str, mark: dict) -> None:
    spark.createDataFrame([(mark["rows"], mark["content"])], _MARK).coalesce(1).write.mode("errorifexists").json(f"{path.rstrip('/')}.{of}-fingerprint")


def marked(spark: SparkSession, path: str, of: str = "table") -> dict:
    """The fingerprint kept beside the table at ``path``: that of the ``table`` itself or of its ``input``."""
    return load_json(spark, f"{path.rstrip('/')}.{of}-fingerprint", _MARK).first().asDict()


def load_same(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``, which must still hold the rows that were written there."""
    df = spark.read.parquet(path)
    require_same(fingerprint(df).first().asDict(), marked(spark, path), f"the table {path}")
    return df


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame], source: DataFrame | None = None) -> DataFrame:
    """The Parquet table at ``path``; where there is none, ``build()`` is written there first.

    With ``source``, its fingerprint is kept beside the table, and a table that was
    built from other rows, or from an unknown source, is refused.
    """
    now = fingerprint(source).first().asDict() if source is not None else None
    try:
        df = spark.read.parquet(path)
    except AnalysisException:
        save_marked(build(), path)
        if now:
            _mark(spark, path, "input", now)
        return spark.read.parquet(path)
    if now:
        try:
            before = marked(spark, path, "input")
        except AnalysisException:
            raise ValueError(f"the table {path} does not tell what it was built from") from None
        require_same(now, before, f"the input of {path}")
    return df
