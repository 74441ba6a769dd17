"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths, and tables once they are written, of the open :func:`scratch` blocks of this thread or task, the innermost last.
_OPEN: ContextVar[tuple[dict[str, DataFrame | None], ...]] = ContextVar("open scratch blocks", default=())

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a local session gets one of its own; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, not
    what was stored before, and a later read starts from the files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    own = _OPEN.get()[-1] if _OPEN.get() else {}
    own[path] = None
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    own[path] = out = spark.read.schema(df.schema).parquet(path)
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored within the block are deleted at its end, whatever happens, but for those given to the function that it yields.

    What is returned from the block must not read the others, so it is a stored
    table itself.  An outer block takes over what an inner one kept.  Blocks of
    different threads do not know of each other.
    """
    own: dict[str, DataFrame | None] = {}
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.update(path for path, t in own.items() if t is table)
        return table

    around = _OPEN.get()
    _OPEN.set((*around, own))
    try:
        yield keep
    finally:
        _OPEN.set(around)
        for path, table in own.items():
            if path not in kept:
                delete(spark, path)
            elif around:
                around[-1][path] = table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored table, to be broadcast if it has at most ``most`` rows, else left to a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.count() <= most else table
