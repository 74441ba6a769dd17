"""Corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Between stages the result is written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from durata.llm.classifiers import classifier, scored
from durata.llm.decontaminate import without_matches
from durata.llm.ftrl import held_out
from durata.llm.jaccard_join import representatives
from durata.llm.mixing import WORD, drawn, mix_sources
from durata.llm.sharding import shard_rows
from durata.llm.tables import scratch, stored, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go.

    Null and empty texts, and texts of blanks alone, say nothing and stay, whatever
    the classifier's bias.  Repeated rows share their fate, also under several ids;
    an empty table stays empty.  A classifier that has learned nothing, without
    labels or with one kind alone, calls nothing toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = unused("_score", docs.columns), unused("_predicted", docs.columns)
    scorer = classifier(docs.select("doc_id", "text"), labels, "toxic", usable=~held_out(F.col("doc_id"), 5, 0))
    if not len(scorer.known):
        return docs
    silent = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return scored(docs, scorer, "toxic", score_col=score, predicted_col=predicted).filter((F.col(predicted) == 0) | silent).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, similarity 0.8, that with the smallest id.

    Rows are judged by their texts: null and repeated ids are rows like any other,
    of equal rows one stays.  Null and empty texts link with nothing and stay; an
    empty table stays empty.
    """
    return representatives(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by its own text, whatever its id.

    Null and empty texts stay; repeated rows share their fate; an empty benchmark
    keeps all; an empty table stays empty.
    """
    return without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix draws them, so a ``doc_id`` may have several rows, or none.

    A null source is a source of its own.  Null and empty texts cost nothing and
    stay.  Repeated rows are drawn each on their own; an empty table stays empty.
    """
    return drawn(docs, mix_sources(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each drawn document's shard and slot.

    The id decides the shard; null ids count as -1.  Repeated rows get a slot each;
    null and empty texts have size 8; an empty table gives no rows.
    """
    return shard_rows(docs, shards=24)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier and the similarity components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what the stage stored on its way goes
            docs = keep(stored(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
