"""From raw documents to token ids, in five stages.

Each stage reads what its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet to the folder that driver
and executors share and reads it again, so a lost executor never costs more than its
own stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import written
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.near_copies import keep_one_near_copy
from graphloom.llm.piece_codec import round_trip
from graphloom.llm.quality import keep_good, train_quality
from graphloom.llm.queries import labels, piece_model
from graphloom.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, train_toxicity(docs, labels(spark, sf_dir)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the quality threshold go."""
    return keep_good(docs, train_quality(docs, labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (runs of five words, similarity 0.8 or more) the document with the smallest id stays."""
    return keep_one_near_copy(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to some edits, go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and text, what the ids decode to."""
    return round_trip(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: SQL can't express the classifiers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
