"""Lexical search (BM25), vector search and their fusion by reciprocal ranks.

An index is written once: postings clustered by term, each with its document's length,
and one row of statistics beside them. A query reads the row groups that may hold its
terms and nothing of the texts. It can be kept under a path with the version of what it
was built from, and is read again only by that version.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine_distance
from ..sources.scratch import written

K1, B, RANK_OFFSET = 1.2, 0.75, 60


@dataclass(frozen=True)
class SearchIndex:
    """postings: term, id, tf, length (of the document), clustered by term; and the number of documents with their mean length."""

    postings: DataFrame
    n: int
    mean_length: float


def build_index(texts: DataFrame, key: str = "id", text: str = "text", path: str | None = None, version: str = "") -> SearchIndex:
    """Tokenise every text once and write the index, under ``path`` if one is given. Documents without a token aren't part of it."""
    terms = texts.select(F.col(key).alias("id"), tokens(F.col(text)).alias("terms")).where(F.size("terms") > 0)
    counted = terms.select("id", F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term")).groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    clustered = counted.select("term", "id", "tf", "length").repartitionByRange("term").sortWithinPartitions("term", "id")
    postings = written(clustered, "postings") if path is None else _kept(clustered, f"{path}/postings")
    # A document is in the index as often as its first term by name: once.
    n, total = postings.groupBy("id").agg(F.max("length").alias("length")).agg(F.count(F.lit(1)), F.sum("length")).first()
    index = SearchIndex(postings, n, (total or 0) / n if n else 0.0)
    if path is not None:
        spark = texts.sparkSession
        spark.createDataFrame([(version, n, index.mean_length)], "version string, n long, mean_length double").coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    return index


def load_index(spark: SparkSession, path: str, version: str = "") -> SearchIndex | None:
    """The index under the path, or None if it isn't there or was built from another version: then it has to be built anew. Statistics are written last, so half an index is none."""
    try:
        row = spark.read.parquet(f"{path}/statistics").first()
        postings = spark.read.parquet(f"{path}/postings")
    except AnalysisException:
        return None
    return SearchIndex(postings, row.n, row.mean_length) if row is not None and row.version == version else None


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25(index: SearchIndex, query: str, limit: int = 10) -> DataFrame:
    """id, score, rank of the best documents; a repeated query word counts each time; ties by id."""
    spark = index.postings.sparkSession
    words = Counter(spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q")).alias("t")).first().t)
    own = index.postings.where(F.col("term").isin(list(words)))  # a filter that the scan uses: terms are clustered
    times = F.create_map(*(F.lit(x) for pair in (words or {"": 0}).items() for x in pair))[F.col("term")]
    seen = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(index.mean_length)))
    weights = own.join(F.broadcast(seen), "term").groupBy("id").agg(F.round(F.sum(idf * tf * times), 6).alias("score"))  # a row for each word of the query
    return ranked(weights.where("score > 0"), limit)


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    order = (F.desc("score"), "id")
    return scores.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(vectors: DataFrame, query: list[float], key: str = "id", vector: str = "embedding", limit: int = 10, most: float = 0.5) -> DataFrame:
    """Exact search by cosine distance up to ``most``: id, score (1 - distance), rank."""
    distance = cosine_distance(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return ranked(vectors.select(F.col(key).alias("id"), distance.alias("d")).where(F.col("d") <= most).select("id", F.round(1 - F.col("d"), 6).alias("score")), limit)


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion: id, score, lexical and semantic score."""
    part = lambda df, name: df.select("id", (1 / (RANK_OFFSET + F.col("rank"))).alias(f"{name}_part"), F.col("score").alias(f"{name}_score"))
    both = part(lexical, "lexical").join(part(semantic, "semantic"), "id", "full_outer")
    score = F.round(F.coalesce("lexical_part", F.lit(0.0)) + F.coalesce("semantic_part", F.lit(0.0)), 9)
    return both.select("id", score.alias("score"), "lexical_score", "semantic_score").orderBy(F.desc("score"), "id").limit(limit)
