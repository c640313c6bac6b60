"""Feature groups of nodes: by package, by structure, by vectors; and their combination."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .aggregates import mean_vectors
from .clustering import communities
from .contracts import hybrid_features
from .similarity import nearest_center, nearest_neighbors

CATCH_ALL = "shared"
# Folders that say nothing of a feature, and names of shared code.
GENERIC = ("src", "main", "test", "java", "kotlin", "python", "com", "org", "net", "io", "impl", "internal", "app", "lib")
SHARED_NAMES = "(?i)(util|helper|common|base|config|constants|exception)"


def package_feature(file: Column) -> Column:
    """A path's feature: the module below ``modules``, else the first folder that isn't generic, else shared."""
    module = F.regexp_extract(file, "(?:^|/)modules/([^/]+)/", 1)
    folders = F.filter(F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0))), lambda s: ~s.isin(list(GENERIC)) & (s != ""))
    return F.coalesce(F.when(module != "", module), F.get(folders, F.lit(0)), F.lit(CATCH_ALL))


def by_package(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", package_feature(F.coalesce("file", F.lit(""))).alias("feature"), F.lit(1.0).alias("confidence"))


def by_structure(nodes: DataFrame, edges: DataFrame, prior: DataFrame, span: int = 3) -> DataFrame:
    """Nodes that two of three signs call shared: their name, their path, callers from ``span`` features or more. Others keep their prior feature."""
    callers = edges.where("kind = 'CALLS'").join(prior.select(F.col("id").alias("src"), "feature"), "src").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("feature").alias("spans"))
    signs = F.col("name").rlike(SHARED_NAMES).cast("int") + F.coalesce("file", F.lit("")).rlike("(?i)(^|/)(shared|common|util[s]?|core)/").cast("int") + (F.coalesce("spans", F.lit(0)) >= span).cast("int")
    joined = nodes.select("id", "name", "file").join(callers, "id", "left").join(prior.select("id", "feature"), "id")
    return joined.select("id", F.when(signs >= 2, CATCH_ALL).otherwise(F.col("feature")).alias("feature"), F.when(signs >= 2, 0.9).otherwise(0.6).alias("confidence"))


def by_centroid(vectors: DataFrame, prior: DataFrame, least: float = 0.65) -> DataFrame:
    """Nodes still in the catch-all go to the feature whose mean vector is nearest, if it is near enough."""
    named = vectors.join(prior.where(F.col("feature") != CATCH_ALL).select("id", "feature"), "id")
    means = mean_vectors(named, "feature").select("feature", "mean")
    rest = vectors.join(prior.where(F.col("feature") == CATCH_ALL).select("id"), "id", "left_semi")
    return nearest_center(rest, means).where(F.col("confidence") >= least)


def by_vector_clusters(vectors: DataFrame, k: int = 15, least: float = 0.65, resolution: float = 0.8) -> DataFrame:
    """Communities of the nearest-neighbour graph, named by their smallest id, with each node's cosine to its community's mean."""
    near = nearest_neighbors(vectors, vectors, k, least)
    pairs = near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), F.col("similarity").alias("weight")).groupBy("a", "b").agg(F.max("weight").alias("weight"))
    found = communities(pairs, resolution)
    joined = vectors.join(found, "id")
    means = mean_vectors(joined, "community").select("community", "mean")
    return joined.join(means, "community").select("id", F.concat(F.lit("cluster-"), F.col("community").cast("string")).alias("feature"), F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("confidence"))


def cluster_names(assigned: DataFrame, nodes: DataFrame, types: Sequence[str] = ("Class", "Interface")) -> DataFrame:
    """A feature's label: the name of its most confident node, types first, of equals by id."""
    joined = assigned.join(nodes.select("id", "name", "kind"), "id")
    order = Window.partitionBy("feature").orderBy(F.when(F.col("kind").isin(list(types)), 0).otherwise(1), F.desc("confidence"), "id")
    return joined.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("feature", F.col("name").alias("label"))


def assign(strategies: Sequence[Callable[[DataFrame | None], DataFrame]]) -> DataFrame:
    """Run strategies in order, each with what the ones before agreed on, and combine them."""
    results: list[DataFrame] = []
    for strategy in strategies:
        results.append(strategy(hybrid_features(results, CATCH_ALL) if results else None))
    return hybrid_features(results, CATCH_ALL)
