"""Summaries, quotient graphs and deduplication of graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..schemas import CALLABLE_KINDS


def summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree; parallel edges count each."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def overview(nodes: DataFrame, edges: DataFrame, structural: Sequence[str], types: Sequence[str], limit: int = 2000) -> DataFrame:
    """Structural nodes first, then types by degree: id, kind, degree, position."""
    ranked = nodes.where(F.col("kind").isin([*structural, *types])).join(degrees(edges).select("id", "degree"), "id", "left")
    group = F.when(F.col("kind").isin(list(structural)), 0).otherwise(1)
    rows = ranked.select("id", "kind", F.coalesce("degree", F.lit(0)).alias("degree"), group.alias("tier"))
    order = ("tier", F.desc("degree"), "id")
    return rows.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order))).drop("tier")


def quotient(edges: DataFrame, membership: DataFrame, limit: int | None = 500) -> DataFrame:
    """How many edges run between different groups: group_a, group_b, n. membership: id, group."""
    a, b = (membership.select(F.col("id").alias(end), F.col("group").alias(name)) for end, name in (("src", "group_a"), ("dst", "group_b")))
    rows = edges.join(a, "src").join(b, "dst").where("group_a <> group_b").groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("n"))
    return rows if limit is None else rows.orderBy(F.desc("n"), "group_a", "group_b").limit(limit)


def quotient_by_kind(edges: DataFrame, membership: DataFrame) -> DataFrame:
    a, b = (membership.select(F.col("id").alias(end), F.col("group").alias(name)) for end, name in (("src", "group_a"), ("dst", "group_b")))
    return edges.join(a, "src").join(b, "dst").where("group_a <> group_b").groupBy("group_a", "group_b", "kind").agg(F.count(F.lit(1)).alias("n"))


def community_weights(edges: DataFrame, least: float = 0.01) -> DataFrame:
    """Undirected weights: of each pair the sum of confidences, each at least ``least``; no loops."""
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.greatest("confidence", F.lit(least)).alias("w"))
    return pair.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Faults of a graph to be published: duplicate ids, duplicate edges, edges with a missing end; and its size."""
    dup = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_nodes"))
    dup_edges = edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_edges"))
    ids = nodes.select("id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    dangling = ends.join(ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("dangling_ends"))
    size = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    return size[0].join(size[1]).join(dup).join(dup_edges).join(dangling)


# How names of utilities and of entries begin and end, and what each kind of entry counts.
UTILITY_STARTS = ("get", "set", "is", "has", "to", "from", "format", "parse", "validate", "convert", "log", "debug")
UTILITY_ENDS = ("Helper", "Util", "Utils")
ENTRY_STARTS = ("main", "init", "execute", "run", "start", "handle", "process", "perform", "dispatch", "trigger", "fire", "emit")
ENTRY_ENDS = ("Handler", "Controller", "Listener", "Endpoint")
MULTIPLIERS = {"http": 3.0, "event": 3.0, "scheduled": 2.0, "main": 2.0}


def entry_points(nodes: DataFrame, edges: DataFrame, limit: int = 200, kinds: Sequence[str] = CALLABLE_KINDS) -> DataFrame:
    """Callees over callers plus one, times a multiplier: id, name, entry (what kind it is), score.

    Handlers of routes and listeners, by their edges or stereotype, count most and stay
    without callees; then scheduled methods and main, names of entries, all others, and
    names of utilities. Tests never score. Ties go by id.
    """
    own = nodes.where(F.col("kind").isin(list(kinds)) & ~F.col("stereotype").eqNullSafe("test")).select("id", "name", "stereotype")
    role = lambda kind, name: edges.where(F.col("kind") == kind).select(F.col("src").alias("id")).distinct().withColumn(name, F.lit(True))
    calls = degrees(edges.where("kind = 'CALLS'")).select("id", "out_degree", "in_degree")
    found = own.join(calls, "id", "left").join(role("HANDLES_ROUTE", "handles"), "id", "left").join(role("LISTENS_TO", "listens"), "id", "left")
    entry = (
        F.when(F.col("handles"), "http").when(F.col("listens"), "event").when(F.col("stereotype").isin("http", "event", "scheduled"), F.col("stereotype"))
        .when((F.col("stereotype") == "main") | (F.col("name") == "main"), "main").otherwise("fanout")
    )
    name = F.col("name")
    utility = name.rlike(f"^({'|'.join(UTILITY_STARTS)})|({'|'.join(UTILITY_ENDS)})$")
    entering = name.rlike(f"^({'|'.join(ENTRY_STARTS)})(?![a-z])|({'|'.join(ENTRY_ENDS)})$")
    factor = F.lit(1.0)
    factor = F.when(utility, 0.3).when(entering, 1.5).otherwise(factor)
    for kind, value in MULTIPLIERS.items():
        factor = F.when(F.col("entry") == kind, value).otherwise(factor)
    callees, callers = F.coalesce("out_degree", F.lit(0)), F.coalesce("in_degree", F.lit(0))
    scored = found.withColumn("entry", entry).where((callees > 0) | F.col("entry").isin("http", "event"))
    return scored.select("id", "name", "entry", F.round(callees / (callers + 1) * factor, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def cohesion(edges: DataFrame, membership: DataFrame, sample: int = 50) -> DataFrame:
    """Share of a group's neighbour links that stay inside, over its first ``sample`` members by id: group, cohesion, members."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy("id"))
    some = membership.withColumn("rank", rank).where(F.col("rank") <= sample).select(F.col("id").alias("src"), "group")
    links = edges.select("src", "dst").union(edges.select("dst", "src"))
    other = membership.select(F.col("id").alias("dst"), F.col("group").alias("other"))
    inside = links.join(some, "src").join(other, "dst", "left").groupBy("group").agg(F.round(F.avg(F.col("group").eqNullSafe(F.col("other")).cast("double")), 6).alias("cohesion"))
    return membership.groupBy("group").agg(F.count(F.lit(1)).alias("members")).join(inside, "group", "left")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge a key: the greatest confidence, the smallest reason that isn't empty."""
    return edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min(F.when(F.col("reason") != "", F.col("reason"))).alias("reason"))


def combined_edges(edges: DataFrame, most: int = 20) -> DataFrame:
    """Structural and resolved edges as one a key, with the greatest confidence and the call sites (array ``sites``) of all, in order, each once, ``most`` at most."""
    by_site = edges.select("src", "dst", "kind", F.explode_outer("sites").alias("site")).distinct()
    rank = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("site"))
    few = by_site.where("site IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= most).groupBy("src", "dst", "kind").agg(F.sort_array(F.collect_list("site")).alias("sites"))
    best = edges.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
    return best.join(few, ["src", "dst", "kind"], "left").select("src", "dst", "kind", "confidence", F.coalesce("sites", F.array().cast("array<string>")).alias("sites"))


def first_nodes(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """One node an id, the first in an order."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("rank = 1").drop("rank")


def route_groups(routes: DataFrame, limit: int = 100) -> DataFrame:
    """Routes by their first meaningful segment (``api`` and version segments are passed over): prefix, n, two samples."""
    segments = F.filter(F.split("path", "/"), lambda s: (s != "") & ~s.rlike("^(api|v[0-9]+)$"))
    rows = routes.select(F.concat(F.lit("/"), F.coalesce(F.get(segments, F.lit(0)), F.lit(""))).alias("prefix"), "path")
    counted = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    firsts = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy("path"))).where("rank <= 2")
    samples = firsts.groupBy("prefix").agg(F.array_join(F.sort_array(F.collect_list("path")), " ").alias("samples"))
    return counted.join(samples, "prefix").orderBy(F.desc("n"), "prefix").limit(limit)


def mean_vectors(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each key and its number of rows. Each task adds up its own rows, so a row a key and task is shuffled, whatever a group's size.

    Each place is the mean of what is known there, so vectors may differ in length and hold
    nulls; null and empty vectors count as rows only. A key without any place has no mean.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            keys, lists = batch.column(0).dictionary_encode("encode"), batch.column(1)
            names, codes = keys.dictionary.to_pylist(), keys.indices.to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            width, values = int(sizes.max(initial=0)), lists.flatten()
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            cell = (np.repeat(codes, sizes) * width + place)[known := pc.is_valid(values).to_numpy(zero_copy_only=False)]
            added = np.bincount(cell, values.to_numpy(zero_copy_only=False)[known].astype(np.float64), len(names) * width).reshape(len(names), width)
            counted = np.bincount(cell, minlength=len(names) * width).reshape(len(names), width)
            length = np.zeros(len(names), dtype=np.int64)
            np.maximum.at(length, codes, sizes)
            for k, n in enumerate(np.bincount(codes, minlength=len(names))):
                s, c, m = total.get(names[k], (np.zeros(0), np.zeros(0, dtype=np.int64), 0))
                own = slice(0, int(length[k]))
                total[names[k]] = (_padded_sum(s, added[k, own]), _padded_sum(c, counted[k, own]), m + int(n))
        if total:
            s, c, n = zip(*total.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), kind), pa.array([x.tolist() for x in s], pa.list_(pa.float64())), pa.array([x.tolist() for x in c], pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["key", "sums", "counts", "n"])

    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = to_arrow_type(rows.schema["key"].dataType)
    parts = rows.mapInArrow(sums, StructType([rows.schema["key"], *StructType.fromDDL("sums array<double>, counts array<long>, n long").fields]))
    added = lambda kind: lambda acc, x: F.zip_with(acc, x, lambda a, b: F.coalesce(a, F.lit(0).cast(kind)) + F.coalesce(b, F.lit(0).cast(kind)))
    every = lambda name, kind: F.aggregate(F.collect_list(name), F.array().cast(f"array<{kind}>"), added(kind))
    grouped = parts.groupBy("key").agg(every("sums", "double").alias("s"), every("counts", "long").alias("c"), F.sum("n").alias("n"))  # a row a task
    return grouped.where(F.size("s") > 0).select(F.col("key").alias(key), F.zip_with("s", "c", lambda x, n: F.when(n > 0, x / n)).alias("mean"), "n")


def _padded_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    out = a.copy()
    out[: len(b)] += b
    return out


def transitions_between(kinds: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that a path touches, and whether it crosses from one to another. kinds: path_id, id; groups: id, group."""
    return kinds.join(groups, "id").groupBy("path_id").agg(F.count_distinct("group").alias("groups")).withColumn("crosses", F.col("groups") > 1)
