"""Communities of a weighted undirected graph by moving nodes, refining and contracting, as joins and aggregations.

In a pass every second node (by a hash that changes) weighs its neighbours'
communities and moves to the one that gains most modularity; of two nodes that are alone only
one moves to the other, so neighbours don't swap places for ever. Communities are then split into connected parts and contracted to nodes
of a smaller graph, on which the same is done. Ties go to the smallest label and hashes
are fixed, so the result is a function of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered, written


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """edges: a, b, weight (each pair once, loops allowed); membership: id, community."""
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return 0.0
    own = lambda side: membership.select(F.col("id").alias(side), F.col("community").alias(f"c{side}"))
    inside = edges.join(own("a"), "a").join(own("b"), "b").where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    degree = _strength(edges).join(membership, "id").groupBy("community").agg(F.sum("k").alias("k"))
    spread = degree.agg(F.sum((F.col("k") / (2 * total)) ** 2)).first()[0]
    return inside / total - resolution * spread


def _strength(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "weight"), F.struct(F.col("b").alias("id"), "weight"))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.weight").alias("k"))


def _move(edges: DataFrame, resolution: float, passes: int) -> DataFrame:
    """Membership (id, community) after local moves from singletons."""
    both = edges.where("a <> b").select("a", "b", "weight").union(edges.where("a <> b").select("b", "a", "weight"))
    both = written(both, "both")
    strength = written(_strength(edges), "strength")
    total = strength.agg(F.sum("k")).first()[0]
    state = written(strength.select("id", F.col("id").alias("community"), "k"), "state")
    for p in range(passes):
        sums = state.groupBy("community").agg(F.sum("k").alias("sigma"), F.count(F.lit(1)).alias("n"))
        links = both.join(state.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("weight").alias("w"))
        mine = state.join(sums.select("community", F.col("n").alias("own")), "community").select("id", F.col("community").alias("old"), "k", "own")
        # Of two nodes that are alone the one with the greater label moves: they never swap places.
        scored = links.join(mine, "id").join(sums, "community").where("NOT (own = 1 AND n = 1 AND community > old)")
        sigma = F.col("sigma") - F.when(F.col("community") == F.col("old"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - resolution * F.col("k") * sigma / F.lit(total)
        best = scored.withColumn("gain", F.round(gain, 9)).groupBy("id").agg(F.max(F.struct("gain", F.when(F.col("community") == F.col("old"), 1).otherwise(0).alias("stay"))).alias("top"), F.collect_set(F.struct("gain", "community")).alias("all"))
        named = best.select("id", F.col("top.gain").alias("gain"), "top.stay", F.array_min(F.transform(F.filter("all", lambda x: x["gain"] == F.col("top.gain")), lambda x: x["community"])).alias("new"))
        turn = F.pmod(F.xxhash64("id", F.lit(p // 2)), F.lit(2)) == p % 2
        alone = scored.where("community = old").select("id", F.round(gain, 9).alias("here"))
        moved = state.join(named, "id", "left").join(alone, "id", "left").select("id", F.when(turn & (F.col("stay") == 0) & (F.col("gain") > F.coalesce("here", F.lit(0.0))), F.col("new")).otherwise(F.col("community")).alias("community"), "k")
        before = state.select("id", F.col("community").alias("was"))
        state = written(moved, "state")
        calm = state.join(before, "id").where("community <> was").isEmpty()
        if p % 2 and calm and still:
            break
        still = calm
    return state.select("id", "community")


def connected_parts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Each community split into its connected parts, named by their smallest node. Labels jump, so rounds grow with the logarithm of the longest path; they go on until nothing changes."""
    own = lambda side: membership.select(F.col("id").alias(side), F.col("community").alias(f"c{side}"))
    inner = edges.join(own("a"), "a").join(own("b"), "b").where("ca = cb AND a <> b").select("a", "b")
    both = written(inner.union(inner.select("b", "a")), "inner")
    label = written(membership.select("id", F.col("id").alias("community")), "label")
    while True:
        least = both.join(label.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id")).agg(F.min("community").alias("near"))
        now = label.join(least, "id", "left").select("id", F.least("community", F.coalesce("near", "community")).alias("community"))
        jumped = now.join(now.select(F.col("id").alias("community"), F.col("community").alias("root")), "community", "left").select("id", F.coalesce("root", "community").alias("community"))
        before = label.select("id", F.col("community").alias("was"))
        label = written(jumped, "label")
        if label.join(before, "id").where("community <> was").isEmpty():
            break
    return label


def contract(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """The graph of communities: summed weights, inner ones as loops."""
    own = lambda side: membership.select(F.col("id").alias(side), F.col("community").alias(f"c{side}"))
    joined = edges.join(own("a"), "a").join(own("b"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "weight")
    return joined.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def communities(edges: DataFrame, resolution: float = 1.0, levels: int = 3, passes: int = 10, least_size: int = 1) -> DataFrame:
    """id, community (the smallest node in it) of every node that an edge touches; communities under ``least_size`` are left out."""
    own = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "graph")
    if own.isEmpty():
        return own.select(F.col("a").alias("id"), F.col("a").alias("community"))
    graph, names = own, None
    for _ in range(levels):
        parts = connected_parts(graph, _move(graph, resolution, passes))
        step = parts if names is None else names.join(parts.select(F.col("id").alias("community"), F.col("community").alias("up")), "community").select("id", F.col("up").alias("community"))
        names = written(step, "names")
        smaller = written(contract(graph, parts), "graph")
        if parts.where("id <> community").isEmpty():
            break
        graph = smaller
    sized = names.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return names.join(sized.where(F.col("n") >= least_size), "community").select("id", F.col("least").alias("community"))


def heuristic_labels(membership: DataFrame, nodes: DataFrame, generic: tuple[str, ...] = ("src", "main", "java", "com", "org", "test")) -> DataFrame:
    """A name for each community: the most frequent deepest folder that isn't generic, of equals the first by name; else the stems' longest common beginning of three letters or more; else Cluster_ and its place by name."""
    parts = F.split("file", "/")
    folder = F.try_element_at(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: ~s.isin(list(generic)) & (s != "")), F.lit(-1))
    own = membership.join(nodes.select("id", "file"), "id").select("community", folder.alias("label"), F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", "").alias("stem"))
    counted = own.where("label IS NOT NULL").groupBy("community", "label").agg(F.count(F.lit(1)).alias("n"))
    named = counted.groupBy("community").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("label"))
    # What the first and the last stem share, all share.
    ends = own.groupBy("community").agg(F.min("stem").alias("a"), F.max("stem").alias("b"))
    shared = F.expr("aggregate(sequence(1, least(length(a), length(b)) + 1), 0, (n, k) -> if(substring(a, 1, k) = substring(b, 1, k) AND n = k - 1 AND k <= least(length(a), length(b)), k, n))")
    stem = ends.select("community", F.substring("a", F.lit(1), shared).alias("prefix"))
    place = numbered(membership.select("community").distinct(), "community", "place")
    return place.join(named, "community", "left").join(stem, "community", "left").select("community", F.coalesce("label", F.when(F.length("prefix") >= 3, F.col("prefix")), F.concat(F.lit("Cluster_"), "place")).alias("label"))


def similarity_communities(pairs: DataFrame, resolution: float = 1.0, least_size: int = 2) -> DataFrame:
    """Communities of similar nodes: of each pair (a, b, similarity), in either order, the greatest similarity is the weight."""
    best = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("weight")).where("a <> b")
    return communities(best, resolution, least_size=least_size)


def constant_potts(edges: DataFrame, membership: DataFrame, resolution: float = 0.05) -> float:
    """The constant Potts quality: weight inside communities less resolution for each pair of members."""
    own = lambda side: membership.select(F.col("id").alias(side), F.col("community").alias(f"c{side}"))
    inside = edges.join(own("a"), "a").join(own("b"), "b").where("ca = cb").agg(F.sum("weight")).first()[0] or 0.0
    pairs = membership.groupBy("community").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    return inside - resolution * pairs
