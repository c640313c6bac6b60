"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is two aggregations and two joins; every round's edges are written to the
shared folder, so a lost executor costs a reread. The number of rounds grows with the
logarithm of the longest path. No edge or label reaches the driver: only a count and a
checksum of each round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node among the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a > b")


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b``: each node of an edge list (two long columns) that isn't the smallest of its component, and that smallest.

    Loops, repeated and null edges count for nothing; without edges the result is empty.
    """
    edges = edges.select(F.greatest(*edges.columns).alias("a"), F.least(*edges.columns).alias("b")).where("a > b").distinct()
    before = None
    while True:
        edges = written(edges, "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges
        before = now
        edges = _small_star(_large_star(edges).distinct()).distinct()


#: Items of a large list that every one of its tiles holds, about.
PIVOTS = 8


def components_of_lists(filed: DataFrame, names: list[str], item: str, size: Column, limit: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components, as ``components`` gives them, over the links within each list.

    ``filed`` has a row for each list (columns ``names``), item (a long) and payload;
    ``compare`` takes such rows, in tasks that hold whole lists, sorted by list, tile
    and item, and gives links ``a``, ``b`` that join whatever is linked within a list.
    A list of more than ``limit`` (sum of ``size``) is dealt out by tiles of half of that, each
    with some common pivots. As a rule that joins most of a large list; what is outside of
    its largest component so far is then held against all tiles. So no link is lost, and
    a list whose members are alike costs about as much a member as a small one.
    """
    totals = filed.groupBy(*names).agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_n")).where(F.col("_size") > limit)
    heavy = written(totals.withColumn("_tiles", F.ceil(F.col("_size") / (limit // 2))), "heavy")
    own = F.pmod(F.xxhash64(item), F.col("_tiles"))
    pivot = F.pmod(F.xxhash64(item, F.lit("pivot")), F.col("_n")) < PIVOTS
    every = F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)

    def dealt(rows: DataFrame, tiles: Column) -> DataFrame:
        # Each tile is a list of its own; small lists are tile 0.
        payload = [c for c in filed.columns if c not in names]
        return rows.select(*names, F.explode(tiles).alias("tile"), *payload).repartition(*names, "tile").sortWithinPartitions(*names, "tile", item)

    known = small(heavy, 64)
    first = F.when(F.col("_tiles").isNull(), F.array(F.lit(0).cast("long"))).when(pivot, every).otherwise(F.array(own))
    roots = components(compare(dealt(filed.join(known, names, "left"), first)))
    if heavy.isEmpty():
        return roots
    rooted = filed.join(known, names).join(roots.select(F.col("a").alias(item), F.col("b").alias("_root")), item, "left").withColumn("_root", F.coalesce("_root", item))
    rooted = written(rooted, "rooted")
    main = rooted.groupBy(*names, "_root").agg(F.sum(size).alias("_part")).groupBy(*names).agg(F.max_by("_root", F.struct("_part", "_root")).alias("_main"), F.sum("_part").alias("_all"), F.max("_part").alias("_most"))
    main = written(main.where("_most < _all").select(*names, "_main", F.ceil((F.col("_all") - F.col("_most")) / (limit // 2)).alias("_outer")), "main")
    if main.isEmpty():
        return roots
    crossed = rooted.join(small(main, 64), names)
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_outer") - 1), lambda a: a * (1 << 31) + own)
    outside = F.transform(every, lambda b: F.pmod(F.xxhash64(item, F.lit("outer")), F.col("_outer")) * (1 << 31) + b)
    both = F.when(F.col("_root") == F.col("_main"), beside).otherwise(F.array_distinct(F.concat(beside, outside)))
    return components(roots.union(compare(dealt(crossed, both))))


class Forest:
    """Union-find over 0..n-1 within one task; an element's root is the smallest of its set."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while a.size:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := root[root], root):
                root[:] = jumped
