"""Reachability by levels: each level is one join of the frontier with the edges and one anti-join with what was seen.

The steps of a walk are written once, however they were made, and each level scans them;
a frontier whose counted size is small goes to the scan by broadcast, so a level then
shuffles what it finds and no edge. Levels are written to the session's shared folder, so
plans stay short and a lost executor costs a reread. The driver sees a count of each
level, never its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import BROADCAST_BYTES, small, written
from .lookup import bounded, edge_kinds


@dataclass(frozen=True)
class Reached:
    """Rows (id, depth, parent) and whether the walk ended by itself."""

    rows: DataFrame
    complete: bool
    evaluated: int


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) in the order of the walk, repeats included: down follows edges, up goes against them."""
    down, up = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"down": down, "up": up, "both": down.union(up)}[direction]


def reach(nodes: DataFrame, edges: DataFrame, roots: DataFrame, direction: str = "down", depth: int = 4, node_budget: int | None = None, stop: DataFrame | None = None) -> Reached:
    """Breadth-first search from the roots (column id, depth 0) over (src, dst).

    A node's parent is, of its predecessors on the level before, the first by name, then
    id. Nodes of ``stop`` (column id) are reached but not left. With a budget the walk
    stops after the level that exceeds it and isn't complete.
    """
    bounded("depth", depth, 1, 20)
    steps = written(directed(edges, direction), "steps")  # a level groups by node, so repeated edges needn't be shuffled away first
    names = written(nodes.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "names")
    seen = written(roots.select("id").distinct().withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast("string")), "level")
    frontier, size, total = seen, seen.count(), 0
    for level in range(1, depth + 1):
        leave = frontier.select(F.col("id").alias("src"))
        if stop is not None:
            leave = leave.join(stop.select(F.col("id").alias("src")), "src", "left_anti")
        if size * 128 <= BROADCAST_BYTES:
            leave = F.broadcast(names.join(F.broadcast(leave), "src", "right"))
        else:
            leave = leave.join(names, "src", "left")
        parent = F.min(F.struct("src_name", "src"))["src"]
        found = steps.join(leave, "src").groupBy(F.col("dst").alias("id")).agg(F.lit(level).alias("depth"), parent.alias("parent"))
        frontier = written(found.join(seen.select("id"), "id", "left_anti"), "level")
        size = frontier.count()
        if not size:
            return Reached(seen, True, total)
        total += size
        seen = seen.unionByName(frontier)
        if node_budget is not None and total > node_budget:
            return Reached(seen, False, total)
    return Reached(seen, True, total)


def risk(count: Column) -> Column:
    return F.when(count == 0, "none").when(count <= 5, "low").when(count <= 20, "medium").when(count <= 75, "high").otherwise("critical")


def impact(nodes: DataFrame, edges: DataFrame, root: str, direction: str = "up", depth: int = 4, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """What a change of the root reaches: id, name, kind, depth, parent, and the risk that their number means."""
    start = nodes.where(F.col("id") == root).select("id")
    walk = reach(nodes, edges.where(F.col("kind").isin(list(kinds))), start, direction, depth)
    rows = walk.rows.where("depth > 0").join(nodes.select("id", "name", "kind"), "id")
    return rows.select("id", "name", "kind", "depth", "parent", risk(F.lit(walk.evaluated)).alias("risk")).orderBy("depth", "name", "id")


@dataclass(frozen=True)
class Subgraph:
    """Nodes (id, depth) and the edges among them; inconclusive if a budget cut the walk or the edges."""

    nodes: DataFrame
    edges: DataFrame
    inconclusive: bool


def expand_layer(edges: DataFrame, frontier: DataFrame, direction: str = "both", kinds: tuple[str, ...] = (), edge_budget: int = 50_000) -> tuple[DataFrame, bool]:
    """Stored edges at the frontier (column id), each once, in the order of source, target and kind; and whether the budget held them all.

    A loop or an edge between two nodes of the frontier comes once. Empty kinds mean all.
    """
    own = edges.where(edge_kinds(kinds)).select("src", "dst", "kind", "confidence")
    ids = small(written(frontier.select("id").distinct(), "frontier"))
    out = own.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    into = own.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = {"down": out, "up": into, "both": out.unionByName(into)}[direction]
    layer = written(both.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence")).orderBy("src", "dst", "kind").limit(edge_budget + 1), "layer")
    whole = layer.count() <= edge_budget
    return (layer if whole else layer.orderBy("src", "dst", "kind").limit(edge_budget)), whole


def subgraph(nodes: DataFrame, edges: DataFrame, roots: DataFrame, radius: int = 2, kinds: tuple[str, ...] = (), node_budget: int | None = None, edge_budget: int | None = None) -> Subgraph:
    """Nodes within a radius of the roots over edges of any direction, and the edges with both ends among them.

    With a node budget the walk stops after the level that exceeds it; of the nodes the
    nearest stay, of equals the first by id. Edges beyond their budget are cut in the
    order of source, target and kind. Either makes the answer inconclusive.
    """
    own = edges.where(edge_kinds(kinds))
    walk = reach(nodes, own, roots, "both", bounded("radius", radius, 1, 20), node_budget)
    ids, cut = walk.rows.select("id", "depth"), not walk.complete
    if cut:
        ids = ids.orderBy("depth", "id").limit(node_budget)
    ids = written(ids, "inside")
    known = small(ids.select("id"))
    inside = own.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    if edge_budget is not None:
        inside = written(inside.orderBy("src", "dst", "kind").limit(edge_budget + 1), "edges")
        if inside.count() > edge_budget:
            inside, cut = inside.orderBy("src", "dst", "kind").limit(edge_budget), True
    return Subgraph(ids, inside, cut)


def reaches(nodes: DataFrame, edges: DataFrame, source: str, target: str, depth: int = 8, node_budget: int | None = None) -> str:
    """``reachable``, ``not reachable``, or ``inconclusive`` if the budget ended the walk before the target was met."""
    spark = edges.sparkSession
    walk = reach(nodes, edges, spark.createDataFrame([(source,)], "id string"), "down", depth, node_budget, spark.createDataFrame([(target,)], "id string"))
    if not walk.rows.where((F.col("id") == target) & (F.col("depth") > 0)).isEmpty():
        return "reachable"
    return "not reachable" if walk.complete else "inconclusive"


def shortest_paths(edges: DataFrame, source: str, target: str, depth: int = 8, most: int = 10) -> DataFrame:
    """All shortest paths between two nodes, in order: path (array of ids), hops, confidence of the weakest edge.

    Parallel edges count once, with their best confidence. Levels keep every
    predecessor, so no shortest path is lost; ``most`` limits what is returned.
    """
    bounded("depth", depth, 1, 12)
    best = written(edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence")), "steps")
    spark = edges.sparkSession
    paths = spark.createDataFrame([(source, [source], 1.0)], "at string, path array<string>, confidence double")
    seen = spark.createDataFrame([(source,)], "at string")
    for hops in range(1, depth + 1):
        step = paths.withColumnRenamed("confidence", "weakest").join(best, F.col("at") == F.col("src")).join(seen.select(F.col("at").alias("dst")), "dst", "left_anti")
        paths = written(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), F.least("weakest", "confidence").alias("confidence")), "paths")
        if not paths.where(F.col("at") == target).isEmpty():
            found = paths.where(F.col("at") == target)
            return found.select("path", F.lit(hops).alias("hops"), "confidence").orderBy("path").limit(most)
        if paths.isEmpty():
            break
        seen = written(seen.union(paths.select("at").distinct()), "seen")
    return spark.createDataFrame([], "path array<string>, hops int, confidence double")


def call_chains(edges: DataFrame, source: str, target: str, depth: int = 4, most: int = 25) -> DataFrame:
    """Paths without repeated nodes between two nodes, shortest first."""
    steps = written(edges.select("src", "dst").distinct(), "steps")
    spark = edges.sparkSession
    paths, out = spark.createDataFrame([(source, [source])], "at string, path array<string>"), None
    for _ in range(depth):
        paths = written(paths.join(steps, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")), "chains")
        done = paths.where(F.col("at") == target).select("path")
        out = done if out is None else out.union(done)
        paths = paths.where(F.col("at") != target)
    return out.select("path", (F.size("path") - 1).alias("hops")).orderBy("hops", "path").limit(most)


def trace_processes(edges: DataFrame, entries: DataFrame, least_confidence: float = 0.5, branching: int = 4, depth: int = 10, least_steps: int = 3, states: int = 50_000) -> DataFrame:
    """Paths from entry points (column id) that never repeat a node: entry, path.

    At each step the ``branching`` smallest targets are followed. A path ends where
    nothing follows or at the depth; of each entry the longest 3 * branching with enough
    steps stay. An entry has ``states`` paths at most, itself and the first of each level in
    order; a path of which none is followed further ends there.
    """
    best = edges.where(F.col("confidence") >= least_confidence).select("src", "dst").distinct()
    narrow = best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("rank") <= branching).select("src", "dst")
    narrow = written(narrow, "steps")
    live = entries.select(F.col("id").alias("entry"), F.col("id").alias("at"), F.array("id").alias("path"), F.lit(1).cast("long").alias("used"))
    ended = None
    for _ in range(depth):
        next_ = live.join(narrow, F.col("at") == F.col("src"), "left").withColumn("fits", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", F.lit(""))))
        longer = next_.where("fits").select("entry", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), "used")
        first = longer.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("path"))).where(F.col("rank") + F.col("used") <= states)
        grown = written(first.withColumn("used", F.col("used") + F.count(F.lit(1)).over(Window.partitionBy("entry"))).drop("rank"), "traces")
        last = live.join(grown.select("entry", F.slice("path", 1, F.size("path") - 1).alias("path")).distinct(), ["entry", "path"], "left_anti")
        ended = last if ended is None else ended.unionByName(last)
        live = grown
    done = ended.unionByName(live).select("entry", "path").where(F.size("path") >= least_steps)
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc(F.size("path")), "path"))
    return done.withColumn("rank", rank).where(F.col("rank") <= 3 * branching).drop("rank")


def without_parts(traces: DataFrame) -> DataFrame:
    """The traces that are no contiguous part of a longer one."""
    n = F.size("path")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda s: F.transform(F.sequence(F.lit(1), n - s + 1), lambda k: F.slice("path", s, k))))
    shorter = traces.select(n.alias("n"), F.explode(parts).alias("path")).where(F.size("path") < F.col("n")).select("path").distinct()
    return traces.join(shorter, "path", "left_anti").select(*traces.columns)


def longest_per_pair(traces: DataFrame) -> DataFrame:
    """One trace for each entry and last node: the longest, of equals the first by its text."""
    pair = Window.partitionBy("entry", F.element_at("path", -1)).orderBy(F.desc(F.size("path")), F.array_join("path", "->"))
    return traces.withColumn("rank", F.row_number().over(pair)).where("rank = 1").drop("rank")


def transitive_loop_depth(nodes: DataFrame, edges: DataFrame, cap: int = 20) -> DataFrame:
    """Own loop depth plus the largest transitive one among callees, up to the cap: id, total, recursive.

    Nodes are settled from the leaves up: in each round those all of whose callees are
    settled, so a node is computed once. What remains reaches a cycle. Of it, nodes on
    cycles or between them are walked depth first, in the order of ids, one connected part
    at a time; there a call back to a node that is still open adds nothing and marks that
    node as recursive. The nodes above are then settled as the others were.
    """
    own = nodes.select("id", F.coalesce("loop_depth", F.lit(0)).cast("int").alias("own"))
    calls = written(edges.select("src", "dst").join(own.select(F.col("id").alias("src")), "src", "left_semi").distinct(), "calls")
    wanted = calls.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("left"))
    loops = calls.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    state = own.join(wanted, "id", "left").join(loops, "id", "left").select("id", "own", F.lit(0).alias("below"), F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("loop", F.lit(False)).alias("recursive"))
    # Callees that are no nodes have no loops.
    strangers = calls.select(F.col("dst").alias("id")).distinct().join(own, "id", "left_anti").select("id", F.lit(0).alias("total"))
    total = lambda: F.least(F.col("own") + F.col("below"), F.lit(cap)).alias("total")
    state, settled, done = written(state, "state"), written(strangers, "settled"), None

    def settle(state: DataFrame, settled: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        while True:
            ready = state.where("left = 0").select("id", total(), "recursive")
            done = ready if done is None else done.unionByName(ready)
            settled = written(settled.unionByName(ready.select("id", "total")), "settled")
            if settled.isEmpty():
                return state.where("left > 0"), done
            below = calls.where("src <> dst").join(small(settled.select(F.col("id").alias("dst"), "total")), "dst").groupBy(F.col("src").alias("id")).agg(F.max("total").alias("max"), F.count(F.lit(1)).alias("n"))
            state = written(state.where("left > 0").join(below, "id", "left").select("id", "own", F.greatest("below", F.coalesce("max", F.lit(0))).alias("below"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), "recursive"), "state")
            settled = settled.limit(0)

    state, done = settle(state, settled, done)
    state = written(state, "open")
    if not state.isEmpty():
        core = _core(calls.where("src <> dst"), state.select("id"))
        walked = written(_walked(core, state, cap), "walked")
        done = done.unionByName(walked.select("id", "total", "recursive"))
        above = state.join(walked.select("id"), "id", "left_anti")
        above, done = settle(written(above.where("left > 0"), "state"), walked.select("id", "total"), done)
    return done.select("id", "total", "recursive")


def _core(calls: DataFrame, open_: DataFrame) -> DataFrame:
    """Calls among open nodes on cycles or between them: nodes that none of these call go, until all are called."""
    ids = open_.select(F.col("id").alias("src"))
    inner = written(calls.join(ids, "src", "left_semi").join(ids.select(F.col("src").alias("dst")), "dst", "left_semi"), "core")
    while True:
        called = inner.select(F.col("dst").alias("src")).distinct()
        less = written(inner.join(called, "src", "left_semi"), "core")
        if less.count() == inner.count():
            return less
        inner = less


def _walked(core: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    from .clustering import connected_parts

    ids = core.select(F.col("src").alias("id")).union(core.select("dst")).distinct()
    parts = connected_parts(core.select(F.col("src").alias("a"), F.col("dst").alias("b")), ids.withColumn("community", F.lit("")))
    callees = core.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("callees"))
    rows = parts.join(state, "id").join(callees, "id", "left").select("community", "id", "own", "below", "recursive", F.coalesce("callees", F.array().cast("array<string>")).alias("callees"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        below, own, callees = (dict(zip(frame["id"], frame[c], strict=True)) for c in ("below", "own", "callees"))
        total, open_, recursive = {}, set(), set(frame["id"][frame["recursive"]])
        for root in frame["id"]:
            stack = [] if root in total else [(root, iter(callees[root]))]
            open_.update(x for x, _ in stack)
            while stack:
                at, rest = stack[-1]
                to = next(rest, None)
                if to is None:
                    total[at] = min(cap, own[at] + below[at])
                    open_.discard(at)
                    stack.pop()
                    if stack:
                        below[stack[-1][0]] = max(below[stack[-1][0]], total[at])
                elif to in total:
                    below[at] = max(below[at], total[to])
                elif to in open_:
                    recursive.add(to)
                else:
                    open_.add(to)
                    stack.append((to, iter(callees[to])))
        return pd.DataFrame({"id": list(total), "total": list(total.values()), "recursive": [i in recursive for i in total]})

    return rows.groupBy("community").applyInPandas(walk, "id string, total int, recursive boolean")


def ancestors(parents: DataFrame, depth: int = 20) -> DataFrame:
    """Closure of (child, parent): child, ancestor, distance (the least)."""
    parents = written(parents.select("child", "parent").distinct(), "parents")
    closure = parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    newest = closure
    for d in range(2, depth + 1):
        step = newest.join(parents.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor")).distinct()
        newest = written(step.where("child <> ancestor").join(closure, ["child", "ancestor"], "left_anti").withColumn("distance", F.lit(d)), "closure")
        if newest.isEmpty():
            break
        closure = closure.unionByName(newest)
    return closure


def call_depths(nodes: DataFrame, edges: DataFrame, starts: tuple[str, ...] = ("Route", "Process", "IntegrationRoute", "MessageDestination"), kinds: tuple[str, ...] = ("CALLS", "HANDLES_ROUTE", "EXTERNAL_CALL", "PUBLISHES_EVENT", "LISTENS_TO", "INTEGRATION_LINK"), depth: int = 20) -> DataFrame:
    """Layers for a layout: id, depth from the nearest start; nodes of the start kinds and nodes that nothing calls start, and what no start reaches has depth 0."""
    own = written(edges.where(F.col("kind").isin(list(kinds))), "steps")
    first = nodes.where(F.col("kind").isin(list(starts))).select("id").union(nodes.select("id").join(own.select(F.col("dst").alias("id")), "id", "left_anti"))
    found = reach(nodes, own, first, "down", depth).rows.select("id", "depth")
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def page_chain(edges: DataFrame, start: str, depth: int = 6) -> DataFrame:
    """The chain of calls that a page shows: from the start each time to the first target by id that isn't in it yet; one row (path)."""
    first = written(edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("next")), "steps")
    path = edges.sparkSession.createDataFrame([(start, [start])], "at string, path array<string>")
    for _ in range(depth):
        step = path.join(first, F.col("at") == F.col("src"), "left")
        to = F.get(F.array_except("next", "path"), F.lit(0))
        grown = written(step.select(F.coalesce(to, F.lit("")).alias("at"), F.when(to.isNotNull(), F.concat("path", F.array(to))).otherwise(F.col("path")).alias("path")), "chain")
        if not grown.where("at <> ''").count():
            return grown.select("path")
        path = grown
    return path.select("path")
