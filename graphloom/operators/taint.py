"""Taint: reachability between methods, then checks inside methods on their statements.

Statements: method, at (position), kind, defs, uses, calls, next (positions that may
follow). What needs the order of a method's statements runs on one method at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small, written
from .contracts import best_tier

CALL_STEPS = ("CALLS",)


def taint_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame, hops: int = 12) -> DataFrame:
    """Shortest ways from a source to each sink that pass no sanitizer: source, sink, path, category, confidence.

    sources: id; sinks: id, category; sanitizers: id. Of equal ways the first by ids
    stays. Confidence falls with the hops: .9, less .05 each, .5 at least.
    """
    steps = written(edges.where(F.col("kind").isin(list(CALL_STEPS))).select("src", "dst").distinct().join(sanitizers.select(F.col("id").alias("dst")), "dst", "left_anti"), "steps")
    front = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path")).distinct()
    seen = written(front.select("source", "at"), "seen")
    found = front
    for _ in range(hops):
        step = steps.join(small(front, 512), F.col("at") == F.col("src")).select("source", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        fresh = step.join(seen, ["source", "at"], "left_anti").groupBy("source", "at").agg(F.min("path").alias("path"))
        front = written(fresh, "front")
        if front.isEmpty():
            break
        found, seen = found.unionByName(front), seen.union(front.select("source", "at"))
    hop = F.size("path") - 1
    ends = found.join(sinks.select(F.col("id").alias("at"), "category"), "at")
    return ends.select("source", F.col("at").alias("sink"), "path", "category", F.round(F.greatest(F.lit(0.5), 0.9 - 0.05 * (hop - 1)), 6).alias("confidence")).orderBy(F.desc("confidence"), F.size("path"), "source", "sink")


def merged_rules(*rules: DataFrame) -> DataFrame:
    """Rules (kind: source, sink or sanitizer; pattern; category) of several origins, the first origin of a kind and pattern wins."""
    return best_tier(rules, ["kind", "pattern"], ["category"]).drop("tier")


def matched_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Nodes whose id holds a rule's pattern: id, kind, pattern, category. Rules are few, so they go to the scan of the nodes."""
    r = rules.select(F.col("kind").alias("rule"), "pattern", "category")
    found = nodes.select("id").join(F.broadcast(r), F.expr("contains(id, pattern)"))
    return found.select("id", F.col("rule").alias("kind"), "pattern", "category").distinct()


def straight_line(statements: list[dict], tainted: Iterable[str], sinks: Iterable[str]) -> tuple[list[int], bool]:
    """Liveness without control flow: the places where a call whose name holds a sink's gets a tainted argument, and whether a tainted name is returned.

    A statement that reads or passes a tainted name taints what it defines; nothing is
    ever clean again.
    """
    dirty, hits, returns = set(tainted), [], False
    for s in sorted(statements, key=lambda s: s["at"]):
        read, passed = bool(dirty & set(s["uses"])), bool(dirty & set(s.get("args") or s["uses"]))
        if passed and any(p in c for c in s["calls"] for p in sinks):
            hits.append(s["at"])
        if read or passed:
            dirty |= set(s["defs"])
        returns |= s["kind"] == "return" and read
    return hits, returns


def confirm_straight(statements: DataFrame, params: DataFrame, sinks: Sequence[str]) -> DataFrame:
    """Per method: sink calls that a tainted parameter reaches in a straight line, whether it returns, and the factor: 1.15 confirmed, .75 not."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [{**r, **{c: [] if r[c] is None else list(r[c]) for c in ("defs", "uses", "calls")}} for r in frame.to_dict("records")]
        start = rows[0]["params"]
        hits, returns = straight_line(rows, [] if start is None else list(start), sinks)
        return pd.DataFrame({"method": [rows[0]["method"]], "hits": [len(hits)], "returns": [returns], "factor": [1.15 if hits else 0.75]})

    return statements.join(params, "method", "left").groupBy("method").applyInPandas(run, "method string, hits int, returns boolean, factor double")


def flow(statements: list[dict]) -> dict[int, list[int]]:
    """What may follow each statement; without a list the next one."""
    places = [s["at"] for s in statements]
    after = dict(zip(places, places[1:], strict=False))
    return {s["at"]: [int(n) for n in s["next"]] if s["next"] is not None else [after[s["at"]]] if s["at"] in after else [] for s in statements}


def dominators(next_: dict[int, list[int]], entry: int) -> dict[int, int]:
    """The immediate dominator of each statement that the entry reaches, by intersecting along the reverse post-order until nothing changes."""
    order, state = [], {}
    stack = [(entry, iter(next_.get(entry, ())))]
    state[entry] = 1
    while stack:
        node, rest = stack[-1]
        child = next((c for c in rest if c not in state and c in next_), None)
        if child is None:
            order.append(node)
            stack.pop()
        else:
            state[child] = 1
            stack.append((child, iter(next_[child])))
    place = {n: i for i, n in enumerate(order)}
    before: dict[int, list[int]] = {n: [] for n in order}
    for n in order:
        for m in next_[n]:
            if m in before:
                before[m].append(n)
    up = {entry: entry}
    changed = True
    while changed:
        changed = False
        for n in reversed(order):
            if n == entry:
                continue
            known = [b for b in before[n] if b in up]
            best = known[0]
            for other in known[1:]:
                while best != other:
                    if place[best] < place[other]:
                        best = up[best]
                    else:
                        other = up[other]
            if up.get(n) != best:
                up[n], changed = best, True
    return up


def reaching(statements: list[dict]) -> dict[int, set[tuple[str, int]]]:
    """Definitions (name, place) that reach each statement, by the usual fixpoint of gen and kill."""
    next_ = flow(statements)
    defs = {s["at"]: set(s["defs"]) for s in statements}
    into: dict[int, set[tuple[str, int]]] = {s["at"]: set() for s in statements}
    work = [s["at"] for s in statements]
    while work:
        n = work.pop(0)
        out = {d for d in into[n] if d[0] not in defs[n]} | {(v, n) for v in defs[n]}
        for m in next_[n]:
            if m in into and not out <= into[m]:
                into[m] |= out
                work.append(m)
    return into


def dependences(statements: list[dict]) -> list[tuple[int, int, str]]:
    """Data dependences (definition to use) and control dependences (branch to what it dominates but doesn't join)."""
    if not statements:
        return []
    into, next_ = reaching(statements), flow(statements)
    data = {(place, s["at"], "data") for s in statements for name, place in into[s["at"]] if name in s["uses"]}
    up = dominators(next_, statements[0]["at"])
    control = {(b, n, "control") for n, b in up.items() if n != b and len(next_[b]) > 1}
    return sorted(data | control)


def tainted_uses(statements: list[dict], start: Iterable[str], sinks: set[str], sanitizers: set[str]) -> list[int]:
    """Places where a sink is called with a tainted name: a definition from tainted uses is tainted, from a sanitizer's call clean; until nothing changes."""
    next_ = flow(statements)
    by = {s["at"]: s for s in statements}
    into: dict[int, set[str]] = {n: set() for n in by}
    if statements:
        into[statements[0]["at"]] = set(start)
    work, hits = list(by), set()
    while work:
        s = by[work.pop(0)]
        now = into[s["at"]]
        dirty = bool(now & set(s["uses"]))
        if dirty and sinks & set(s["calls"]):
            hits.add(s["at"])
        out = now - set(s["defs"])
        if dirty and not sanitizers & set(s["calls"]):
            out |= set(s["defs"])
        for m in next_[s["at"]]:
            if m in into and not out <= into[m]:
                into[m] |= out
                work.append(m)
    return sorted(hits)


def confirm(statements: DataFrame, params: DataFrame, sinks: set[str], sanitizers: set[str]) -> DataFrame:
    """Per method: how many sink calls a tainted parameter reaches, and the factor for the confidence: 1.30 confirmed, .60 cleaned, .85 without a sink. A method's statements fit a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(frame.to_dict("records"), key=lambda r: r["at"])
        rows = [{**r, **{c: [] if r[c] is None else list(r[c]) for c in ("defs", "uses", "calls")}} for r in rows]
        start = rows[0]["params"]
        hits = tainted_uses(rows, [] if start is None else list(start), sinks, sanitizers)
        has = any(sinks & set(r["calls"]) for r in rows)
        return pd.DataFrame({"method": [rows[0]["method"]], "hits": [len(hits)], "factor": [1.30 if hits else 0.60 if has else 0.85]})

    return statements.join(params, "method", "left").groupBy("method").applyInPandas(run, "method string, hits int, factor double")


def refined(paths: DataFrame, confirmed: DataFrame, least: float = 0.5) -> DataFrame:
    """Paths with confidences times the factor of the method before the sink, 1 at most; those under ``least`` go."""
    last = F.try_element_at("path", F.lit(-2))
    scored = paths.withColumn("method", F.coalesce(last, F.element_at("path", -1))).join(confirmed.select("method", "factor"), "method", "left")
    return scored.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("confidence") * F.coalesce("factor", F.lit(1.0))), 6)).where(F.col("confidence") >= least).drop("method", "factor")


def taint_edges(paths: DataFrame) -> DataFrame:
    """TAINT_FLOW edges from source to sink."""
    return paths.select(F.col("source").alias("src"), F.col("sink").alias("dst"), F.lit("TAINT_FLOW").alias("kind"), "confidence", F.col("category").alias("reason"), F.to_json(F.struct((F.size("path") - 1).alias("hops"), "category")).alias("props"))
