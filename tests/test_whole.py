"""Results hold every row whatever the size of groups and levels."""

import random

from pyspark.sql import functions as F

from graphloom.operators import similarity, taint, traversal
from graphloom.plans import catalogue


def test_members_of_equal_signatures(spark, monkeypatch):
    same, other = list(range(64)), [*range(63), 99]
    signed = spark.createDataFrame([(1, same), (2, same), (3, same), (4, other), (5, [-k for k in range(64)]), (6, None)], "id long, signature array<long>")
    monkeypatch.setattr(catalogue, "_signed", lambda spark, d: signed)
    got = {(r.a, r.b): round(r.similarity, 4) for r in catalogue.J34_lsh_pairs(spark, "").collect()}
    assert got == {(1, 2): 1.0, (1, 3): 1.0, (1, 4): round(63 / 64, 4)}


def test_taint_beyond_fifty_thousand(spark):
    leaves = spark.range(50_100).select(F.format_string("t%06d", "id").alias("dst"))
    edges = leaves.select(F.lit("s").alias("src"), "dst", F.lit("CALLS").alias("kind"))
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    sinks = leaves.select(F.col("dst").alias("id"), F.lit("sql").alias("category"))
    assert taint.taint_paths(edges, one("s"), sinks, one("none"), 2).count() == 50_100


def brute_dedup(traces):
    kept, windows = [], set()
    for t in sorted(set(traces), key=lambda t: (-len(t), "->".join(t))):
        if t not in windows:
            kept.append(t)
            windows |= {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    best = {}
    for t in kept:
        best.setdefault((t[0], t[-1]), t)
    return set(best.values())


def test_parts_of_longer_traces_go(spark, monkeypatch):
    rng = random.Random(5)
    traces = [tuple(rng.sample("abcde", rng.randint(1, 5))) for _ in range(60)]
    rows = spark.createDataFrame([(t[0], list(t)) for t in traces], "entry string, path array<string>")
    monkeypatch.setattr(catalogue, "flow_edges", lambda spark, d: spark.createDataFrame([], "src string, dst string"))
    monkeypatch.setattr(traversal, "trace_processes", lambda *a: rows)
    assert {tuple(r.path.split("->")) for r in catalogue.G13_trace_dedup(spark, "").collect()} == brute_dedup(traces)


def test_states_of_each_entry(spark):
    edges = spark.createDataFrame([(a + x, a + y, 1.0) for a in "pqr" for x, y in ("01", "02", "13", "14", "25")], "src string, dst string, confidence double")
    entries = spark.createDataFrame([("p0",), ("q0",), ("r0",)], "id string")
    got = {}
    for r in traversal.trace_processes(edges, entries, least_steps=2, states=4).collect():
        got.setdefault(r.entry, set()).add("".join(x[1] for x in r.path))
    # The entry, two of the first level and one of the second are four.
    assert got == {e: {"013", "02"} for e in ("p0", "q0", "r0")}
