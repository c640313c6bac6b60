import pytest
from graphs import BAR, CALLEE, CALLER, HANDLER, LISTENER, QUERY, ROUTE, TABLE_, TOPIC, contract, plain
from pyspark.sql import functions as F

from graphloom.engine import Completeness, Engine, Page
from graphloom.operators import aggregates, clustering, contracts, lookup, taint, traversal


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_resolution_and_pages(spark):
    nodes, edges = contract(spark)
    assert ids(lookup.by_name(nodes, "caller")) == [CALLER] and ids(lookup.by_id(nodes, "none")) == []
    page = lookup.neighbor_page(nodes, edges, CALLER, "in", limit=1)
    assert ids(page) == [HANDLER, LISTENER]  # one and the probe
    after = lookup.neighbor_page(nodes, edges, CALLER, "in", after=("getThings", HANDLER), limit=1)
    assert ids(after) == [LISTENER] and Page(page, 1).has_more and not Page(after, 1).has_more
    with pytest.raises(ValueError):
        lookup.edge_kinds(["NO_SUCH"])
    with pytest.raises(ValueError):
        lookup.node_kind("Thing")


def test_tests(spark):
    nodes, edges = contract(spark)
    assert ids(lookup.test_coverage(nodes, edges, CALLEE)) == ["Method:com.acme.BarTest#testCallee/0", "Method:com.acme.BarTest#testClass/0"]
    assert set(ids(lookup.untested(nodes, edges))) == {CALLER, HANDLER, LISTENER}
    found = {(r.test, r.via) for r in lookup.tests_for_files(nodes, edges, spark.createDataFrame([(BAR,)], "file string")).collect()}
    assert {t for t, v in found if v == "direct"} == {"Method:com.acme.BarTest#testCallee/0", "Method:com.acme.BarTest#testClass/0"}


def test_execution_steps_cross_routes_and_topics(spark):
    nodes, edges = contract(spark)
    steps = {(r.src, r.dst) for r in lookup.execution_edges(edges).collect()}
    assert (ROUTE, HANDLER) in steps and (TOPIC, LISTENER) in steps and (CALLEE, QUERY) in steps
    flow = {r.id: r.depth for r in Engine(nodes, edges).trace_flow(ROUTE, 6).collect()}
    assert flow[HANDLER] == 1 and flow[CALLER] == 2 and flow[TABLE_] == 5 and flow[LISTENER] == 5


def test_impact_with_cycle_and_hub(spark):
    nodes, edges = contract(spark)
    rows = {r.id: (r.depth, r.parent, r.risk) for r in traversal.impact(nodes, edges, CALLEE).collect()}
    assert rows == {CALLER: (1, CALLEE, "low"), HANDLER: (2, CALLER, "low"), LISTENER: (2, CALLER, "low")}
    hub = plain(spark, [(f"caller{i:03d}", "hub") for i in range(204, -1, -1)])
    page = lookup.neighbor_page(*hub, "hub", limit=200)
    assert len(ids(page)) == 201 and ids(page)[0] == "caller000"
    walk = traversal.reach(*hub, spark.createDataFrame([("hub",)], "id string"), "up", 2, node_budget=100)
    assert not walk.complete and walk.evaluated == 205


def test_diamond_and_paths(spark):
    nodes, edges = plain(spark, [("root", "alpha", 0.8), ("root", "beta"), ("alpha", "common"), ("beta", "common", 0.7), ("common", "root"), ("common", "tail")])
    walk = traversal.reach(nodes, edges, spark.createDataFrame([("root",)], "id string"))
    assert {r.id: (r.depth, r.parent) for r in walk.rows.collect()} == {"root": (0, None), "alpha": (1, "root"), "beta": (1, "root"), "common": (2, "alpha"), "tail": (3, "common")} and walk.complete
    paths = [(r.path, r.hops, r.confidence) for r in traversal.shortest_paths(edges, "root", "tail").collect()]
    assert paths == [(["root", "alpha", "common", "tail"], 3, 0.8), (["root", "beta", "common", "tail"], 3, 0.7)]
    assert traversal.shortest_paths(edges, "tail", "root").isEmpty()
    assert len(traversal.call_chains(edges, "root", "tail", 4).collect()) == 2
    depth = {r.id: r.total for r in traversal.transitive_loop_depth(nodes.withColumn("loop_depth", F.when(F.col("id") == "tail", 2).otherwise(1)), edges.where("src <> 'common' OR dst <> 'root'")).collect()}
    assert depth == {"tail": 2, "common": 3, "alpha": 4, "beta": 4, "root": 5}


def test_process_traces_do_not_repeat(spark):
    nodes, edges = plain(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "e", 0.3)])
    traces = [r.path for r in traversal.trace_processes(edges, spark.createDataFrame([("a",)], "id string"), least_steps=3).collect()]
    assert ["a", "b", "c", "d"] in traces and all(len(set(p)) == len(p) and "e" not in p for p in traces)


def test_order_of_rows_does_not_matter(spark):
    nodes, edges = contract(spark)
    shuffled = Engine(nodes.orderBy(F.rand(3)), edges.orderBy(F.rand(4)))
    assert Engine(nodes, edges).impact(CALLEE).collect() == shuffled.impact(CALLEE).collect()


def test_integrity_and_dedup(spark):
    nodes, edges = contract(spark)
    faults = aggregates.integrity(nodes, edges).first()
    assert (faults.nodes, faults.edges, faults.duplicate_edges, faults.dangling_ends) == (11, 12, 1, 0)
    assert aggregates.merged_edges(edges).count() == 11


def test_two_cliques_split(spark):
    clique = lambda n: [(a, b) for i, a in enumerate(n) for b in n[i + 1 :]]
    pairs = clique("abcde") + clique("vwxyz") + [("e", "v")]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")
    found = {r.id: r.community for r in clustering.communities(edges).collect()}
    assert {found[x] for x in "abcde"} == {"a"} and {found[x] for x in "vwxyz"} == {"v"}
    again = {r.id: r.community for r in clustering.communities(edges.orderBy(F.desc("a"))).collect()}
    assert again == found
    member = spark.createDataFrame(list(found.items()), "id string, community string")
    assert clustering.modularity(edges, member) > 0.4


def test_taint_between_methods(spark):
    _, edges = plain(spark, [("src", "mid"), ("mid", "sink"), ("src", "clean"), ("clean", "sink2")])
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    sinks = spark.createDataFrame([("sink", "sql"), ("sink2", "sql")], "id string, category string")
    rows = taint.taint_paths(edges, one("src"), sinks, one("clean")).collect()
    assert [(r.source, r.sink, r.path, r.confidence) for r in rows] == [("src", "sink", ["src", "mid", "sink"], 0.85)]
    assert taint.taint_paths(edges, one("none"), sinks, one("clean")).isEmpty()


def statements(*rows):
    return [{"at": i, "kind": "s", "defs": d, "uses": u, "calls": c, "next": n} for i, (d, u, c, n) in enumerate(rows)]


def test_taint_inside_methods(spark):
    straight = statements((["q"], ["p"], [], None), ([], ["q"], ["exec"], None))
    assert taint.tainted_uses(straight, ["p"], {"exec"}, {"esc"}) == [1]
    cleaned = statements((["q"], ["p"], ["esc"], None), ([], ["q"], ["exec"], None))
    assert taint.tainted_uses(cleaned, ["p"], {"exec"}, {"esc"}) == []
    killed = statements((["q"], ["p"], [], None), (["q"], [], [], None), ([], ["q"], ["exec"], None))
    assert taint.tainted_uses(killed, ["p"], {"exec"}, {"esc"}) == []
    branch = statements((["q"], ["p"], [], [1, 2]), (["q"], [], [], [2]), ([], ["q"], ["exec"], []))
    assert taint.tainted_uses(branch, ["p"], {"exec"}, {"esc"}) == [2]
    assert taint.dominators(taint.flow(branch), 0) == {0: 0, 1: 0, 2: 0}
    assert (0, 2, "data") in taint.dependences(branch) and (1, 2, "data") in taint.dependences(branch)
    schema = "method string, at int, kind string, defs array<string>, uses array<string>, calls array<string>, next array<int>"
    table = spark.createDataFrame([(m, s["at"], "s", s["defs"], s["uses"], s["calls"], s["next"]) for m, body in (("m", straight), ("k", killed)) for s in body], schema)
    params = spark.createDataFrame([("m", ["p"]), ("k", ["p"])], "method string, params array<string>")
    assert {r.method: (r.hits, r.factor) for r in taint.confirm(table, params, {"exec"}, {"esc"}).collect()} == {"m": (1, 1.3), "k": (0, 0.6)}


def test_contracts_need_two_repositories(spark):
    p = spark.createDataFrame([("a", "r1", "ANY", "/x"), ("a", "r2", "GET", "/y")], "repo string, id string, method string, path string")
    c = spark.createDataFrame([("b", "c1", "POST", "/x"), ("b", "c2", "POST", "/y"), ("a", "c3", "GET", "/y")], p.schema)
    assert [(r.provider_id, r.consumer_id) for r in contracts.http_contracts(p, c).collect()] == [("r1", "c1")]


def test_completeness_never_claims_what_was_left_out():
    for total in (None, 0, 3, 5):
        for attempted in range(6):
            for failed in range(3):
                for limited in (False, True):
                    c = Completeness(total, attempted, failed, limited)
                    if c.complete:
                        assert not failed and not c.omitted and (total is not None or not limited)
