"""Operators that SQL can't express, or whose rules the shared tables don't reach, against brute force and small known cases."""

import random

import numpy as np
import pandas as pd
import pytest
from graphs import BAR, CALLEE, CALLER, HANDLER, contract, plain
from pyspark.sql import functions as F

from graphloom import registry
from graphloom.engine import Engine
from graphloom.functions import render
from graphloom.functions import text as X
from graphloom.functions import vectors as V
from graphloom.operators import clustering, contracts, projections, resolution, search, similarity, taint, traversal
from graphloom.sources import build, stores


def depths(own, calls, cap=20):
    """The rule as it is told: depth first in the order of ids, an open node adds nothing."""
    total, open_, recursive = {}, set(), set()

    def visit(n):
        open_.add(n)
        below = 0
        for m in sorted(calls.get(n, ())):
            if m in total:
                below = max(below, total[m])
            elif m in open_:
                recursive.add(m)
            else:
                below = max(below, visit(m))
        open_.discard(n)
        total[n] = min(cap, own.get(n, 0) + below)
        return total[n]

    for n in sorted(own):
        if n not in total:
            visit(n)
    return total, recursive


def test_loop_depths_without_cycles(spark):
    rng = random.Random(1)
    own = {f"n{k:02d}": rng.randrange(4) for k in range(40)}
    pairs = {(a, b) for a in own for b in rng.sample(sorted(own), 2) if a < b}
    nodes = spark.createDataFrame(list(own.items()), "id string, loop_depth int")
    got = {r.id: (r.total, r.recursive) for r in traversal.transitive_loop_depth(nodes, spark.createDataFrame(list(pairs), "src string, dst string")).collect()}
    calls = {a: {y for x, y in pairs if x == a} for a in own}
    total, _ = depths(own, calls)
    assert got == {n: (t, False) for n, t in total.items()}


def test_loop_depths_with_cycles(spark):
    own = dict(a=1, b=2, c=1, d=3, e=1, top=1, lone=2)
    pairs = [("top", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("e", "e"), ("e", "d"), ("top", "e"), ("d", "outside")]
    nodes = spark.createDataFrame(list(own.items()), "id string, loop_depth int")
    got = {r.id: (r.total, r.recursive) for r in traversal.transitive_loop_depth(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}
    calls = {n: {y for x, y in pairs if x == n} for n in [*own, "outside"]}
    total, recursive = depths(own, calls)
    assert got == {n: (total[n], n in recursive) for n in own} and recursive == {"a", "e"}


def test_linearized(spark):
    def order(rows):
        parents = spark.createDataFrame([(c, p, k) for c, ps in rows.items() for k, p in enumerate(ps)], "child string, parent string, place int")
        return {r.type: r.mro for r in resolution.linearized(parents).collect()}

    class O: ...  # noqa: E742, E701
    class A(O): ...  # noqa: E701
    class B(O): ...  # noqa: E701
    class C(A, B): ...  # noqa: E701
    class D(B): ...  # noqa: E701
    class E(C, D): ...  # noqa: E701

    rows = {k.__name__: [b.__name__ for b in k.__bases__] for k in (A, B, C, D, E)}
    got = order(rows)
    assert all(got[k.__name__] == [m.__name__ for m in k.__mro__ if m is not object] for k in (O, A, B, C, D, E))
    cyclic = order({"x": ["y"], "y": ["x"], "z": ["x"]})
    assert set(cyclic) == {"x", "y", "z"} and all(v[0] == k and len(set(v)) == len(v) for k, v in cyclic.items())


def test_innermost_scopes(spark):
    rng = random.Random(2)
    scopes = [(k, rng.randrange(3), a := rng.randrange(50), a + rng.randrange(-2, 20)) for k in range(60)]
    sites = [(k, rng.randrange(4), rng.randrange(70)) for k in range(200)]
    got = {r.site: r.scope for r in contracts.innermost(spark.createDataFrame(sites, "site int, file int, at int"), spark.createDataFrame(scopes, "scope int, file int, first int, last int")).collect()}
    want = {}
    for s, f, at in sites:
        if found := [(b - a, k) for k, g, a, b in scopes if g == f and a <= at <= b]:
            want[s] = min(found)[1]
    assert got == want


def brute_traces(pairs, entries, branching, depth, least_steps):
    after = {a: sorted({y for x, y in pairs if x == a})[:branching] for a in {x for x, _ in pairs}}
    out = {}
    for e in entries:
        found, stack = [], [[e]]
        while stack:
            path = stack.pop()
            longer = [[*path, n] for n in after.get(path[-1], ()) if n not in path] if len(path) <= depth else []
            stack += longer
            if not longer and len(path) >= least_steps:
                found.append(path)
        out[e] = sorted(found, key=lambda p: (-len(p), p))[: 3 * branching]
    return {tuple(p) for ps in out.values() for p in ps}


def test_traces_against_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)})
    _, edges = plain(spark, pairs)
    entries = ["n0", "n1", "n2"]
    start = spark.createDataFrame([(e,) for e in entries], "id string")
    traces = traversal.trace_processes(edges, start, 0.5, 3, 5, 3)
    got = {tuple(r.path) for r in traces.collect()}
    want = brute_traces(pairs, entries, 3, 5, 3)
    assert got == want
    inside = lambda a, b: len(a) < len(b) and any(b[k : k + len(a)] == a for k in range(len(b)))
    whole = {p for p in want if not any(inside(p, q) for q in want)}
    best = {}
    for p in sorted(whole, key=lambda p: (-len(p), "->".join(p))):
        best.setdefault((p[0], p[-1]), p)
    assert {tuple(r.path) for r in traversal.longest_per_pair(traversal.without_parts(traces)).collect()} == set(best.values())


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(400)}" for _ in range(80)] for _ in range(10)]
    rows = []
    for k in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((k, words))
    signed = spark.createDataFrame(rows, "id long, words array<string>").select("id", similarity.minhash(F.col("words")).alias("signature"))
    signatures = {r.id: np.array(r.signature) for r in signed.collect()}
    pairs, members = similarity.similar_pairs(signed, 0.7)
    named = {r.id: r["class"] for r in members.collect()}
    got = {(r.a, r.b): r.similarity for r in pairs.collect()}
    assert named == {k: min(j for j, t in signatures.items() if (s == t).all()) for k, s in signatures.items()}
    heads = sorted(set(named.values()))
    want = {(a, b): float((signatures[a] == signatures[b]).mean()) for a in heads for b in heads if a < b and (signatures[a] == signatures[b]).mean() >= 0.7}
    assert got == pytest.approx(want)
    # MinHash estimates the Jaccard similarity of the runs of three words.
    runs = {k: set(zip(w, w[1:], w[2:], strict=False)) for k, w in rows}
    errors = [abs((signatures[a] == signatures[b]).mean() - len(runs[a] & runs[b]) / len(runs[a] | runs[b])) for a in range(20) for b in range(a)]
    assert np.mean(errors) < 0.05


def test_communities_are_connected_and_modular(spark):
    rng = random.Random(5)
    groups = {f"n{k:02d}": k % 4 for k in range(48)}
    names = sorted(groups)
    pairs = {(a, b) for a in names for b in names if a < b and rng.random() < (0.5 if groups[a] == groups[b] else 0.02)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, weight double")
    found = clustering.communities(edges)
    member = {r.id: r.community for r in found.collect()}
    assert len({(groups[n], c) for n, c in member.items()}) == 4 == len(set(member.values()))
    m, degree = len(pairs), {n: sum(n in p for p in pairs) for n in names}
    plain_q = sum(1 for a, b in pairs if member[a] == member[b]) / m - sum((sum(degree[n] for n in names if member[n] == c) / (2 * m)) ** 2 for c in set(member.values()))
    assert abs(clustering.modularity(edges, found) - plain_q) < 1e-9 and plain_q > 0.5


def test_subgraph_and_reaches_say_when_they_stop(spark):
    nodes, edges = plain(spark, [("hub", f"n{k}") for k in range(30)] + [(f"n{k}", f"m{k}") for k in range(30)])
    root = spark.createDataFrame([("hub",)], "id string")
    whole = traversal.subgraph(nodes, edges, root, 2)
    assert not whole.inconclusive and whole.nodes.count() == 61 and whole.edges.count() == 60
    cut = traversal.subgraph(nodes, edges, root, 2, node_budget=10)
    assert cut.inconclusive and cut.nodes.count() == 10
    assert traversal.subgraph(nodes, edges, root, 2, edge_budget=20).inconclusive
    assert traversal.reaches(nodes, edges, "hub", "m3", 4) == "reachable" and traversal.reaches(nodes, edges, "m3", "hub", 4) == "not reachable"
    assert traversal.reaches(nodes, edges, "hub", "none", 4, node_budget=5) == "inconclusive"
    layer, all_ = traversal.expand_layer(edges, root, "down", edge_budget=7)
    assert layer.count() == 7 and not all_


def test_contained_projection(spark):
    nodes = spark.createDataFrame([(f"n{k}", "File", f"n{k}", "aggregate", 1, 100 - k) for k in range(20)], "id string, kind string, name string, role string, member_count long, degree long")
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", "CALLS", k) for k in range(19)], "src string, dst string, kind string, n long")
    some = projections.contained(projections.Projection(nodes, edges, False), 900)
    kept = {r.id for r in some.nodes.collect()}
    assert some.truncated and 0 < len(kept) < 20 and all(r.src in kept and r.dst in kept for r in some.edges.collect())
    assert not projections.contained(projections.Projection(nodes, edges, False), 1 << 20).truncated


def test_cross_repository_ways_with_fewer_hops(spark):
    """A node met first over links is met again over calls, and what lies beyond it is found."""
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "x"), ("r", "x", "y")], "repo string, src string, dst string")
    links = spark.createDataFrame([("r", "a", "q", "p"), ("q", "p", "r", "x"), ("r", "y", "q", "z")], "consumer_repo string, consumer_id string, provider_repo string, provider_id string")
    got = {(r.repo, r.id): (r.depth, r.hops) for r in contracts.cross_repository_trace(edges, links, "r", "a", 6, 2).collect()}
    assert got["r", "x"] == (2, 0) and got["q", "z"] == (5, 1)


def test_cursors_and_catalogue(tmp_path):
    codec = registry.Cursors(b"key", 60)
    c = codec.encode("list", {"b": [2, 1], "a": None}, ["x", 3], now=1000)
    assert codec.decode(c, "list", {"b": [1, 2]}, now=1050) == ["x", 3]
    for bad in (lambda: codec.decode(c, "other", {"b": [1, 2]}, now=1050), lambda: codec.decode(c, "list", {"b": [1]}, now=1050), lambda: codec.decode(c, "list", {"b": [1, 2]}, now=1061), lambda: codec.decode("A" + c[1:], "list", {"b": [1, 2]}, now=1050), lambda: registry.Cursors(b"k").decode(c, "list", {"b": [1, 2]}, now=1050)):
        with pytest.raises(registry.CursorError):
            bad()
    own = registry.Catalogue(str(tmp_path / "c.json"))
    for k in range(5):
        own.upsert(f"repo{k}", head=str(k), groups=["g"] if k % 2 else [])
    own.upsert("repo1", head="new")
    first = own.page(codec, limit=2)
    second = own.page(codec, first["next"], 2)
    assert [r["name"] for r in first["repos"] + second["repos"]] == [f"repo{k}" for k in range(4)] and first["revision"] == 6
    assert [r["name"] for r in own.page(codec, group="g")["repos"]] == ["repo1", "repo3"] and own.load()["repos"]["repo1"]["head"] == "new"
    for name in ("", "../up", "a/b", "a b"):
        with pytest.raises(ValueError):
            registry.group_name(name)
    assert registry.group_name("my_group-1") == "my_group-1"


def test_plugins_stages_and_diffs(spark):
    nodes, edges = plain(spark, [("a", "b")])
    found, heard = registry.Plugins(), []
    found.add(30, "late", lambda n, e: (n.limit(0), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *e.columns[2:])))
    found.add(20, "early", lambda n, e: (n.select(F.lit("c").alias("id"), *n.columns[1:]).limit(1), e.limit(0)))
    found.add(10, "off", lambda n, e: 1 / 0, lambda options: options.get("off", False))
    more = found.augment(nodes, edges, {}, lambda name, phase: heard.append((name, phase)))
    assert [x for x, _ in heard] == ["early", "early", "late", "late"] and (more[0].count(), more[1].count()) == (3, 2)
    with pytest.raises(ValueError):
        found.add(1, "late", lambda n, e: (n, e))
    assert registry.stages_to_run({"a": "1", "b": "1", "c": "1"}, {"a": "1", "b": "2", "c": "1"}, {"c": ["b"]}) == ["b", "c"]
    assert registry.changed_files_of("M\tx.py\nR100\told.py\tnew.py\nA\ty\nD\tz\n") == [("x.py", "modified"), ("old.py", "removed"), ("new.py", "added"), ("y", "added"), ("z", "removed")]
    jobs = registry.Jobs(spark)
    assert jobs.run("r", lambda: spark.range(10).count()) == "done" and jobs.status("r") == "done" and not jobs.cancel("r")


POM = '<project xmlns="http://maven"><parent><groupId>g</groupId><version>2</version></parent><artifactId>app</artifactId><dependencies><dependency><groupId>a</groupId><artifactId>b</artifactId></dependency></dependencies></project>'
BEANS = '<beans><bean id="x" class="p.X"><property name="y" ref="y"/></bean><bean id="y" class="p.Y"/><bean class="p.Z"><constructor-arg><ref bean="x"/></constructor-arg></bean></beans>'
CAMEL = '<routes><route id="in"><from uri="jms:queue:orders?x=1"/><to uri="direct:work"/></route><route><from uri="direct:work"/><to uri="kafka:done"/></route></routes>'


def test_build_files_and_documents(spark):
    files = {
        "pom.xml": POM, "a/package.json": '{"name": "web", "version": "1", "dependencies": {"r": "1"}, "devDependencies": {"t": "2"}}', "b/pyproject.toml": '[project]\nname = "py"\nversion = "3"\ndependencies = ["numpy>=1", "x[y]"]',
        "c/build.gradle": "group = 'g'\nversion '1.2'\ndependencies {\n  implementation 'a:b:1'\n  testImplementation(\"c:d:2\")\n}", "d/setup.cfg": "[metadata]\nname = old\nversion = 0.1\n[options]\ninstall_requires =\n  six>=1\n", "e/package.json": "{broken", "beans.xml": BEANS, "routes.xml": CAMEL, "readme.md": "no",
        "bomb.xml": '<!DOCTYPE x [<!ENTITY a "b">]><beans><bean id="&a;"/></beans>',
    }
    table = spark.createDataFrame([(f, bytearray(t.encode())) for f, t in files.items()], "file string, content binary")
    got = {r.file: r for r in build.read_build_files(table).collect()}
    assert set(got) == {f for f in files if f.rpartition("/")[2] in build.BUILD_FILES}
    assert (got["pom.xml"].grp, got["pom.xml"].version, got["pom.xml"].dependencies, got["pom.xml"].module) == ("g", "2", ["a:b"], "")
    assert got["a/package.json"].dependencies == ["r", "t"] and got["b/pyproject.toml"].dependencies == ["numpy", "x"] and got["b/pyproject.toml"].module == "b"
    assert got["c/build.gradle"].dependencies == ["a:b", "c:d"] and got["c/build.gradle"].version == "1.2" and got["d/setup.cfg"].dependencies == ["six"] and got["e/package.json"].error
    wiring = build.read_wiring(table)
    assert {r.file for r in wiring.where("error IS NOT NULL").collect()} == {"bomb.xml"}
    beans = wiring.where("kind = 'bean'").select("bean", F.col("class").alias("class_id"))
    calls = resolution.wired_calls(wiring.where("kind = 'ref'").select("bean", "ref"), beans)
    assert {(r.src, r.dst) for r in calls.collect()} == {("p.X", "p.Y"), ("p.Z", "p.X")}
    nodes, links = build.integration_graph(build.read_integration(table))
    one, two = "IntegrationRoute:routes.xml#in", "IntegrationRoute:routes.xml#route2"
    assert {(r.src, r.dst) for r in links.collect()} == {("MessageDestination:jms:orders", one), (one, two), (two, "MessageDestination:kafka:done")} and nodes.count() == 4


def test_bundles_caches_and_tables(spark, tmp_path):
    nodes, edges = plain(spark, [("a", "b"), ("b", "c")])
    folder = f"file://{tmp_path}/bundle"
    stores.export_bundle({"nodes": nodes, "edges": edges}, folder, head="abc")
    tables, facts = stores.import_bundle(spark, folder)
    assert facts == {"head": "abc"} and tables["nodes"].count() == 3 and tables["edges"].count() == 2
    with pytest.raises(FileNotFoundError):
        stores.import_bundle(spark, f"file://{tmp_path}/none")
    edges.limit(1).write.mode("overwrite").parquet(f"{folder}/edges")
    with pytest.raises(ValueError):
        stores.import_bundle(spark, folder)
    cache = spark.createDataFrame([("old", "h1", 1), ("other", "h1", 1)], "file string, hash string, n int")
    known, fresh = stores.cached_units(spark.createDataFrame([("new", "h1"), ("more", "h2")], "file string, hash string"), cache)
    assert [(r.file, r.n) for r in known.collect()] == [("new", 1)] and [r.file for r in fresh.collect()] == ["more"]
    vector = "node string, chunk int, hash string, vector array<float>"
    kept = stores.merged_vectors(spark.createDataFrame([("a", 0, "x", [1.0]), ("a", 1, "y", [2.0]), ("gone", 0, "z", [3.0])], vector), spark.createDataFrame([("a", 1, "n", [9.0])], vector), nodes)
    assert {(r.node, r.chunk, r.hash) for r in kept.collect()} == {("a", 0, "x"), ("a", 1, "n")}
    assert stores.node_vectors(kept, nodes.where("id = 'a'")).count() == 2
    root = f"file://{tmp_path}/features"
    some = spark.createDataFrame([("a", "f")], "id string, feature string")
    stores.write_features(some, some, root, "package", "v1")
    stores.write_features(some, some, root, "package", "v2")
    assert stores.read_features(spark, root, "package", "v1") is None and stores.read_features(spark, root, "package", "v2").count() == 1
    match = spark.createDataFrame([("http", "GET /x", "r1", "c1"), ("event", "t", "r2", "c2")], "kind string, match_key string, consumer_repo string, consumer_id string")
    stores.write_contracts(match, f"file://{tmp_path}/contracts")
    assert stores.read_contracts(spark, f"file://{tmp_path}/contracts", ["http"]).count() == 1
    modules = stores.modules_of(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "file string"), spark.createDataFrame([("a",), ("a/b",)], "module string"))
    assert {r.file: r.module for r in modules.collect()} == {"a/b/c.py": "a/b", "a/d.py": "a", "e.py": None}


def test_search_index_is_kept_by_version(spark, tmp_path):
    texts = spark.createDataFrame([(1, "order service handles orders"), (2, "payment service"), (3, "???")], "id int, text string")
    path = f"file://{tmp_path}/index"
    built = search.build_index(texts, path=path, version="v1")
    loaded = search.load_index(spark, path, "v1")
    assert search.bm25(loaded, "order service").collect() == search.bm25(built, "order service").collect() and loaded.n == 2
    assert search.load_index(spark, path, "v2") is None and search.load_index(spark, f"{path}2", "v1") is None
    assert search.bm25(built, "?!").isEmpty() and search.bm25(search.build_index(texts.limit(0)), "order").isEmpty()


def test_wrappers_lookups_and_expressions(spark):
    sites = spark.createDataFrame([(1, "get", "a", "a.py"), (2, "post", "a", "a.py"), (3, "only", "a", "a.py"), (4, "api.get", "a", "a.py"), (5, "nope.get", "a", "a.py"), (6, "get", "z", "z.py")], "site int, callee string, module string, file string")
    wrappers = spark.createDataFrame([("a", "get", None), ("b", "get", None), ("b", "post", "POST"), ("c", "only", None)], "module string, name string, fixed_method string")
    imports = spark.createDataFrame([("a.py", "b", "api")], "file string, raw string, alias string")
    got = {r.site: (r.module, r.name) for r in resolution.http_wrappers(sites, wrappers, imports).collect()}
    assert got == {1: ("a", "get"), 2: ("b", "post"), 3: ("c", "only"), 4: ("b", "get")}
    refs = spark.createDataFrame([(1, "m", "ctor", "p.A", "B", 1, "f", "p"), (2, "m", "type-ref", "p.A", "C", None, "f", "p"), (3, "m", "field-read", "p.A", "x", None, "f", "p"), (4, "m", "ctor", "p.A", "C", 7, "f", "p")], "ref int, src string, kind string, owner string, name string, arity int, file string, package string")
    types = spark.createDataFrame([("p.B", "Class:p.B", "B", "p"), ("q.C", "Class:q.C", "C", "q")], "fqn string, id string, name string, package string")
    defs = spark.createDataFrame([("Ctor:B/1", "p.B", "B", 1, "Constructor"), ("Field:base.x", "p.Base", "x", None, "Field")], "id string, owner string, name string, arity int, kind string")
    imports = spark.createDataFrame([("f", "q.C", False)], "file string, raw string, is_wildcard boolean")
    closure = spark.createDataFrame([("p.A", "p.Base", 1)], "child string, ancestor string, distance int")
    edges = {(r.dst, r.kind, r.confidence) for r in resolution.lookup_edges(refs, defs, types, imports, closure).collect()}
    assert edges == {("Ctor:B/1", "CALLS", 0.85), ("Class:q.C", "USES", 0.9), ("Field:base.x", "ACCESSES", 1.0), ("Class:q.C", "CALLS", 0.9)}
    expressions = spark.createDataFrame([(1, "A", ["b", "c()", "d"]), (2, "A", ["this", "c()"]), (3, "A", ["Z"]), (4, "A", ["b", "none"]), (5, "A", ["unknown", "c"])], "ref int, owner string, parts array<string>")
    bindings = spark.createDataFrame([("A", "b", "B")], "owner string, name string, type string")
    members = spark.createDataFrame([("B", "c", "C"), ("C", "d", "D"), ("A", "c", "X")], "owner string, name string, type string")
    assert {r.ref: r.type for r in resolution.expression_types(expressions, bindings, members).collect()} == {1: "D", 2: "X", 3: "Z"}


def test_nested_types_in_wildcard_packages(spark):
    refs = spark.createDataFrame([(1, "In", "f", "p"), (2, "Top", "f", "p")], "ref int, name string, file string, package string")
    types = spark.createDataFrame([("q.Out.In", "In", "q"), ("q.Top", "Top", "q"), ("z.In", "In", "z")], "fqn string, name string, package string")
    imports = spark.createDataFrame([("f", "q.*", True)], "file string, raw string, is_wildcard boolean")
    assert {r.ref: (r.target, r.confidence) for r in contracts.resolve_types(refs, types, imports).collect()} == {1: ("q.Out.In", 0.72), 2: ("q.Top", 0.75)}


def test_straight_line_taint(spark):
    body = [{"at": 0, "kind": "s", "defs": ["q"], "uses": ["p"], "calls": []}, {"at": 1, "kind": "s", "defs": [], "uses": ["q"], "calls": ["db.execute"]}, {"at": 2, "kind": "return", "defs": [], "uses": ["q"], "calls": []}]
    assert taint.straight_line(body, ["p"], ["exec"]) == ([1], True) and taint.straight_line(body, [], ["exec"]) == ([], False)
    schema = "method string, at int, kind string, defs array<string>, uses array<string>, calls array<string>"
    rows = spark.createDataFrame([(m, s["at"], s["kind"], s["defs"], s["uses"], s["calls"]) for m in "mk" for s in body], schema)
    params = spark.createDataFrame([("m", ["p"])], "method string, params array<string>")
    assert {r.method: (r.hits, r.returns, r.factor) for r in taint.confirm_straight(rows, params, ["exec"]).collect()} == {"m": (1, True, 1.15), "k": (0, False, 0.75)}
    rules = spark.createDataFrame([("sink", "exec", "sql")], "kind string, pattern string, category string")
    nodes = spark.createDataFrame([("Method:a#exec/1",), ("Method:b#run/0",)], "id string")
    assert [(r.id, r.category) for r in taint.matched_rules(nodes, rules).collect()] == [("Method:a#exec/1", "sql")]


def fnv(values):
    h = 14695981039346656037
    for v in values:
        for b in int(v).to_bytes(4, "little"):
            h = (h ^ b) * 1099511628211 % (1 << 64)
    return f"{h:016x}"


def test_band_hash_and_patterns(spark):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(1 << 32) for _ in range(k % 4)]) for k in range(30)]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k int, v array<long>").select("k", V.band_hash(F.col("v")).alias("h")).collect()}
    assert got == {k: fnv(v) for k, v in rows}
    cases = [("*", "a.b", True), ("com.*.X", "com.a.X", True), ("com.*.X", "com.a.b.X", False), ("com..X", "com.a.b.X", True), ("com..X", "com.X", True), ("com..*Dao", "com.p.UserDao", True), ("a.b", "axb", False)]
    for pattern, name, hit in cases:
        assert spark.range(1).select(F.lit(name).rlike(X.type_pattern(pattern))).first()[0] is hit, pattern


def test_feature_profile_has_25_numbers(spark):
    types = spark.createDataFrame([("T", "Class", None, False, 0, 0, 0, False, 5000)], "id string, kind string, stereotype string, is_abstract boolean, annotations int, implements int, extends int, is_test boolean, lines int")
    members = spark.createDataFrame(pd.DataFrame([["T", "Method", 3, 1, 2, *[1] * 7], ["T", "Field", 0, 0, 0, *[0] * 7]], columns=["owner", "kind", "cyclomatic", "cognitive", "loop_depth", *projections.FLOW_COUNTS]))
    row = projections.structural_profiles(types, members).first().profile
    assert len(row) == 25 and row[:9] == [1, 1, 0, 3, 3, 1, 1, 2, 2] and row[24] == 1.0


def test_requests(spark):
    nodes, edges = contract(spark)
    engine = Engine(nodes, edges)
    hits, around = engine.query_expanded("foo caller", 5)
    assert hits.first().id == CALLER and {r.id for r in around.nodes.collect()} >= {CALLER, CALLEE, HANDLER} and not around.truncated
    assert engine.query_expanded("foo caller", 5, byte_budget=200)[1].truncated
    assert engine.route_map("/api").first().handlers == [HANDLER]
    features = spark.createDataFrame([(CALLER, "audit")], "id string, feature string")
    assert {r.id: r.feature for r in engine.feature_map(features, "caller callee").collect()}[CALLER] == "audit"
    page = engine.test_coverage("Bar")
    assert page.rows.count() == 2 and not page.has_more
    assert engine.reaches("getThings", "audit_log", access="write")[0] == "reachable" and engine.reaches("getThings", "audit_log", access="read")[0] == "not reachable"
    assert engine.reaches("getThings", "audit_log", node_budget=1)[0] == "inconclusive"
    rules = spark.createDataFrame([("source", "getThings", "http"), ("sink", "#callee", "sql")], "kind string, pattern string, category string")
    assert [r.path for r in engine.taint_paths(rules).rows.collect()] == [[HANDLER, CALLER, CALLEE]]
    found, dropped = engine.overview()
    assert not dropped and found["entry_points"][0]["id"] == HANDLER and {r["kind"] for r in found["stats"]} >= {"Method", "Route"}
    small_, dropped = engine.overview(byte_budget=400)
    assert dropped[0] == "hotspots" and "stats" in small_
    pages = spark.createDataFrame([("p1", "orders and payments", "dev"), ("p2", "orders", "po")], "id string, text string, role string")
    assert [r.id for r in engine.search_pages(pages, "orders", {"role": "po"}).collect()] == ["p2"]
    assert {r.id for r in engine.detect_changes(spark.createDataFrame([(BAR,)], "file string")).collect()} >= {CALLEE, CALLER, HANDLER}
    with_repo = Engine(nodes, edges.withColumn("repo", F.lit("shop")).unionByName(spark.createDataFrame([("m", "ExternalEndpoint:GET /x", "EXTERNAL_CALL", 1.0, "r", "web"), ("up", "m", "CALLS", 1.0, "r", "web")], [*edges.columns, "repo"])))
    matches = spark.createDataFrame([("GET /x", "shop", "Route:GET /x", "web", "ExternalEndpoint:GET /x", "http")], "match_key string, provider_repo string, provider_id string, consumer_repo string, consumer_id string, kind string")
    own, callers = with_repo.api_impact(matches, "GET /x", 2)
    assert own.count() == 1 and {(r.id, r.depth) for r in callers.collect()} == {("m", 0), ("up", 1)}
    assert with_repo.api_impact(matches, "GET /y")[1].isEmpty() and engine.group_contracts(matches, "event").rows.isEmpty()


def test_labels_layout_and_pages(spark):
    member = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y"), ("4", "y"), ("5", "z"), ("6", "z")], "id string, community string")
    nodes = spark.createDataFrame([("1", "src/orders/A.java"), ("2", "src/orders/B.java"), ("3", "PayOne.java"), ("4", "PayTwo.java"), ("5", "A.java"), ("6", "B.java")], "id string, file string")
    assert {r.community: r.label for r in clustering.heuristic_labels(member, nodes).collect()} == {"x": "orders", "y": "Pay", "z": "Cluster_2"}
    nodes, edges = plain(spark, [(f"n{k}", f"n{k + 1}") for k in range(9)])
    places = render.layout(nodes, edges)
    at = {x: np.array(p) for x, *p in places}
    assert len(at) == 10 and places == render.layout(nodes.orderBy(F.desc("id")), edges) and render.layout(nodes.limit(0), edges) == []
    near, far = np.linalg.norm(at["n0"] - at["n1"]), np.linalg.norm(at["n0"] - at["n9"])
    assert 0 < near < far
    similar = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.8), ("c", "d", 0.9)], "a string, b string, similarity double")
    assert {r.id: r.community for r in clustering.similarity_communities(similar).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    diagram = render.class_diagram(spark.createDataFrame([("A", "B", 3)], "src string, dst string, n long"))
    assert diagram.splitlines() == ["classDiagram", '  class c0["A"]', '  class c1["B"]', "  c0 --> c1 : 3"]


def test_profile_keeps_halves(spark):
    # 119 of 80 methods is 1487.5 thousandths, which rounds up; the nearest float is below that.
    methods = spark.createDataFrame([("T", "Method", 1 + (k < 39), 0, 0, *[None] * 7) for k in range(80)], "owner string, kind string, cyclomatic int, cognitive int, loop_depth int, " + ", ".join(f"{c} int" for c in projections.FLOW_COUNTS))
    types = spark.createDataFrame([("T", "Class", None, False, 0, 0, 0, False, 30)], "id string, kind string, stereotype string, is_abstract boolean, annotations int, implements int, extends int, is_test boolean, lines int")
    row = projections.structural_profiles(types, methods).first().profile
    assert row[3] * 1000 == 1487.5 and row[24] == 0.03
