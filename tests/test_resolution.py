import pytest
from pyspark.sql import functions as F

from graphloom.operators import features, resolution
from graphloom.operators.contracts import best_tier, inherited_by_group, inherited_members, injected, members, overrides, resolve_types
from graphloom.operators.traversal import ancestors

DEFS = "id string, owner string, name string, arity int, kind string, file string, package string"
REFS = "ref string, src string, owner string, receiver string, name string, arity int, file string"


@pytest.fixture(scope="module")
def workspace(spark):
    defs = [
        ("Repo.save/1", "Repo", "save", 1, "Method", "Repo.java", "a"), ("OwnerService.save/1", "OwnerService", "save", 1, "Method", "OwnerService.java", "a"), ("OwnerService.save/2", "OwnerService", "save", 2, "Method", "OwnerService.java", "a"),
        ("Base.log/1", "Base", "log", 1, "Method", "Base.java", "a"), ("Controller.get/0", "Controller", "get", 0, "Method", "Controller.java", "b"), ("Tools.only/0", "Tools", "only", 0, "Function", "Tools.java", "c"),
    ]
    refs = [
        ("r1", "Controller.get/0", "Controller", "svc", "save", 2, "Controller.java"), ("r2", "OwnerService.save/2", "OwnerService", "this", "log", 1, "OwnerService.java"), ("r3", "OwnerService.save/1", "OwnerService", None, "save", 2, "OwnerService.java"),
        ("r4", "Controller.get/0", "Controller", None, "only", 0, "Controller.java"), ("r5", "Controller.get/0", "Controller", "Missing", "x", 0, "Controller.java"), ("r6", "Controller.get/0", "Controller", None, "nothing", 0, "Controller.java"),
    ]
    bindings = spark.createDataFrame([("Controller", "svc", "OwnerService")], "owner string, name string, type string")
    parents = spark.createDataFrame([("OwnerService", "Base"), ("OwnerService", "Repo")], "child string, parent string")
    return spark.createDataFrame(refs, REFS), spark.createDataFrame(defs, DEFS), bindings, ancestors(parents)


def test_calls(spark, workspace):
    refs, defs, bindings, closure = workspace
    got = {(r.src, r.dst): (r.confidence, r.phase) for r in resolution.resolve_calls(refs, defs, bindings, closure).collect()}
    assert got == {
        ("Controller.get/0", "OwnerService.save/2"): (1.0, 1), ("OwnerService.save/2", "Base.log/1"): (0.8, 1), ("OwnerService.save/1", "OwnerService.save/2"): (0.7, 2), ("Controller.get/0", "Tools.only/0"): (0.7, 3),
    }
    done = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "ref string")
    open_ = resolution.classify_unresolved(refs, done, spark.createDataFrame([("other",)], "package string"))
    assert {r.classification: r.n for r in open_.collect()} == {"external": 1, "dynamic": 1}


def test_overrides(spark):
    methods = spark.createDataFrame([("C.m", "C", "m()"), ("B.m", "B", "m()"), ("A.m", "A", "m()"), ("I.m", "I", "m()")], "id string, owner string, signature string")
    closure = ancestors(spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "I")], "child string, parent string"))
    kinds = spark.createDataFrame([("A", "Class"), ("B", "Class"), ("C", "Class"), ("I", "Interface")], "type string, kind string")
    assert {(r.src, r.dst, r.kind) for r in overrides(methods, closure, kinds).collect()} == {("C.m", "B.m", "METHOD_OVERRIDES"), ("B.m", "A.m", "METHOD_OVERRIDES"), ("C.m", "I.m", "METHOD_IMPLEMENTS")}


def test_type_tiers(spark):
    refs = spark.createDataFrame([(1, "a.T", "f", "z"), (2, "T", "f", "z"), (3, "U", "f", "b"), (4, "V", "g", "z"), (5, "W", "g", "z"), (6, "None", "g", "z")], "ref int, name string, file string, package string")
    types = spark.createDataFrame([("a.T", "T", "a"), ("b.T", "T", "b"), ("b.U", "U", "b"), ("c.V", "V", "c"), ("d.V", "V", "d"), ("d.W", "W", "d")], "fqn string, name string, package string")
    imports = spark.createDataFrame([("f", "b.T", False), ("g", "c.*", True)], "file string, raw string, is_wildcard boolean")
    assert {r.ref: (r.target, r.confidence) for r in resolve_types(refs, types, imports).collect()} == {1: ("a.T", 1.0), 2: ("b.T", 0.9), 3: ("b.U", 0.85), 4: ("c.V", 0.75), 5: ("d.W", 0.7)}


def test_injection(spark):
    points = spark.createDataFrame([("p1", "I", "fast", "X"), ("p2", "I", None, "X"), ("p3", "J", None, "J1")], "point string, type string, qualifier string, own string")
    beans = spark.createDataFrame([("A", "I", "fast", True), ("B", "I", None, False), ("J1", "J", None, True), ("J2", "J", None, False)], "impl string, type string, qualifier string, is_bean boolean")
    assert {r.point: (r.impl, r.confidence) for r in injected(points, beans).collect()} == {"p1": ("A", 0.95), "p2": ("A", 0.9), "p3": ("J2", 0.75)}
    assert best_tier([points.limit(0)], ["point"], ["own"]).count() == 0


def test_features(spark):
    nodes = spark.createDataFrame([("n1", "Order", "src/main/java/com/shop/orders/Order.java", "Class"), ("n2", "Util", "src/common/Util.java", "Class"), ("n3", "X", "modules/pay/X.java", "Class")], "id string, name string, file string, kind string")
    edges = spark.createDataFrame([("n1", "n2", "CALLS"), ("n3", "n2", "CALLS")], "src string, dst string, kind string")
    package = features.by_package(nodes)
    assert {r.id: r.feature for r in package.collect()} == {"n1": "shop", "n2": "common", "n3": "pay"}
    structure = features.by_structure(nodes, edges, package)
    assert {r.id: r.feature for r in structure.collect()}["n2"] == "shared"
    vectors = spark.createDataFrame([("n1", [1.0, 0.0]), ("n2", [0.9, 0.1]), ("n3", [0.0, 1.0])], "id string, embedding array<double>")
    assert [(r.id, r.feature) for r in features.by_centroid(vectors, structure).collect()] == [("n2", "shop")]
    both = features.assign([lambda _: package, lambda prior: features.by_structure(nodes, edges, prior)])
    assert {r.id: r.feature for r in both.collect()} == {"n1": "shop", "n2": "common", "n3": "pay"}


def test_nearest_centers(spark):
    import numpy as np

    from graphloom.operators.similarity import nearest_center

    rng = np.random.default_rng(5)
    rows, means = rng.normal(size=(40, 4)), rng.normal(size=(6, 4))
    means[3] = means[2] * 2  # the same direction
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(99, None)], "id long, embedding array<double>")
    centers = spark.createDataFrame([(f"f{i}", [float(x) for x in v]) for i, v in enumerate(means)], "feature string, mean array<double>")
    want = {}
    for i, v in enumerate(rows):
        scored = [(round(float(v @ m / np.linalg.norm(v) / np.linalg.norm(m)), 6), f"f{k}") for k, m in enumerate(means)]
        want[i] = max(scored)
    for block in (4096, 2):
        got = {r.id: (round(r.confidence, 6), r.feature) for r in nearest_center(vectors, centers, block=block).collect()}
        assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 2e-6 for i in want)
    assert nearest_center(vectors, centers.limit(0)).count() == 0


def most_rows(df):
    """The result and the most rows that any step of its plan gave out."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        number = plan.metrics().get("numOutputRows")
        below = plan.children()
        return max([number.get().value() if number.isDefined() else 0, *(walk(below.apply(k)) for k in range(below.size()))])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_members_of_many_overloads(spark):
    sites = spark.range(300).selectExpr("id AS site", "'A' AS owner", "IF(id % 3 = 0, 'f', 'm') AS name", "IF(id % 4 = 0, NULL, id % 8) AS arity")
    defs = spark.range(400).selectExpr("id", "'A' AS owner", "IF(id % 2 = 0, 'm', 'f') AS name", "id % 6 AS arity", "CASE WHEN id % 2 = 1 OR id < 5 THEN 'Field' WHEN id % 10 <> 0 THEN 'Method' END AS kind")
    rows, most = most_rows(members(sites, defs))
    every = defs.collect()
    want = {}
    for s in sites.collect():
        tier = lambda d, s=s: (2 if d.kind == "Field" else 0 if s.arity == d.arity else 1, d.id)
        want[s.site] = min(tier(d) for d in every if d.name == s.name)[1]
    assert {r.site: r.id for r in rows} == want and most < 2000


def test_static_imports_of_many_overloads(spark):
    refs = spark.range(300).selectExpr("id AS ref", "CAST(NULL AS string) AS receiver", "IF(id % 2 = 0, 'm', 'f') AS name", "IF(id % 4 = 0, NULL, id % 5) AS arity", "id % 3 AS file")
    imports = spark.createDataFrame([(0, "p.A.m", True), (0, "p.B.*", True), (0, "p.B.*", True), (1, "p.B.*", True), (2, "p.A.*", False)], "file long, raw string, is_static boolean")
    defs = spark.range(400).selectExpr("id", "IF(id % 3 = 0, 'p.A', 'p.B') AS owner", "IF(id % 2 = 0, 'm', 'f') AS name", "id % 4 AS arity")
    rows, most = most_rows(resolution.static_imports(refs, imports, defs))
    want, every = {}, defs.collect()
    for r in refs.collect():
        hits = [(m == "*", r.arity != d.arity, d.id) for f, o, m in ((0, "p.A", "m"), (0, "p.B", "*"), (1, "p.B", "*")) if f == r.file and m in (r.name, "*") for d in every if (d.owner, d.name) == (o, r.name)]
        if hits:
            want[r.ref] = min(hits)[2]
    assert {r.ref: r.id for r in rows} == want and most < 2000


def test_inherited_by_group(spark):
    closure = ancestors(spark.range(1, 60).selectExpr("CONCAT('C', id) AS child", "CONCAT('C', id div 3) AS parent"))
    owners = spark.range(60).selectExpr("CONCAT('C', id) AS owner", "id % 2 AS group")
    names = spark.range(400).selectExpr("CONCAT('n', id) AS name", "0 AS arity", "id % 2 AS group")
    defs = spark.createDataFrame([("x", "C0", "n1", 0), ("y", "C4", "n1", 1), ("z", "C4", "n1", 0), ("w", "C13", "n2", 0), ("v", "C7", "other", 0)], "id string, owner string, name string, arity int")
    rows, most = most_rows(inherited_by_group(owners, names, defs, closure))
    sites = owners.join(names, "group").withColumn("site", F.concat_ws(" ", "owner", "name"))
    want = {(r.site, r.id, r.distance) for r in inherited_members(sites, defs, closure).collect()}
    assert {(f"{r.owner} {r.name}", r.id, r.distance) for r in rows} == want and len(want) == len(rows) and most < 2000


def test_injection_of_many_beans(spark):
    points = spark.range(200).selectExpr("CONCAT('p', id % 190) AS point", "id % 5 AS type", "IF(id % 2 = 0, 'q', NULL) AS qualifier", "id % 7 AS own")
    beans = spark.range(400).selectExpr("id % 100 AS impl", "IF(id < 390, 4, 5) AS type", "IF(id % 11 = 0, 'q', 'r') AS qualifier", "id % 3 = 0 AS is_bean")
    beans = beans.union(spark.createDataFrame([(1, 0, "q", True), (2, 0, "q", False), (5, 1, None, True), (6, 1, "q", False), (3, 2, None, False)], "impl long, type long, qualifier string, is_bean boolean"))
    rows, most = most_rows(injected(points, beans))
    want, all_points, every = {}, points.collect(), beans.collect()
    for p in {r.point for r in all_points}:
        hits = [(r, b) for r in all_points if r.point == p for b in every if b.type == r.type and b.impl != r.own]
        for test, c in ((lambda r, b: r.qualifier is not None and r.qualifier == b.qualifier, 0.95), (lambda r, b: b.is_bean, 0.9), (lambda r, b: True, 0.75)):
            impls = {b.impl for r, b in hits if test(r, b)}
            if len(impls) == 1 and p not in want:
                want[p] = (impls.pop(), c)
    assert {r.point: (r.impl, r.confidence) for r in rows} == want and {c for _, c in want.values()} == {0.95, 0.9, 0.75} and most < 2000


def test_types_named_by_many(spark):
    refs = spark.range(300).selectExpr("id % 290 AS ref", "CONCAT('T', id % 6) AS name", "IF(id % 5 = 0, NULL, id % 3) AS file", "IF(id % 7 = 0, NULL, CONCAT('p', id % 4)) AS package")
    types = spark.range(600).selectExpr("CONCAT('p', id % 5, IF(id % 3 = 0, '.In', ''), '.T', id % 4) AS fqn", "CONCAT('T', id % 4) AS name", "CONCAT('p', id % 5) AS package").union(spark.createDataFrame([("z.T5", "T5", "z")], "fqn string, name string, package string"))
    imports = spark.createDataFrame([(0, "p3.*", True), (1, "p4.T1", False), (2, "p4.*", True), (2, "p4.*", True)], "file long, raw string, is_wildcard boolean")
    rows, most = most_rows(resolve_types(refs, types, imports))
    want, named, said, lines = {}, {tuple(t) for t in types.collect()}, refs.collect(), imports.collect()
    for ref in {r.ref for r in said}:
        own = [r for r in said if r.ref == ref]
        found = [set() for _ in range(6)]
        for r in own:
            for fqn, name, package in named:
                near = [i for i in lines if i.file == r.file]
                found[1] |= {fqn for i in near if not i.is_wildcard and i.raw == fqn and name == r.name}
                found[2] |= {fqn} if (name, package) == (r.name, r.package) else set()
                found[3] |= {fqn for i in near if i.is_wildcard and i.raw[:-1] + r.name == fqn}
                found[4] |= {fqn for i in near if i.is_wildcard and i.raw[:-2] == package and name == r.name}
                found[5] |= {fqn} if name == r.name and len({f for f, n, _ in named if n == name}) == 1 else set()
        found[4] = found[4] if len(found[4]) == 1 else set()
        tier = next((k for k in range(6) if found[k]), None)
        if tier is not None:
            want[ref] = (min(found[tier]), [1.0, 0.9, 0.85, 0.75, 0.72, 0.7][tier])
    assert {r.ref: (r.target, r.confidence) for r in rows} == want and most < 2000
