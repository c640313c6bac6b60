"""Point and filtered lookups, and pages of them. All orders are total, so equal inputs give equal pages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import CALLABLE_KINDS, DATA_STEPS, EDGE_KINDS, FILE_SYMBOL_KINDS, FORWARD_STEPS, KINDS_OF_USE, NODE_KINDS, REVERSED_STEPS


def bounded(name: str, value: int, low: int, high: int) -> int:
    """A request's number, checked against its range."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be {low} to {high}, not {value}")
    return value


def node_kind(label: str) -> str:
    """An unknown label is an error, not an empty result."""
    if label not in NODE_KINDS:
        raise ValueError(f"unknown node kind {label!r}")
    return label


def edge_kinds(kinds: Iterable[str] = ()) -> Column:
    """Empty means all kinds."""
    chosen = list(kinds)
    if unknown := set(chosen) - set(EDGE_KINDS):
        raise ValueError(f"unknown edge kinds {sorted(unknown)}")
    return F.col("kind").isin(chosen) if chosen else F.lit(True)


def by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def by_name(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    return nodes.where(F.col("name") == name).orderBy("id").limit(limit)


def resolve(nodes: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """``name``, ``status`` (found, ambiguous, missing) and ``ids`` of each wanted name; a name with a colon is an id.

    At most ``most`` candidates are named, in the order of ids.
    """
    wanted = names.select("name").distinct()
    found = nodes.select("id", F.col("name").alias("own"))
    ids = wanted.where(F.col("name").contains(":")).join(found, F.col("name") == F.col("id"), "left").select("name", "id")
    plain = wanted.where(~F.col("name").contains(":")).join(found, F.col("name") == F.col("own"), "left").select("name", "id")
    listed = ids.union(plain).groupBy("name").agg(F.slice(F.sort_array(F.collect_list("id")), 1, most).alias("ids"))
    return listed.select("name", F.when(F.size("ids") == 0, "missing").when(F.size("ids") == 1, "found").otherwise("ambiguous").alias("status"), "ids")


def in_files(nodes: DataFrame, files: DataFrame, kinds: Sequence[str] = FILE_SYMBOL_KINDS, limit: int = 200) -> DataFrame:
    """Nodes of the given kinds in the files (column file)."""
    return nodes.where(F.col("kind").isin(list(kinds))).join(files.select("file").distinct(), "file", "left_semi").orderBy("file", "id").limit(limit)


def hotspots(nodes: DataFrame, loop_depth: int = 1, cyclomatic: int = 5, cognitive: int = 0, kinds: Sequence[str] = ("Method", "Constructor"), limit: int = 50) -> DataFrame:
    chosen = nodes.where(F.col("kind").isin(list(kinds)) & (F.col("loop_depth") >= loop_depth) & (F.col("cyclomatic") >= cyclomatic) & (F.col("cognitive") >= cognitive))
    return chosen.orderBy(F.desc("loop_depth"), F.desc("cyclomatic"), "id").limit(min(200, max(1, limit)))


def confident(edges: DataFrame, least: float = 0.60) -> DataFrame:
    """Edges with both ends named and enough confidence, and how they were found: certain, strong or weak."""
    strategy = F.when(F.col("confidence") >= 1.0, "certain").when(F.col("confidence") >= 0.9, "strong").otherwise("weak")
    return edges.where((F.col("confidence") >= least) & (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")).withColumn("strategy", strategy)


def is_test(path: Column, name: Column) -> Column:
    return path.contains("/test/") | name.rlike("(Test|Tests|IT|Spec)$")


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in "\\.+()[]{}^$|" else c
            i += 1
    return f"^{out}$"


def in_scope(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose file matches an include glob (none: all) and no exclude glob."""
    path = F.col("file")
    wanted = F.lit(not include)
    for g in include:
        wanted |= path.rlike(glob_pattern(g))
    for g in exclude:
        wanted &= ~path.rlike(glob_pattern(g))
    return files.where(wanted)


def neighbors(edges: DataFrame, roots: DataFrame, direction: str = "both", kinds: Iterable[str] = ()) -> DataFrame:
    """Edges at the roots (column id): root, other, kind, confidence, outgoing. A loop is listed from both sides."""
    own = edges.where(edge_kinds(kinds))
    ids = roots.select(F.col("id").alias("root"))
    out = own.join(ids, F.col("src") == F.col("root")).select("root", F.col("dst").alias("other"), "kind", "confidence", F.lit(True).alias("outgoing"))
    into = own.join(ids, F.col("dst") == F.col("root")).select("root", F.col("src").alias("other"), "kind", "confidence", F.lit(False).alias("outgoing"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def keyset_page(rows: DataFrame, order: Sequence[str], after: Sequence | None = None, limit: int = 100) -> DataFrame:
    """The page of ``limit`` rows after a cursor, and one more row that shows whether another page follows."""
    if after is not None:
        types = dict(rows.dtypes)
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, after, strict=True))))
    return rows.orderBy(*order).limit(limit + 1)


def neighbor_page(nodes: DataFrame, edges: DataFrame, root: str, direction: str = "in", kinds: Iterable[str] = ("CALLS",), after: tuple[str, str] | None = None, limit: int = 100) -> DataFrame:
    """Distinct neighbours in the order of (name, id), with the probe row of keyset_page."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    ids = edges.where(edge_kinds(kinds) & (F.col(near) == root)).select(F.col(far).alias("id")).distinct()
    return keyset_page(nodes.select("id", "name", "kind", "file").join(ids, "id", "left_semi"), ("name", "id"), after, limit)


def execution_edges(edges: DataFrame, data: bool = True) -> DataFrame:
    """Logical steps: calls and events forward, handled routes and listened topics backward."""
    forward = edges.where(F.col("kind").isin(list(FORWARD_STEPS + (DATA_STEPS if data else ())))).select("src", "dst", "kind", "confidence", F.lit(False).alias("reverse"))
    backward = edges.where(F.col("kind").isin(list(REVERSED_STEPS))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "confidence", F.lit(True).alias("reverse"))
    return forward.unionByName(backward)


def transitions(nodes: DataFrame, edges: DataFrame, sources: DataFrame, after: Sequence | None = None, limit: int = 1000) -> DataFrame:
    """Stored edges of many sources at once, in the order of target name, target, source, kind, confidence, reason."""
    found = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst")
    order = ("dst_name", "dst", "src", "kind", "confidence", "reason")
    return keyset_page(found.select(*order), order, after, limit)


def linked(edges: DataFrame, nodes: DataFrame, kind: str, target_kind: str | None = None) -> DataFrame:
    """Edges of one kind with their targets' names: src, dst, dst_name."""
    targets = nodes.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("kind").alias("dst_kind"))
    found = edges.where(F.col("kind") == kind).select("src", "dst").join(targets, "dst")
    return (found if target_kind is None else found.where(F.col("dst_kind") == target_kind)).select("src", "dst", "dst_name")


def untested(nodes: DataFrame, edges: DataFrame, prefix: str = "", kinds: Sequence[str] = ("Method", "Class", "Interface"), limit: int = 500) -> DataFrame:
    """Nodes that no TESTS edge reaches and that are no tests themselves."""
    tested = edges.where("kind = 'TESTS'").select(F.col("dst").alias("id"))
    own = nodes.where(F.col("kind").isin(list(kinds)) & F.col("file").startswith(prefix) & ~F.col("stereotype").eqNullSafe("test"))
    return own.join(tested, "id", "left_anti").orderBy("file", "id").limit(limit)


def tests_for_files(nodes: DataFrame, edges: DataFrame, files: DataFrame, cap: int = 200) -> DataFrame:
    """Tests of a file's nodes, directly or through one call; ``via`` says how, each way capped by the order of ids."""
    from ..sources.scratch import small, written

    wanted = small(written(nodes.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("dst")).distinct(), "wanted"))
    edges = written(edges.where("kind IN ('TESTS', 'CALLS')").select("src", "dst", "kind"), "steps")
    tests, calls = edges.where("kind = 'TESTS'"), edges.where("kind = 'CALLS'")
    direct = tests.join(wanted, "dst", "left_semi").select(F.col("src").alias("test"), F.lit("direct").alias("via")).distinct().orderBy("test").limit(cap)
    callers = calls.join(wanted, "dst", "left_semi").select(F.col("src").alias("dst")).distinct()
    called = tests.join(callers, "dst", "left_semi").select(F.col("src").alias("test"), F.lit("call").alias("via")).distinct().orderBy("test").limit(cap)
    return direct.unionByName(called)


def test_coverage(nodes: DataFrame, edges: DataFrame, node_id: str, type_kinds: Sequence[str] = ("Class", "Interface"), member_edge: str = "HAS_METHOD", after: Sequence | None = None, limit: int = 50) -> DataFrame:
    """Tests in a node's scope: a type with its members, a member with its owner."""
    own = nodes.where(F.col("id") == node_id).select("id", "kind")
    members = edges.where(F.col("kind") == member_edge)
    down = own.where(F.col("kind").isin(list(type_kinds))).join(members, F.col("id") == F.col("src")).select(F.col("dst").alias("scope"))
    up = own.where(~F.col("kind").isin(list(type_kinds))).join(members.select("src", "dst"), F.col("id") == F.col("dst")).select(F.col("src").alias("scope"))
    scope = own.select(F.col("id").alias("scope")).union(down).union(up)
    tests = edges.where("kind = 'TESTS'").join(scope, F.col("dst") == F.col("scope"), "left_semi").select(F.col("src").alias("id")).distinct()
    return keyset_page(nodes.select("id", "name", "file").join(tests, "id"), ("file", "name", "id"), after, limit)


def tests_of_members(nodes: DataFrame, edges: DataFrame, member_edge: str = "HAS_METHOD") -> DataFrame:
    """Tests of every method, directly or through its owner: id, test; each pair once."""
    own = nodes.where(F.col("kind").isin(list(CALLABLE_KINDS))).select("id", F.col("id").alias("scope"))
    owners = edges.where(F.col("kind") == member_edge).select(F.col("dst").alias("id"), F.col("src").alias("scope"))
    tests = edges.where("kind = 'TESTS'").select(F.col("dst").alias("scope"), F.col("src").alias("test"))
    return own.union(owners.join(own.select("id"), "id", "left_semi").select("id", "scope")).join(tests, "scope").select("id", "test").distinct()


def similar_methods(nodes: DataFrame, edges: DataFrame, root: str, least: float = 0.0, limit: int = 10) -> DataFrame:
    """Targets of SIMILAR_TO edges from a node, most similar first, ties by id: id, name, file, similarity."""
    found = edges.where((F.col("kind") == "SIMILAR_TO") & (F.col("src") == root) & (F.col("confidence") >= least)).select(F.col("dst").alias("id"), F.col("confidence").alias("similarity"))
    return nodes.select("id", "name", "file").join(found, "id").orderBy(F.desc("similarity"), "id").limit(min(50, max(1, limit)))


def of_kinds(nodes: DataFrame, use: str) -> DataFrame:
    """Nodes of the kinds that a use is for: searchable, embeddable, clusterable, community or projection (of edges)."""
    return nodes.where(F.col("kind").isin(list(KINDS_OF_USE[use])))


def final_edges(edges: DataFrame, access: str = "any") -> DataFrame:
    """Edges that may end a path: any, or those that read or write a table."""
    wanted = {"any": None, "read": "READS_TABLE", "write": "WRITES_TABLE"}[access]
    return edges if wanted is None else edges.where(F.col("kind") == wanted)


def is_external(props: Column) -> Column:
    """Does the JSON say that a node isn't of the project: external, or read from an archive?"""
    true = lambda key: F.coalesce(F.get_json_object(props, f"$.{key}") == "true", F.lit(False))
    return true("external") | true("fromJar")


def project_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of the project itself that are no tests: neither external nor from an archive. nodes: file, name and props."""
    return nodes.where(~is_external(F.col("props")) & ~is_test(F.col("file"), F.regexp_replace("file", r"\.[A-Za-z]+$", "")))


def architecture(modules: Column, files: Column) -> Column:
    """Monolith with over 500 files in over 3 modules, microservice with under 100 files, else unknown."""
    return F.when((files > 500) & (modules > 3), "monolith").when(files < 100, "microservice").otherwise("unknown")


def staleness(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Repositories and the state of what was saved of them: fresh, stale (another head) or missing. Both sides: repo, head."""
    both = current.select("repo", "head").join(saved.select("repo", F.col("head").alias("was")), "repo", "left")
    return both.select("repo", F.when(F.col("was").isNull(), "missing").when(F.col("was").eqNullSafe(F.col("head")), "fresh").otherwise("stale").alias("state"))


def offset_page(rows: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows numbered from 0 in a total order; offset and limit together reach 5,000 at most, so one top-k serves it."""
    bounded("offset + limit", offset + limit, 1, 5000)
    return rows.orderBy(*order).limit(offset + limit).withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("position") >= offset)


def within_bytes(rows: DataFrame, order: Sequence[str | Column], budget: int) -> DataFrame:
    """The first rows whose JSON fits the budget together. For results that a page bounds."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    running = F.sum("json_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("json_bytes", size).withColumn("running_bytes", running).where(F.col("running_bytes") <= budget).drop("running_bytes")
