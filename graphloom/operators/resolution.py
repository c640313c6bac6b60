"""From references to edges, in fixed phases; what an earlier phase answered a later one leaves alone.

defs: id, owner, name, arity, kind, file, package; refs: ref, src, owner, receiver, name,
arity, file; bindings: owner, name, type; parents: child, parent.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_route, type_pattern, wildcard_segments
from ..sources.scratch import small, written
from .contracts import best_tier, first_overloads, inherited_members, resolve_types, unique_by, with_exact


def receiver_types(refs: DataFrame, bindings: DataFrame) -> DataFrame:
    """ref, owner (the type to look in), confidence: self and this are the own type (.8), a bound name its type (1.0), a name that is a type itself .7."""
    own = refs.where("receiver IN ('self', 'this', 'super')").select("ref", "owner", F.lit(0.8).alias("confidence"))
    b = bindings.select(F.col("owner").alias("b_owner"), F.col("name").alias("b_name"), "type")
    bound = refs.join(b, (F.col("owner") == F.col("b_owner")) & (F.col("receiver") == F.col("b_name"))).groupBy("ref").agg(F.min("type").alias("owner")).withColumn("confidence", F.lit(1.0))
    named = refs.where(F.col("receiver").rlike("^[A-Z]")).join(bound.select("ref"), "ref", "left_anti").select("ref", F.col("receiver").alias("owner"), F.lit(0.7).alias("confidence"))
    return own.unionByName(bound).unionByName(named)


def resolve_calls(refs: DataFrame, defs: DataFrame, bindings: DataFrame, closure: DataFrame) -> DataFrame:
    """CALLS edges with confidence and phase: receivers first, then the own hierarchy, then the only callable of that name (.70)."""
    callables = defs.where("kind IN ('Method', 'Function', 'Constructor')")
    typed = receiver_types(refs.where("receiver IS NOT NULL"), bindings)
    sites = refs.select("ref", "name", "arity").join(typed, "ref").select(F.col("ref").alias("site"), "owner", "name", "arity", "confidence")
    first = inherited_members(sites, callables, closure).join(sites.select("site", "confidence"), "site").select(F.col("site").alias("ref"), F.col("id").alias("dst"), "confidence", F.lit(1).alias("phase"))
    rest = refs.where("receiver IS NULL").join(first.select("ref"), "ref", "left_anti")
    own = inherited_members(rest.select(F.col("ref").alias("site"), "owner", "name", "arity"), callables, closure).select(F.col("site").alias("ref"), F.col("id").alias("dst"), F.lit(0.7).alias("confidence"), F.lit(2).alias("phase"))
    alone = unique_by(callables.select("name", F.col("id").alias("dst")), ["name"], "dst")
    free = rest.join(own.select("ref"), "ref", "left_anti").join(alone, "name").select("ref", "dst", F.lit(0.7).alias("confidence"), F.lit(3).alias("phase"))
    found = first.unionByName(own).unionByName(free).join(refs.select("ref", "src"), "ref").where("src <> dst")
    best = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("confidence"), "phase", "ref"))
    return found.withColumn("rank", best).where("rank = 1").select("src", "dst", F.lit("CALLS").alias("kind"), "confidence", "phase")


def heritage_edges(defs: DataFrame, heritage: DataFrame) -> DataFrame:
    """EXTENDS and IMPLEMENTS edges of (child, parent name, kind) to types that are named once."""
    types = unique_by(defs.where("kind IN ('Class', 'Interface', 'Enum', 'Record')").select("name", F.col("id").alias("dst")), ["name"], "dst")
    return heritage.join(types, F.col("parent") == F.col("name")).where("child <> dst").select(F.col("child").alias("src"), "dst", F.upper("kind").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


def import_edges(imports: DataFrame, defs: DataFrame) -> DataFrame:
    """IMPORTS edges of files to the types that they name; wildcards are passed over. imports: file, raw, is_wildcard; a type's full name is package.name."""
    full = defs.select(F.concat_ws(".", "package", "name").alias("raw"), F.col("id").alias("dst"))
    return imports.where("NOT is_wildcard").join(full, "raw").select(F.concat(F.lit("File:"), "file").alias("src"), "dst", F.lit("IMPORTS").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


def classify_unresolved(refs: DataFrame, resolved: DataFrame, packages: DataFrame) -> DataFrame:
    """How many references stay open, by reason: internal (its receiver's package is ours), dynamic (no receiver), external."""
    open_ = refs.join(resolved.select("ref"), "ref", "left_anti").join(packages.select(F.col("package").alias("receiver"), F.lit(True).alias("ours")).distinct(), "receiver", "left")
    kind = F.when(F.col("receiver").isNull(), "dynamic").when(F.col("ours"), "internal").otherwise("external")
    return open_.groupBy(kind.alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def static_imports(refs: DataFrame, imports: DataFrame, defs: DataFrame) -> DataFrame:
    """Members that calls without a receiver mean through static imports: ref, id.

    imports: file, raw (``owner.member`` or ``owner.*``), is_static. The named import comes
    before the wildcard, of one owner the same arity before any overload, then the id. Each
    distinct (name, arity, file) is resolved once, against the first overloads only.
    """
    own = imports.where("is_static").select("file", F.regexp_replace("raw", r"\.[^.]*$", "").alias("owner"), F.substring_index("raw", ".", -1).alias("member")).distinct()
    open_ = refs.where("receiver IS NULL").select("ref", "name", "arity", "file")
    asked = open_.select("name", "arity", "file").distinct()
    imported = asked.join(own, "file").where("member = name OR member = '*'").join(first_overloads(defs, exact=False), ["owner", "name"])
    order = F.struct((F.col("member") == "*").alias("wild"), F.col("exact").isNull().alias("other"), F.coalesce("exact", "any").alias("id"))
    best = with_exact(imported, first_overloads(defs, exact=True)).groupBy("name", F.col("arity").alias("b_arity"), "file").agg(F.min(order).alias("best"))
    found = open_.join(best, ["name", "file"]).where(F.col("arity").eqNullSafe(F.col("b_arity")))
    return found.groupBy("ref").agg(F.min("best").alias("best")).select("ref", "best.id")


def http_wrappers(sites: DataFrame, wrappers: DataFrame, imports: DataFrame) -> DataFrame:
    """Wrapper functions behind calls: site, module, name, fixed_method.

    sites: site, callee, module, file; wrappers: module, name, fixed_method; imports: file,
    raw, alias. A bare callee is one of the same module, then of an imported module, then
    the only one of that name. A dotted one names an import, by its alias, in full or by
    its last segment, and nothing else.
    """
    w = wrappers.select(F.col("module").alias("w_module"), F.col("name").alias("w_name"), "fixed_method")
    bare = sites.where(~F.col("callee").contains("."))
    dotted = sites.where(F.col("callee").contains(".")).select("site", "file", F.regexp_replace("callee", r"\.[^.]*$", "").alias("obj"), F.substring_index("callee", ".", -1).alias("attr"))
    imported = imports.select("file", "raw", "alias")
    pick = lambda df: df.select("site", F.col("w_module").alias("module"), F.col("w_name").alias("name"), "fixed_method")
    sole = unique_by(w.select("w_name", F.struct("w_module", "fixed_method").alias("w")), ["w_name"], "w")
    names = F.coalesce("alias", F.lit("")) == F.col("obj")
    pinned = dotted.join(imported, "file").where(names | F.col("alias").isNull() & ((F.col("raw") == F.col("obj")) | (F.substring_index("raw", ".", -1) == F.col("obj"))))
    tiers = [
        pick(bare.join(w, (F.col("module") == F.col("w_module")) & (F.col("callee") == F.col("w_name")))),
        pick(bare.drop("module").join(imported, "file").join(w, (F.col("raw") == F.col("w_module")) & (F.col("callee") == F.col("w_name")))),
        bare.drop("module").join(sole, F.col("callee") == F.col("w_name")).select("site", F.col("w.w_module").alias("module"), F.col("w_name").alias("name"), "w.fixed_method"),
        pick(pinned.join(w, (F.col("raw") == F.col("w_module")) & (F.col("attr") == F.col("w_name")))),
    ]
    return best_tier(tiers, ["site"], ["module", "name"]).drop("tier")


def contract_edges(sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of contract sites: endpoints with EXTERNAL_CALL, topics with PUBLISHES_EVENT or LISTENS_TO.

    sites: src, kind (http, publish, listen), method, literal (a URL or topic, or null),
    folded (what constants gave of it, with ``${`` for what they didn't). A literal URL counts
    .75, a folded one .65 if a segment of it is known; a topic counts .8 and must be whole.
    """
    path = F.when(F.col("literal").isNotNull(), F.col("literal")).otherwise(wildcard_segments(F.col("folded")))
    http = sites.where("kind = 'http' AND method IS NOT NULL").withColumn("path", path).where("path IS NOT NULL")
    name = F.concat_ws(" ", F.upper("method"), "path")
    ends = http.select("src", F.concat(F.lit("ExternalEndpoint:"), name).alias("dst"), F.lit("EXTERNAL_CALL").alias("kind"), F.when(F.col("literal").isNotNull(), 0.75).otherwise(0.65).alias("confidence"), name.alias("name"), F.lit("ExternalEndpoint").alias("node_kind"))
    topic = F.coalesce("literal", F.when((F.col("folded") != "") & ~F.col("folded").contains("${"), F.col("folded")))
    events = sites.where("kind IN ('publish', 'listen')").withColumn("topic", topic).where("topic IS NOT NULL")
    events = events.select("src", F.concat(F.lit("KafkaTopic:"), "topic").alias("dst"), F.when(F.col("kind") == "publish", "PUBLISHES_EVENT").otherwise("LISTENS_TO").alias("kind"), F.lit(0.8).alias("confidence"), F.col("topic").alias("name"), F.lit("KafkaTopic").alias("node_kind"))
    both = ends.unionByName(events)
    nodes = both.select(F.col("dst").alias("id"), F.col("node_kind").alias("kind"), "name").distinct()
    return nodes, both.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def lookup_edges(refs: DataFrame, defs: DataFrame, types: DataFrame, imports: DataFrame, closure: DataFrame) -> DataFrame:
    """Edges of references that are no calls: constructors (CALLS), fields (ACCESSES, 1.0) and types (USES).

    refs: ref, src, kind (ctor, field-read, field-write, type-ref), owner, name, arity, file,
    package; a constructor and a type are found by the tiers of ``resolve_types`` (types: fqn,
    id, name, package), with its confidence; a constructor of the same arity, else the type.
    A field is one of the owner or its nearest ancestor.
    """
    named = refs.where("kind IN ('ctor', 'type-ref')")
    found = resolve_types(named.select("ref", "name", "file", "package"), types, imports).join(types.select(F.col("fqn").alias("target"), F.col("id").alias("type_id")), "target")
    typed = named.join(found, "ref")
    made = defs.where("kind = 'Constructor'").select(F.col("owner").alias("target"), F.col("arity"), F.col("id").alias("made"))
    ctor = typed.where("kind = 'ctor'").join(made, ["target", "arity"], "left").groupBy("ref", "src", "type_id", "confidence").agg(F.min("made").alias("made"))
    calls = ctor.select("src", F.coalesce("made", "type_id").alias("dst"), F.lit("CALLS").alias("kind"), "confidence", F.lit("constructor").alias("reason"))
    uses = typed.where("kind = 'type-ref'").select("src", F.col("type_id").alias("dst"), F.lit("USES").alias("kind"), "confidence", F.lit("type-ref").alias("reason"))
    fields = refs.where("kind LIKE 'field-%'")
    hit = inherited_members(fields.select(F.col("ref").alias("site"), "owner", "name", F.lit(None).cast("int").alias("arity")), defs.where("kind = 'Field'"), closure)
    access = fields.join(hit.select(F.col("site").alias("ref"), F.col("id").alias("dst")), "ref").select("src", "dst", F.lit("ACCESSES").alias("kind"), F.lit(1.0).alias("confidence"), F.col("kind").alias("reason"))
    every = calls.unionByName(access).unionByName(uses)
    return every.groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("reason").alias("reason"))


def expression_types(expressions: DataFrame, bindings: DataFrame, members: DataFrame, most: int = 8) -> DataFrame:
    """Types of dotted receivers like ``a.b.c()``: ref, type, if every part has one.

    expressions: ref, owner, parts (array); bindings: owner, name, type; members: owner, name,
    type (what a field holds or a method returns). The first part is a bound name, this or
    self, or a type; each next one a member of the type so far. Longer ones stay open.
    """
    names = members.groupBy(F.col("owner").alias("type"), F.col("name").alias("part")).agg(F.min("type").alias("next"))
    b = bindings.groupBy("owner", F.col("name").alias("part")).agg(F.min("type").alias("bound"))
    first = expressions.where(F.size("parts").between(1, most)).withColumn("part", F.regexp_replace(F.get("parts", F.lit(0)), r"\(.*$", "")).join(b, ["owner", "part"], "left")
    here = F.when(F.col("part").isin("this", "self"), F.col("owner")).otherwise(F.coalesce("bound", F.when(F.col("part").rlike("^[A-Z]"), F.col("part"))))
    state = written(first.select("ref", "parts", here.alias("type")).where("type IS NOT NULL"), "typed")
    done = state.where(F.size("parts") == 1).select("ref", "type")
    for k in range(1, most):
        open_ = state.where(F.size("parts") > k).withColumn("part", F.regexp_replace(F.get("parts", F.lit(k)), r"\(.*$", ""))
        state = written(open_.join(names, ["type", "part"]).select("ref", "parts", F.col("next").alias("type")), "typed")
        if state.isEmpty():
            break
        done = done.unionByName(state.where(F.size("parts") == k + 1).select("ref", "type"))
    return done


def wired_calls(wiring: DataFrame, beans: DataFrame) -> DataFrame:
    """CALLS edges between the classes of wired beans: src, dst, confidence (.9). wiring: bean, ref; beans: bean, class_id; a bean's name must be its only one."""
    sole = unique_by(beans, ["bean"], "class_id")
    found = wiring.join(sole.withColumnRenamed("class_id", "src"), "bean").join(sole.select(F.col("bean").alias("ref"), F.col("class_id").alias("dst")), "ref")
    return found.where("src <> dst").select("src", "dst", F.lit("CALLS").alias("kind"), F.lit(0.9).alias("confidence")).distinct()


def custom_routes(methods: DataFrame, types: DataFrame, rules: DataFrame, existing: DataFrame) -> DataFrame:
    """Routes of annotated methods by rules: id, src, method, path. A route that exists, or that an earlier method made, isn't made again.

    methods: id, owner, annotations (array of name, attrs); types: owner, annotations; rules:
    annotation, path_attr, method (fixed) or method_attr, prefix_annotation, prefix_attr.
    """
    found = methods.select("id", "owner", F.explode("annotations").alias("a")).join(F.broadcast(rules), F.col("a.name") == F.col("annotation"))  # rules are a configuration
    attr = lambda attrs, key: F.try_element_at(attrs, F.coalesce(F.col(key), F.lit("")))
    classes = types.select("owner", F.explode("annotations").alias("c")).select("owner", F.col("c.name").alias("prefix_annotation"), F.col("c.attrs").alias("c_attrs"))
    joined = found.join(classes.groupBy("owner", "prefix_annotation").agg(F.first("c_attrs").alias("c_attrs")), ["owner", "prefix_annotation"], "left")
    path = join_route(attr(F.col("c_attrs"), "prefix_attr"), F.coalesce(attr(F.col("a.attrs"), "path_attr"), F.lit("")))
    method = F.coalesce("method", F.upper(attr(F.col("a.attrs"), "method_attr")), F.lit("GET"))
    made = joined.select("id", method.alias("http"), path.alias("path")).select(F.concat(F.lit("Route:"), "http", F.lit(" "), "path").alias("route"), F.col("id").alias("src"), "http", "path")
    fresh = made.join(existing.select(F.col("id").alias("route")), "route", "left_anti")
    first = F.row_number().over(Window.partitionBy("route").orderBy("src"))
    return fresh.withColumn("rank", first).where("rank = 1").select(F.col("route").alias("id"), "src", F.col("http").alias("method"), "path")


def stitched_routes(routes: DataFrame, servers: DataFrame, base: str = "") -> DataFrame:
    """Routes of server beans with their address before the path: id, old_id, path. routes: id, owner, method, path; servers: owner, address. Routes of other owners stay as they are; ``base`` goes before all."""
    prefix = servers.groupBy("owner").agg(F.min("address").alias("address"))
    joined = routes.join(prefix, "owner", "left")
    inner = F.when(F.col("address").isNull(), F.col("path")).otherwise(join_route(F.col("address"), F.col("path")))
    path = join_route(F.lit(base), inner) if base else inner
    return joined.select(F.concat(F.lit("Route:"), "method", F.lit(" "), path).alias("id"), F.col("id").alias("old_id"), path.alias("path"))


def advice_edges(methods: DataFrame, advice: DataFrame, most: int = 2000) -> DataFrame:
    """ADVISES edges of advice to the methods that its pattern names: src, dst, confidence, reason; the first ``most`` of each advice by id.

    methods: id, owner, name, annotations (array of names); advice: id, kind, owner_pattern,
    name_pattern, annotation (each may be null: any), approximate. Advice is a
    configuration: its patterns become regular expressions and go to the scan of methods.
    An approximate pattern counts .8, any other 1.
    """
    rules = [(r.id, r.kind, type_pattern(r.owner_pattern or "*"), type_pattern(r.name_pattern or "*"), r.annotation, r.approximate) for r in advice.collect()]
    spark = methods.sparkSession
    table = spark.createDataFrame(rules, "advice string, kind string, owner_re string, name_re string, annotation string, approximate boolean")
    m = methods.select("id", "owner", "name", "annotations")
    hit = F.expr("owner rlike owner_re AND name rlike name_re AND (annotation IS NULL OR array_contains(annotations, annotation))")
    found = m.join(F.broadcast(table), hit)
    rank = F.row_number().over(Window.partitionBy("advice").orderBy("id"))
    few = found.select("advice", "kind", "id", "approximate").distinct().withColumn("rank", rank).where(F.col("rank") <= most)
    return few.select(F.col("advice").alias("src"), F.col("id").alias("dst"), F.when(F.col("approximate"), 0.8).otherwise(1.0).alias("confidence"), F.concat(F.lit("aop-"), "kind").alias("reason"))


def linearized(parents: DataFrame) -> DataFrame:
    """The C3 order of ancestors of every type: type, mro (array, itself first). parents: child, parent, place (the order of a child's bases).

    Types are settled from the roots down, in rounds: those all of whose bases are. Each
    is merged from its bases' orders at once; on cycles, or where no head is free, the
    first head is taken. What waits for itself gets its bases as they stand.
    """
    bases = written(parents.groupBy(F.col("child").alias("type")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "parent"))), lambda b: b["parent"]).alias("bases")), "bases")
    merge = F.pandas_udf(_merged_orders, "array<string>")
    roots = parents.select(F.col("parent").alias("type")).distinct().join(bases, "type", "left_anti")
    done = written(roots.select("type", F.array("type").alias("mro")), "orders")
    waiting = bases
    while not waiting.isEmpty():
        asked = waiting.select("type", "bases", F.posexplode("bases").alias("place", "base"))
        known = asked.join(done.select(F.col("type").alias("base"), "mro"), "base", "left")
        lists = known.groupBy("type", "bases").agg(F.min(F.col("mro").isNotNull()).alias("ready"), F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("mro", F.array("base")).alias("mro")))), lambda x: x["mro"]).alias("orders"))
        lists = written(lists, "lists")
        ready = lists.where("ready")
        if ready.isEmpty():
            ready = lists  # only cycles, and what is below them, are left
        fresh = written(ready.select("type", merge("type", "bases", "orders").alias("mro")), "orders")
        done = written(done.unionByName(fresh), "orders")
        waiting = written(waiting.join(fresh.select("type"), "type", "left_anti"), "waiting")
    return done


def _merged_orders(types: pd.Series, bases: pd.Series, orders: pd.Series) -> pd.Series:
    def one(name: str, own: Sequence[str], lists: Sequence[Sequence[str]]) -> list[str]:
        left, out = [list(x) for x in lists] + [list(own)], [name]
        while left := [x for x in left if x]:
            later = {v for x in left for v in x[1:]}
            head = next((x[0] for x in left if x[0] not in later), left[0][0])
            if head not in out:
                out.append(head)
            left = [x[1:] if x[0] == head else x for x in left]
        return out

    return pd.Series([one(*row) for row in zip(types, bases, orders, strict=True)], dtype=object)


def consumer_callers(edges: DataFrame, endpoint: str, depth: int = 4) -> DataFrame:
    """Methods that call an endpoint, directly (depth 0) or through CALLS, and the first route that each handles: id, depth, route."""
    from .traversal import reach

    direct = edges.where((F.col("kind") == "EXTERNAL_CALL") & (F.col("dst") == endpoint)).select(F.col("src").alias("id")).distinct()
    routes = edges.where("kind = 'HANDLES_ROUTE'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("route"))
    if depth:
        ids = edges.select(F.col("src").alias("id")).distinct()
        found = reach(ids.withColumn("name", F.col("id")), edges.where("kind = 'CALLS'"), direct, "up", depth).rows.select("id", "depth")
    else:
        found = direct.withColumn("depth", F.lit(0))
    return small(written(found, "callers")).join(routes, "id", "left").select("id", "depth", "route")


def contracts_of(contracts: DataFrame, match_key: str) -> DataFrame:
    return contracts.where(F.col("match_key") == match_key)


def api_impact(contracts: DataFrame, edges: DataFrame, match_key: str, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Contracts of a match key, and the callers of their consumer endpoints: (contracts, callers with consumer_repo and endpoint). edges have a column repo."""
    own = written(contracts_of(contracts, match_key), "contracts")
    out = None
    for r in own.select("consumer_repo", "consumer_id").distinct().orderBy("consumer_repo", "consumer_id").collect():  # the consumers of one contract
        one = consumer_callers(edges.where(F.col("repo") == r.consumer_repo), r.consumer_id, depth).select(F.lit(r.consumer_repo).alias("consumer_repo"), F.lit(r.consumer_id).alias("endpoint"), "id", "depth", "route")
        out = one if out is None else out.unionByName(one)
    empty = "consumer_repo string, endpoint string, id string, depth int, route string"
    return own, out if out is not None else edges.sparkSession.createDataFrame([], empty)
