"""Contracts between repositories, set comparisons, and tiered resolution."""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def http_contracts(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers matched with providers of other repositories by method and path; a provider of method ANY serves all. Both sides: repo, id, method, path."""
    p = providers.select(F.col("repo").alias("provider_repo"), F.col("id").alias("provider_id"), F.col("method").alias("provider_method"), "path")
    c = consumers.select(F.col("repo").alias("consumer_repo"), F.col("id").alias("consumer_id"), "method", "path")
    same = c.join(p, (c["path"] == p["path"]) & (c["method"] == p["provider_method"])).drop(p["path"])
    any_ = c.join(p.where("provider_method = 'ANY'"), "path").select(*same.columns)
    rows = same.unionByName(any_).where("provider_repo <> consumer_repo")
    return rows.select("provider_repo", "provider_id", "consumer_repo", "consumer_id", F.concat_ws(" ", "method", "path").alias("match_key")).distinct()


def event_contracts(publishers: DataFrame, listeners: DataFrame) -> DataFrame:
    """Publishers and listeners (repo, id, topic) of one topic in different repositories."""
    p = publishers.select(F.col("repo").alias("provider_repo"), F.col("id").alias("provider_id"), "topic")
    c = listeners.select(F.col("repo").alias("consumer_repo"), F.col("id").alias("consumer_id"), "topic")
    return p.join(c, "topic").where("provider_repo <> consumer_repo").distinct()


def compare_fields(provided: DataFrame, consumed: DataFrame) -> DataFrame:
    """Per key the fields on both sides, only provided, only consumed; each side: key, field."""
    side = lambda df, name: df.groupBy("key").agg(F.sort_array(F.collect_set("field")).alias(name))
    both = side(provided, "p").join(side(consumed, "c"), "key", "full_outer")
    p, c = (F.coalesce(x, F.array().cast("array<string>")) for x in ("p", "c"))
    return both.select("key", F.array_sort(F.array_intersect(p, c)).alias("matched"), F.array_sort(F.array_except(p, c)).alias("provider_only"), F.array_sort(F.array_except(c, p)).alias("consumer_only"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, hash) on both sides: path, change (added, removed, modified)."""
    both = before.select("path", F.col("hash").alias("was")).join(after.select("path", F.col("hash").alias("now")), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("modified").alias("change"))


def best_tier(candidates: Sequence[DataFrame], key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of each key the rows' first by tier (the place in ``candidates``), then by order; with the tier's number."""
    rows = reduce(DataFrame.unionByName, [c.withColumn("tier", F.lit(t)) for t, c in enumerate(candidates)])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("tier", *order))).where("rank = 1").drop("rank")


def unique_by(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Keys with one distinct value only, and that value."""
    return rows.groupBy(*key).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """Type names to types, first tier that answers: ref, target, confidence.

    refs: ref, name, file, package; types: fqn, name, package; imports: file, raw, is_wildcard.
    Tiers: qualified 1.00, explicit import .90, same package .85, directly in a wildcard
    import's package .75, the only type of that name anywhere in the wildcard packages (a
    nested one) .72, and a simple name that is unique everywhere .70. What a reference says
    decides, so each distinct (name, file, package) is resolved once.
    """
    from ..sources.scratch import small, written

    said = ["name", "file", "package"]
    asked = refs.where("name IS NOT NULL").select(*said).distinct()
    t = types.select("fqn", F.col("name").alias("t_name"), F.col("package").alias("t_package")).distinct()
    explicit = imports.where("NOT is_wildcard").select("file", "raw").distinct()
    wild = imports.where("is_wildcard").select("file", F.regexp_replace("raw", r"\.\*$", "").alias("raw")).distinct()
    tiers = [
        asked.join(t, F.col("name") == F.col("fqn")),
        asked.join(explicit, "file").join(t, (F.col("raw") == F.col("fqn")) & (F.col("name") == F.col("t_name"))),
        asked.join(t, (F.col("package") == F.col("t_package")) & (F.col("name") == F.col("t_name"))),
        asked.join(wild, "file").join(t, F.concat_ws(".", "raw", "name") == F.col("fqn")),
        asked.join(wild, "file").join(t, (F.col("raw") == F.col("t_package")) & (F.col("name") == F.col("t_name"))),
        asked.join(unique_by(t.select("t_name", "fqn"), ["t_name"], "fqn"), F.col("name") == F.col("t_name")),
    ]
    nested = 4  # the tier that wants an only type of all that a reference's rows may mean
    rows = reduce(DataFrame.unionByName, [df.select(*said, "fqn", F.lit(k).alias("tier")) for k, df in enumerate(tiers)])
    inside = F.when(F.col("tier") == nested, F.col("fqn"))
    found = rows.groupBy(*said).agg(F.min(F.when(F.col("tier") != nested, F.struct("tier", "fqn"))).alias("best"), F.min(inside).alias("lo"), F.max(inside).alias("hi"))
    found = small(written(found.select(*(F.col(c).alias(f"f_{c}") for c in said), "best", "lo", "hi"), "resolved"), 256)
    same = (F.col("name") == F.col("f_name")) & F.col("file").eqNullSafe(F.col("f_file")) & F.col("package").eqNullSafe(F.col("f_package"))
    each = refs.join(found, same).groupBy("ref").agg(F.min("best").alias("best"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    only = F.when(F.col("lo") == F.col("hi"), F.struct(F.lit(nested).alias("tier"), F.col("lo").alias("fqn")))
    best = each.select("ref", F.least("best", only).alias("b")).where("b IS NOT NULL")
    confidence = F.element_at(F.array(*(F.lit(c) for c in (1.00, 0.90, 0.85, 0.75, 0.72, 0.70))), F.col("b.tier") + 1)
    return best.select("ref", F.col("b.fqn").alias("target"), confidence.alias("confidence"))


def constant_values(sites: DataFrame, constants: DataFrame) -> DataFrame:
    """SQL constants of sites (site, file, const): the same file's first, else a name that is unique, else dynamic. constants: file, name, value."""
    local = unique_by(constants.select("file", F.col("name").alias("const"), "value"), ["file", "const"], "value").withColumnRenamed("value", "own")
    global_ = unique_by(constants.select(F.col("name").alias("const"), "value"), ["const"], "value").withColumnRenamed("value", "shared")
    return sites.join(local, ["file", "const"], "left").join(global_, "const", "left").select("site", F.coalesce("own", "shared").alias("value"), F.coalesce("own", "shared").isNull().alias("dynamic"))


def innermost(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """The smallest scope of the same file that contains each site: site, scope. sites: site, file, at; scopes: scope, file, first, last.

    Of equal scopes the first by id; sites outside of any scope are left out. A file's scopes
    and sites are swept together by place, the open scopes in a heap by width, so no pair
    of them is made; they fit a task.
    """
    kind, place = dict(sites.dtypes)["site"], dict(scopes.dtypes)["scope"]

    def sweep(key: tuple, own: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        spans, own = spans.sort_values("first", kind="stable"), own.sort_values("at", kind="stable")
        starts = list(zip(spans["first"], spans["last"], spans["scope"], strict=True))
        open_, at, out = [], 0, []
        for site, where in zip(own["site"], own["at"], strict=True):
            while at < len(starts) and starts[at][0] <= where:
                first, last, scope = starts[at]
                heapq.heappush(open_, (last - first, scope, last))
                at += 1
            while open_ and open_[0][2] < where:
                heapq.heappop(open_)
            if open_:
                out.append((site, open_[0][1]))
        return pd.DataFrame(out, columns=["site", "scope"])

    number = lambda df, *more: df.select(*(F.col(c).cast("double").alias(c) if c in ("at", "first", "last") else F.col(c) for c in more))
    left, right = number(sites, "site", "file", "at"), number(scopes, "scope", "file", "first", "last").where("first <= last")
    return left.groupBy("file").cogroup(right.groupBy("file")).applyInPandas(sweep, f"site {kind}, scope {place}")


def interceptions(edges: DataFrame) -> DataFrame:
    """Advice on methods: method, and its (kind, advice) in order; the kind is the reason's part after aop-."""
    kind = F.when(F.col("reason").startswith("aop-"), F.substring("reason", 5, 100)).otherwise("unknown")
    return edges.where("kind = 'ADVISES'").groupBy(F.col("dst").alias("method")).agg(F.sort_array(F.collect_set(F.struct(kind.alias("kind"), F.col("src").alias("advice")))).alias("advice"))


def database_effects(edges: DataFrame) -> DataFrame:
    """What methods do to tables through their queries: method, query, table, access."""
    runs = edges.where("kind = 'EXECUTES_QUERY'").select(F.col("src").alias("method"), F.col("dst").alias("query"))
    access = edges.where("kind IN ('READS_TABLE', 'WRITES_TABLE')").select(F.col("src").alias("query"), F.col("dst").alias("table"), F.when(F.col("kind") == "READS_TABLE", "read").otherwise("write").alias("access"))
    return runs.join(access, "query").select("method", "query", "table", "access").distinct()


def members(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """Members that sites mean: of one owner and name the same arity, else any overload, else a field. sites: site, owner, name, arity; defs: id, owner, name, arity, kind.

    Of overloads that rank alike only the first can be meant, so a site meets one row, however many there are.
    """
    field = F.col("kind").eqNullSafe("Field")
    exact = first_overloads(defs.where(~field), exact=True)
    some = defs.groupBy("owner", "name").agg(F.min(F.when(~field, F.col("id"))).alias("any"), F.min(F.when(field, F.col("id"))).alias("field"))
    found = with_exact(sites.select("site", "owner", "name", "arity").join(some, ["owner", "name"]), exact)
    choice = lambda tier, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(tier).alias("tier"), F.col(c).alias("id")))
    best = F.coalesce(choice(0, "exact"), choice(1, "any"), choice(2, "field"))
    return found.groupBy("site").agg(F.min(best).alias("best")).where("best IS NOT NULL").select("site", "best.id")


def first_overloads(defs: DataFrame, exact: bool) -> DataFrame:
    """The first id of each owner and name: owner, name, any; or of each arity too: owner, name, d_arity, exact."""
    if exact:
        return defs.groupBy("owner", "name", F.col("arity").alias("d_arity")).agg(F.min("id").alias("exact"))
    return defs.groupBy("owner", "name").agg(F.min("id").alias("any"))


def with_exact(rows: DataFrame, exact: DataFrame) -> DataFrame:
    """Rows (owner, name, arity) with the first overload of their own arity, or null; null arities are equal."""
    e = exact.select(F.col("owner").alias("e_owner"), F.col("name").alias("e_name"), "d_arity", "exact")
    return rows.join(e, (F.col("owner") == F.col("e_owner")) & (F.col("name") == F.col("e_name")) & F.col("arity").eqNullSafe(F.col("d_arity")), "left").drop("e_owner", "e_name", "d_arity")


def inherited_members(sites: DataFrame, defs: DataFrame, closure: DataFrame) -> DataFrame:
    """Like members, over the owner and all its ancestors, nearest first. closure: child, ancestor, distance."""
    own = sites.select("site", "owner", "name", "arity", F.lit(0).alias("distance"))
    up = sites.join(closure, F.col("owner") == F.col("child")).select("site", F.col("ancestor").alias("owner"), "name", "arity", "distance")
    d = defs.select("id", F.col("owner").alias("d_owner"), F.col("name").alias("d_name"), F.col("arity").alias("d_arity"))
    found = own.union(up).join(d, (F.col("owner") == F.col("d_owner")) & (F.col("name") == F.col("d_name")))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("distance", F.when(F.col("arity").eqNullSafe(F.col("d_arity")), 0).otherwise(1), "id"))
    return found.withColumn("rank", rank).where("rank = 1").select("site", "id", "distance")


def inherited_by_group(owners: DataFrame, names: DataFrame, defs: DataFrame, closure: DataFrame) -> DataFrame:
    """Like inherited_members, for sites that are all names of a group on all owners of it: owner, name, arity, id, distance. owners: owner, group; names: name, arity, group.

    It starts from the members and goes down to the owners of the same group that see
    them, so a site without any member is never made.
    """
    o = owners.select("owner", "group").distinct()
    line = o.select("owner", "group", F.col("owner").alias("ancestor"), F.lit(0).alias("distance")).unionByName(o.join(closure, F.col("owner") == F.col("child")).select("owner", "group", "ancestor", "distance"))
    d = defs.select("id", F.col("owner").alias("ancestor"), F.col("name"), F.col("arity").alias("d_arity"))
    meant = d.join(names.select("name", "arity", "group").distinct(), "name").select("id", "ancestor", "name", "arity", "group", (~F.col("arity").eqNullSafe(F.col("d_arity"))).alias("other"))
    found = meant.join(line, ["ancestor", "group"])
    best = found.groupBy("owner", "name", "arity").agg(F.min(F.struct("distance", "other", "id")).alias("best"))
    return best.select("owner", "name", "arity", "best.id", "best.distance")


def injected(points: DataFrame, beans: DataFrame) -> DataFrame:
    """Implementations behind injection points: by qualifier .95, the only bean .90, the only implementation .75; never the point's own type.

    points: point, type, qualifier, own; beans: impl, type, qualifier, is_bean.
    """
    # Whether one implementation is left without the own one shows in a group's number, least and greatest.
    b = beans.where("impl IS NOT NULL").select("impl", F.col("type").alias("t"), F.col("qualifier").alias("q"), "is_bean")
    out, lo, hi, n = points.where("own IS NOT NULL").select("point", F.col("type").alias("t"), F.col("qualifier").alias("q"), "own"), F.col("lo"), F.col("hi"), F.col("n")
    tiers = [(b, ["t", "q"], 0.95), (b.where("is_bean"), ["t"], 0.90), (b, ["t"], 0.75)]
    for k, (rows, key, _) in enumerate(tiers):
        spans = rows.groupBy(*key).agg(F.count_distinct("impl").alias("n"), F.min("impl").alias("lo"), F.max("impl").alias("hi"))
        other = lambda end, far: F.when((F.col("own") == end) & (n <= 2), F.when(n == 2, far)).otherwise(end)
        out = out.join(spans, key, "left").withColumns({f"lo{k}": other(lo, hi), f"hi{k}": other(hi, lo)}).drop("n", "lo", "hi")
    ends = out.groupBy("point").agg(*(f(f"{c}{k}").alias(f"{c}{k}") for k in range(len(tiers)) for c, f in (("lo", F.min), ("hi", F.max))))
    sole = [F.when(F.col(f"lo{k}") == F.col(f"hi{k}"), F.col(f"lo{k}")) for k in range(len(tiers))]
    confidence = F.coalesce(*(F.when(x.isNotNull(), F.lit(c)) for x, (_, _, c) in zip(sole, tiers, strict=True)))
    return ends.select("point", F.coalesce(*sole).alias("impl"), confidence.alias("confidence")).where("impl IS NOT NULL")


def overrides(methods: DataFrame, closure: DataFrame, kinds: DataFrame) -> DataFrame:
    """METHOD_OVERRIDES to the nearest class ancestor with the same signature, METHOD_IMPLEMENTS to every interface with it. methods: id, owner, signature; closure: child, ancestor, distance; kinds: type, kind."""
    base = methods.select(F.col("id").alias("dst"), F.col("owner").alias("ancestor"), "signature")
    found = methods.join(closure, F.col("owner") == F.col("child")).join(base, ["ancestor", "signature"]).join(kinds.select(F.col("type").alias("ancestor"), "kind"), "ancestor")
    nearest = F.row_number().over(Window.partitionBy("id").orderBy("distance", "dst"))
    over = found.where("kind = 'Class'").withColumn("rank", nearest).where("rank = 1").select(F.col("id").alias("src"), "dst", F.lit("METHOD_OVERRIDES").alias("kind"))
    return over.unionByName(found.where("kind = 'Interface'").select(F.col("id").alias("src"), "dst", F.lit("METHOD_IMPLEMENTS").alias("kind")).distinct())


def entity_tables(types: DataFrame) -> DataFrame:
    """Tables of entity classes: the declared name, else the class name in snake case. types: id, name, stereotype, table_name."""
    from ..functions.text import camel_to_snake

    return types.where("stereotype = 'entity'").select("id", F.upper(F.coalesce("table_name", camel_to_snake(F.col("name")))).alias("table"))


def feature_overrides(assigned: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned rows (id, feature) instead of what was assigned to their ids."""
    return assigned.join(pinned.select("id"), "id", "left_anti").unionByName(pinned)


def hybrid_features(strategies: Sequence[DataFrame], catch_all: str = "shared") -> DataFrame:
    """One feature an id from ordered strategies (id, feature, confidence): a later one that isn't the catch-all wins, of catch-alls the most confident."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("step", F.lit(k)) for k, s in enumerate(strategies)])
    named = F.col("feature") != catch_all
    order = F.struct(named.alias("named"), F.when(named, F.col("step")).otherwise(0).alias("late"), "confidence", "feature")
    return rows.groupBy("id").agg(F.max(order).alias("m")).select("id", "m.feature", "m.confidence")


def cross_repository_trace(edges: DataFrame, links: DataFrame, repo: str, node: str, depth: int = 6, hops: int = 3, most: int = 200) -> DataFrame:
    """Steps over repositories: repo, id, depth, hops. edges: repo, src, dst; links (consumer to provider): consumer_repo, consumer_id, provider_repo, provider_id.

    A link costs a hop. A node is met again as long as it takes fewer hops than on any
    level before, so no way is lost that the hops allow; its row has the least depth and
    the fewest hops. At most ``most`` nodes are returned, nearest first.
    """
    from ..sources.scratch import small, written

    inner = edges.select("repo", "src", F.col("repo").alias("to_repo"), "dst", F.lit(0).alias("hop"))
    outer = links.select(F.col("consumer_repo").alias("repo"), F.col("consumer_id").alias("src"), F.col("provider_repo").alias("to_repo"), F.col("provider_id").alias("dst"), F.lit(1).alias("hop"))
    steps = written(inner.union(outer).distinct(), "steps")
    seen = written(edges.sparkSession.createDataFrame([(repo, node, 0, 0)], "repo string, id string, depth int, hops int"), "trace")
    front = seen
    for d in range(1, depth + 1):
        step = steps.withColumnRenamed("src", "id").join(small(front), ["repo", "id"]).where(F.col("hops") + F.col("hop") <= hops)
        fresh = step.groupBy(F.col("to_repo").alias("repo"), F.col("dst").alias("id")).agg(F.min(F.col("hops") + F.col("hop")).alias("hops"))
        known = seen.groupBy("repo", "id").agg(F.min("hops").alias("least"))
        better = fresh.join(known, ["repo", "id"], "left").where("least IS NULL OR hops < least")
        front = written(better.select("repo", "id", F.lit(d).alias("depth"), "hops"), "trace")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("repo", "id").agg(F.min("depth").alias("depth"), F.min("hops").alias("hops")).orderBy("depth", "repo", "id").limit(most)
