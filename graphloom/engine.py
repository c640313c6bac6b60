"""One object over a graph: the named requests with their limits, each answered by a DataFrame or a small record."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import aggregates, contracts, lookup, projections, resolution, search, taint, traversal
from .schemas import FILE_SYMBOL_KINDS, SEARCHABLE_KINDS
from .sources.scratch import written
from .streaming.incremental import stale


@dataclass
class Page:
    """Rows of a page and whether more follow, which the probe row tells."""

    rows: DataFrame
    limit: int

    @property
    def has_more(self) -> bool:
        return self.rows.count() > self.limit

    def taken(self) -> DataFrame:
        return self.rows.limit(self.limit)


@dataclass(frozen=True)
class Completeness:
    """What was attempted of a total; complete only if nothing was left out and nothing failed."""

    total: int | None
    attempted: int
    failed: int = 0
    limited: bool = False

    @property
    def omitted(self) -> int:
        return 0 if self.total is None else max(0, self.total - self.attempted)

    @property
    def complete(self) -> bool:
        return self.omitted == 0 and self.failed == 0 and not (self.limited and self.total is None)


@dataclass
class Engine:
    nodes: DataFrame
    edges: DataFrame
    _index: search.SearchIndex | None = field(default=None, repr=False)

    def _seed(self, name: str) -> str:
        names = self.nodes.sparkSession.createDataFrame([(name,)], "name string")
        found = lookup.resolve(self.nodes, names).first()
        if found.status != "found":
            raise LookupError(f"{name!r} is {found.status}: {found.ids}")
        return found.ids[0]

    def _search(self, texts: DataFrame | None = None) -> search.SearchIndex:
        """The index over names, kinds and files, built once, or over ``texts`` (id, text)."""
        if self._index is None or texts is not None:
            kinds = self.nodes.where(F.col("kind").isin(list(SEARCHABLE_KINDS)))
            self._index = search.build_index(texts if texts is not None else kinds.select("id", F.concat_ws(" ", "kind", "name", "id", "file").alias("text")))
        return self._index

    def query(self, text: str, limit: int = 10, texts: DataFrame | None = None) -> DataFrame:
        """Best nodes for words; ``texts`` (id, text) replaces names, kinds and files as what is searched."""
        return search.bm25(self._search(texts), text, lookup.bounded("limit", limit, 1, 50))

    def query_expanded(self, text: str, limit: int = 10, radius: int = 1, kinds: Sequence[str] = (), node_budget: int = 500, edge_budget: int = 2000, byte_budget: int = 64_000) -> tuple[DataFrame, projections.Projection]:
        """Hits, and the graph around the first five of them, within budgets of nodes, edges and bytes; the projection tells whether one cut it."""
        hits = written(self.query(text, limit), "hits")
        seeds = hits.orderBy("rank").limit(5).select("id")
        around = traversal.subgraph(self.nodes, self.edges, seeds, radius, tuple(kinds), node_budget, edge_budget)
        named = around.nodes.join(self.nodes.select("id", "kind", "name"), "id")
        degree = aggregates.degrees(around.edges).select("id", "degree")
        rows = named.join(degree, "id", "left").select("id", "kind", "name", F.lit("entity").alias("role"), F.lit(1).cast("long").alias("member_count"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
        links = around.edges.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
        return hits, projections.contained(projections.Projection(rows, links, around.inconclusive), byte_budget)

    def feature_map(self, features: DataFrame, text: str, limit: int = 20) -> DataFrame:
        """Hits with the feature of each: id, score, rank, feature (``unclustered`` without one). features: id, feature."""
        return self.query(text, limit).join(features, "id", "left").withColumn("feature", F.coalesce("feature", F.lit("unclustered"))).orderBy("rank")

    def route_map(self, prefix: str = "", limit: int = 100) -> DataFrame:
        """Routes whose path begins with the prefix, and their handlers: id, name, file, handlers (in order)."""
        path = F.regexp_replace("id", "^Route:[A-Z]+ ", "")
        routes = self.nodes.where("kind = 'Route'").where(path.startswith(prefix)).select("id", "name", "file").orderBy("id").limit(lookup.bounded("limit", limit, 1, 500))
        handlers = self.edges.where("kind = 'HANDLES_ROUTE'").join(F.broadcast(routes.select(F.col("id").alias("dst"))), "dst").groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("handlers"))
        return routes.join(handlers, "id", "left").orderBy("id")

    def find_duplicates(self, name: str, least: float = 0.95, limit: int = 10) -> DataFrame:
        return lookup.similar_methods(self.nodes, self.edges, self._seed(name), least, limit)

    def test_coverage(self, name: str, after: Sequence | None = None, limit: int = 50) -> Page:
        limit = lookup.bounded("limit", limit, 1, 500)
        return Page(lookup.test_coverage(self.nodes, self.edges, self._seed(name), after=after, limit=limit), limit)

    def taint_paths(self, rules: DataFrame, hops: int = 12, limit: int = 100) -> Page:
        """Ways from sources to sinks that pass no sanitizer, most certain first. rules: kind (source, sink, sanitizer), pattern, category."""
        found = written(taint.matched_rules(self.nodes, rules), "rules")
        of = lambda kind: found.where(F.col("kind") == kind)
        sinks = of("sink").groupBy("id").agg(F.min("category").alias("category"))
        paths = taint.taint_paths(self.edges, of("source").select("id").distinct(), sinks, of("sanitizer").select("id").distinct(), lookup.bounded("hops", hops, 1, 20))
        return Page(paths.limit(lookup.bounded("limit", limit, 1, 500) + 1), limit)

    def group_contracts(self, contracts_: DataFrame, kind: str | None = None, limit: int = 200) -> Page:
        own = contracts_ if kind is None else contracts_.where(F.col("kind") == kind)
        return Page(own.orderBy("match_key", "provider_repo", "provider_id", "consumer_repo", "consumer_id").limit(lookup.bounded("limit", limit, 1, 1000) + 1), limit)

    def api_impact(self, contracts_: DataFrame, match_key: str, depth: int = 0) -> tuple[DataFrame, DataFrame]:
        """Contracts of a route or topic and the callers of its consumers; edges need a column repo."""
        return resolution.api_impact(contracts_, self.edges, match_key, lookup.bounded("depth", depth, 0, 10))

    def trace_across(self, links: DataFrame, repo: str, node: str, depth: int = 6, hops: int = 3) -> DataFrame:
        """Steps over repositories; edges need a column repo."""
        return contracts.cross_repository_trace(self.edges, links, repo, node, lookup.bounded("depth", depth, 1, 10), lookup.bounded("hops", hops, 0, 5))

    def page_status(self, pages: DataFrame, evidence: DataFrame) -> DataFrame:
        return stale(pages, evidence)

    def search_pages(self, pages: DataFrame, text: str, facets: Mapping[str, str] = {}, limit: int = 10) -> DataFrame:
        """Best pages (id, text, and columns for facets) for words among those with the facets' values."""
        for column, value in facets.items():
            pages = pages.where(F.col(column) == value)
        return search.bm25(search.build_index(pages), text, lookup.bounded("limit", limit, 1, 50))

    def status(self, saved: DataFrame, current: DataFrame) -> DataFrame:
        return lookup.staleness(current, saved)

    def context(self, name: str, limit: int = 100) -> dict[str, Page]:
        limit, root = lookup.bounded("limit", limit, 1, 500), self._seed(name)
        return {side: Page(lookup.neighbor_page(self.nodes, self.edges, root, way, limit=limit), limit) for side, way in (("callers", "in"), ("callees", "out"))}

    def impact(self, name: str, direction: str = "up", depth: int = 4) -> DataFrame:
        return traversal.impact(self.nodes, self.edges, self._seed(name), direction, depth)

    def trace_flow(self, name: str, depth: int = 6, offset: int = 0, limit: int = 100, hidden: Sequence[str] = ()) -> DataFrame:
        """Execution steps from an entry; hidden kinds are passed through and left out of the answer."""
        lookup.bounded("depth", depth, 1, 10)
        root = self._seed(name)
        walk = traversal.reach(self.nodes, lookup.execution_edges(self.edges), self.nodes.where(F.col("id") == root).select("id"), "down", depth)
        rows = walk.rows.join(self.nodes.select("id", "name", "kind"), "id").where(~F.col("kind").isin(list(hidden)) | (F.col("id") == root))
        return lookup.offset_page(rows, ("depth", "name", "id"), offset, lookup.bounded("limit", limit, 1, 500))

    def reaches(self, source: str, target: str, depth: int = 8, paths: int = 3, access: str = "any", node_budget: int | None = None) -> tuple[str, DataFrame]:
        """Reachable, not, or inconclusive within a budget, and the shortest paths; a bare target that isn't found is tried as a table, which ``access`` (any, read, write) may have to reach."""
        start = self._seed(source)
        try:
            end = self._seed(target)
        except LookupError:
            end = self._seed("DbTable:" + target.upper())
        steps = lookup.execution_edges(self.edges)
        if access != "any":  # only the last edge has to read or write
            last = lookup.final_edges(steps, access).where(F.col("dst") == end)
            steps = steps.where(F.col("dst") != end).unionByName(last)
        status = "reachable"
        if node_budget is not None:
            status = traversal.reaches(self.nodes, steps, start, end, depth, node_budget)
        found = traversal.shortest_paths(steps, start, end, depth, lookup.bounded("paths", paths, 1, 10))
        return (status if status == "inconclusive" else "not reachable" if found.isEmpty() else "reachable"), found

    def detect_changes(self, files: DataFrame, depth: int = 4) -> DataFrame:
        """What the nodes of changed files (column file) reach upstream: id, depth, risk by the number."""
        roots = self.nodes.where(F.col("kind").isin(list(FILE_SYMBOL_KINDS))).join(files.select("file").distinct(), "file", "left_semi").select("id")
        walk = traversal.reach(self.nodes, self.edges.where("kind = 'CALLS'"), roots, "up", depth)
        return walk.rows.withColumn("risk", traversal.risk(F.lit(walk.evaluated)))

    def communities(self, membership: DataFrame, limit: int = 500) -> DataFrame:
        return aggregates.quotient(self.edges.where("kind = 'CALLS'"), membership, limit)

    def hotspots(self, **limits) -> DataFrame:
        return lookup.hotspots(self.nodes, **limits)

    def untested(self, prefix: str = "", limit: int = 50) -> DataFrame:
        return lookup.untested(self.nodes, self.edges, prefix, limit=lookup.bounded("limit", limit, 1, 500))

    def regression_scope(self, files: DataFrame) -> DataFrame:
        return lookup.tests_for_files(self.nodes, self.edges, files)

    def shape_check(self, provided: DataFrame, consumed: DataFrame) -> DataFrame:
        return contracts.compare_fields(provided, consumed)

    #: Sections of the overview in the order in which a budget drops them, last first.
    SECTIONS = ("stats", "modules", "route_groups", "entry_points", "pages", "hotspots")

    def overview(self, pages: DataFrame | None = None, byte_budget: int = 32_768) -> tuple[dict[str, list], list[str]]:
        """Six short sections as rows, and the names of those that a budget of bytes left out: kinds, folders, route groups, entry points, pages and hotspots."""
        folder = F.regexp_extract("file", "^([^/]*)/", 1)
        modules = self.nodes.where(folder != "").groupBy(folder.alias("module")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(20)
        path = F.regexp_replace("id", "^Route:[A-Z]+ ", "")
        parts = {
            "stats": aggregates.summary(self.nodes), "modules": modules, "route_groups": aggregates.route_groups(self.nodes.where("kind = 'Route'").select(path.alias("path")), 20),
            "entry_points": aggregates.entry_points(self.nodes, self.edges, 20), "hotspots": lookup.hotspots(self.nodes, limit=20).select("id", "loop_depth", "cyclomatic"),
        }
        if pages is not None:
            parts["pages"] = pages.select("id").orderBy("id").limit(20)
        found = {name: [json.loads(x) for x in parts[name].toJSON().collect()] for name in self.SECTIONS if name in parts}  # 20 rows each, and the kinds
        dropped = []
        for name in reversed(self.SECTIONS):
            if len(json.dumps(found).encode()) <= byte_budget:
                break
            if name in found:
                del found[name]
                dropped.append(name)
        return found, dropped
