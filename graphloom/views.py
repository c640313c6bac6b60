"""Graph views over star-schema, event, page and document tables, so that every operator runs on shared data.

``SUPPLY_SQL`` and its siblings are the same views as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(kind: str, key: str, name, file, **more):
    columns = {"stereotype": ("string", None), "cyclomatic": ("int", None), "cognitive": ("int", None), "loop_depth": ("int", None), "amount": ("double", None)}
    extra = [(F.lit(None) if c not in more else more[c]).cast(t).alias(c) for c, (t, _) in columns.items()]
    return [F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), file.alias("file"), *extra]


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders as nodes; files follow geography, brand or order status."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders")}
    place = t["nation"].select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("r"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey")).alias("place"))
    customer = t["customer"].join(F.broadcast(place), F.col("c_nationkey") == F.col("nation"))
    supplier = t["supplier"].join(F.broadcast(place), F.col("s_nationkey") == F.col("nation"))
    parts = [
        t["region"].select(_node("Region", "r_regionkey", F.col("r_name"), F.concat(F.lit("r"), "r_regionkey"))),
        t["nation"].select(_node("Nation", "n_nationkey", F.col("n_name"), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey"))),
        customer.select(_node("Customer", "c_custkey", F.col("c_name"), F.concat("place", F.lit("/customer")), stereotype=F.when(F.col("c_mktsegment") == "MACHINERY", "test").otherwise(F.lower("c_mktsegment")), amount=F.col("c_acctbal"))),
        supplier.select(_node("Supplier", "s_suppkey", F.col("s_name"), F.concat("place", F.lit("/supplier")), amount=F.col("s_acctbal"))),
        t["part"].select(_node("Part", "p_partkey", F.col("p_name"), F.concat(F.lit("parts/"), "p_brand"), cyclomatic=F.col("p_size"), cognitive=F.col("p_size") % 7, loop_depth=F.col("p_size") % 4, amount=F.col("p_retailprice"))),
        t["orders"].select(_node("Order", "o_orderkey", F.col("o_orderkey"), F.concat(F.lit("orders/"), "o_orderstatus"), amount=F.col("o_totalprice"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS from customers to orders, orders to parts and suppliers to parts; MEMBER_OF nations; CONTAINS; TESTS by customers that are tests."""
    ident = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "supplier", "orders", "lineitem")}

    def plain(df: DataFrame, src, dst, kind: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(1.0).alias("confidence"), F.lit("key").alias("reason"))

    line = t["lineitem"].groupBy("l_orderkey", "l_partkey").agg(F.round(1 - F.avg("l_discount"), 6).alias("confidence"), F.max("l_returnflag").alias("reason"))
    tests = t["orders"].join(t["customer"].where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"))
    parts = [
        plain(t["orders"], ident("Customer", "o_custkey"), ident("Order", "o_orderkey"), "CALLS"),
        line.select(ident("Order", "l_orderkey").alias("src"), ident("Part", "l_partkey").alias("dst"), F.lit("CALLS").alias("kind"), "confidence", "reason"),
        plain(t["lineitem"].select("l_suppkey", "l_partkey").distinct(), ident("Supplier", "l_suppkey"), ident("Part", "l_partkey"), "CALLS"),
        plain(t["customer"], ident("Customer", "c_custkey"), ident("Nation", "c_nationkey"), "MEMBER_OF"),
        plain(t["supplier"], ident("Supplier", "s_suppkey"), ident("Nation", "s_nationkey"), "MEMBER_OF"),
        plain(t["nation"], ident("Region", "n_regionkey"), ident("Nation", "n_nationkey"), "CONTAINS"),
        plain(tests, ident("Customer", "o_custkey"), ident("Order", "o_orderkey"), "TESTS"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SUPPLY_SQL = """
place AS (SELECT n_nationkey AS nation, 'r' || n_regionkey || '/n' || n_nationkey AS place FROM nation),
nodes AS (
  SELECT 'Region:' || r_regionkey AS id, 'Region' AS kind, r_name AS name, 'r' || r_regionkey AS file, NULL::VARCHAR AS stereotype, NULL::INT AS cyclomatic, NULL::INT AS cognitive, NULL::INT AS loop_depth, NULL::DOUBLE AS amount FROM region
  UNION ALL SELECT 'Nation:' || n_nationkey, 'Nation', n_name, 'r' || n_regionkey || '/n' || n_nationkey, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'Customer', c_name, place || '/customer', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'test' ELSE lower(c_mktsegment) END, NULL, NULL, NULL, c_acctbal FROM customer JOIN place ON c_nationkey = nation
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name, place || '/supplier', NULL, NULL, NULL, NULL, s_acctbal FROM supplier JOIN place ON s_nationkey = nation
  UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name, 'parts/' || p_brand, NULL, p_size, p_size % 7, p_size % 4, p_retailprice FROM part
  UNION ALL SELECT 'Order:' || o_orderkey, 'Order', o_orderkey::VARCHAR, 'orders/' || o_orderstatus, NULL, NULL, NULL, NULL, o_totalprice FROM orders),
edges AS (
  SELECT 'Customer:' || o_custkey AS src, 'Order:' || o_orderkey AS dst, 'CALLS' AS kind, 1.0::DOUBLE AS confidence, 'key' AS reason FROM orders
  UNION ALL SELECT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CALLS', round(1 - avg(l_discount), 6), max(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'Supplier:' || l_suppkey, 'Part:' || l_partkey, 'CALLS', 1.0, 'key' FROM lineitem
  UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey, 'MEMBER_OF', 1.0, 'key' FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey, 'MEMBER_OF', 1.0, 'key' FROM supplier
  UNION ALL SELECT 'Region:' || n_regionkey, 'Nation:' || n_nationkey, 'CONTAINS', 1.0, 'key' FROM nation
  UNION ALL SELECT 'Customer:' || o_custkey, 'Order:' || o_orderkey, 'TESTS', 1.0, 'key' FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY')
"""


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as states and how often each follows another for one user; confidence is the share of the most frequent transition."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("event_type", F.lead("event_type").over(order).alias("next")).where("next IS NOT NULL")
    counts = steps.groupBy("event_type", "next").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most)).select(F.concat(F.lit("Event:"), "event_type").alias("src"), F.concat(F.lit("Event:"), "next").alias("dst"), F.lit("CALLS").alias("kind"), F.round(F.col("n") / F.col("most"), 6).alias("confidence"), F.lit("flow").alias("reason"), "n")


FLOW_SQL = """
steps AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
counts AS (SELECT event_type, next, count(*) AS n FROM steps WHERE next IS NOT NULL GROUP BY ALL),
edges AS (SELECT 'Event:' || event_type AS src, 'Event:' || next AS dst, 'CALLS' AS kind, round(n / (SELECT max(n) FROM counts), 6) AS confidence, 'flow' AS reason, n FROM counts)
"""


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as handlers of routes: page_id, host, path without its query."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return pages.select("page_id", F.regexp_extract(rest, "^([^/?#]*)", 1).alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


PAGES_SQL = """
routes AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages))
"""


def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code base: suppliers as types, what they supply as their methods, and routes, topics, queries and tables that methods touch.

    A method's role follows from its part's number; suppliers of every fifth nation are tests.
    """
    own = _methods(spark, sf_dir)
    types = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    place = lambda s, n: F.concat(F.lit("n"), n, F.lit("/S"), s, F.when(n % 5 == 0, "Test").otherwise(""), F.lit(".java"))
    none = lambda t: F.lit(None).cast(t)
    s, n, p = F.col("s"), F.col("n"), F.col("p")
    test = F.when(n % 5 == 0, "test")

    def plain(df: DataFrame, column: str, kind: str) -> DataFrame:
        name = F.regexp_replace(column, "^[A-Za-z]+:", "")
        return df.where(F.col(column).isNotNull()).select(F.col(column).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.lit("").alias("file"), none("string").alias("stereotype"), none("int").alias("cyclomatic"), none("int").alias("cognitive"), none("int").alias("loop_depth")).distinct()

    parts = [
        types.select(_type_id(s).alias("id"), F.when(s % 4 == 0, "Interface").otherwise("Class").alias("kind"), F.concat(F.lit("S"), s).alias("name"), place(s, n).alias("file"), test.alias("stereotype"), none("int").alias("cyclomatic"), none("int").alias("cognitive"), none("int").alias("loop_depth")),
        own.select("id", F.lit("Method").alias("kind"), "name", place(s, n).alias("file"), F.coalesce(test, F.when(p % 13 == 0, "scheduled"), F.when(p % 13 == 1, "utility")).alias("stereotype"), (p % 9).cast("int").alias("cyclomatic"), (p % 7).cast("int").alias("cognitive"), (p % 4).cast("int").alias("loop_depth")),
        plain(own, "route", "Route"), plain(own, "topic", "KafkaTopic"), plain(own, "query", "DbQuery"), plain(own, "db_table", "DbTable"),
        types.select(F.concat(F.lit("Community:"), n).alias("c")).transform(lambda d: plain(d, "c", "Community")),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HAS_METHOD, EXTENDS, IMPLEMENTS, CALLS (a line's method to the next line's of an order; cycles occur), TESTS, HANDLES_ROUTE, PUBLISHES_EVENT, LISTENS_TO, EXECUTES_QUERY, READS_TABLE, WRITES_TABLE, MEMBER_OF."""
    own = _methods(spark, sf_dir)
    types = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"))
    base = F.ceil(F.col("s") / 3)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _method_id(F.col("l_suppkey"), F.col("l_partkey")).alias("src"))
    after = F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "src"))
    calls = line.select("src", after.alias("dst")).where("dst IS NOT NULL").distinct()
    tested = calls.join(own.where("n % 5 = 0").select(F.col("id").alias("src")), "src", "left_semi").join(own.where("n % 5 <> 0").select(F.col("id").alias("dst")), "dst", "left_semi")

    def edge(df: DataFrame, src, dst, kind) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(1.0).alias("confidence"), F.lit("code").alias("reason")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()

    c = F.col
    parts = [
        edge(own, _type_id(c("s")), c("id"), "HAS_METHOD"), edge(types.where("s > 1"), _type_id(c("s")), _type_id(base), F.when(base % 4 == 0, "IMPLEMENTS").otherwise("EXTENDS")),
        edge(calls, c("src"), c("dst"), "CALLS"), edge(tested, c("src"), c("dst"), "TESTS"), edge(own, c("id"), c("route"), "HANDLES_ROUTE"),
        edge(own.where("p % 7 = 0"), c("id"), c("topic"), "PUBLISHES_EVENT"), edge(own.where("p % 7 = 1"), c("id"), c("topic"), "LISTENS_TO"), edge(own, c("id"), c("query"), "EXECUTES_QUERY"),
        edge(own, c("query"), c("db_table"), F.when(c("p") % 2 == 0, "READS_TABLE").otherwise("WRITES_TABLE")), edge(own, c("id"), F.concat(F.lit("Community:"), "n"), "MEMBER_OF"),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


def _type_id(s):
    return F.concat(F.lit("Class:S"), s.cast("string"))


def _method_id(s, p):
    return F.concat(F.lit("Method:S"), s.cast("string"), F.lit("#p"), p.cast("string"), F.lit("/0"))


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, n, id, name, and the route, topic, query and table of each method, or null."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    own = pairs.join(F.broadcast(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))), "s")
    p = F.col("p")
    verb = F.when(p % 6 == 0, "handle").when(p % 6 == 1, "get").when(p % 6 == 2, "run").otherwise("do")
    return own.select(
        "s", "p", "n", _method_id(F.col("s"), p).alias("id"), F.concat(verb, p).alias("name"),
        F.when(p % 10 == 0, F.concat(F.when(p % 20 == 0, "Route:GET /api/r").otherwise("Route:POST /api/r"), p % 70)).alias("route"),
        F.when(p % 7 <= 1, F.concat(F.lit("KafkaTopic:t"), p % 40)).alias("topic"),
        F.when(p % 11 == 0, F.concat(F.lit("DbQuery:S"), F.col("s"), F.lit("#q"), p)).alias("query"),
        F.when(p % 11 == 0, F.concat(F.lit("DbTable:T"), p % 30)).alias("db_table"),
    )


CODE_SQL = """
own AS (SELECT s, p, n, 'Method:S' || s || '#p' || p || '/0' AS id, CASE p % 6 WHEN 0 THEN 'handle' WHEN 1 THEN 'get' WHEN 2 THEN 'run' ELSE 'do' END || p AS name,
  CASE WHEN p % 10 = 0 THEN CASE WHEN p % 20 = 0 THEN 'Route:GET /api/r' ELSE 'Route:POST /api/r' END || (p % 70) END AS route, CASE WHEN p % 7 <= 1 THEN 'KafkaTopic:t' || (p % 40) END AS topic,
  CASE WHEN p % 11 = 0 THEN 'DbQuery:S' || s || '#q' || p END AS query, CASE WHEN p % 11 = 0 THEN 'DbTable:T' || (p % 30) END AS db_table
  FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) JOIN (SELECT s_suppkey AS s, s_nationkey AS n FROM supplier) USING (s)),
things AS (SELECT DISTINCT * FROM (SELECT route AS id, 'Route' AS kind FROM own UNION ALL SELECT topic, 'KafkaTopic' FROM own UNION ALL SELECT query, 'DbQuery' FROM own UNION ALL SELECT db_table, 'DbTable' FROM own UNION ALL SELECT 'Community:' || s_nationkey, 'Community' FROM supplier) WHERE id IS NOT NULL),
nodes AS (
  SELECT 'Class:S' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'Interface' ELSE 'Class' END AS kind, 'S' || s_suppkey AS name, 'n' || s_nationkey || '/S' || s_suppkey || CASE WHEN s_nationkey % 5 = 0 THEN 'Test' ELSE '' END || '.java' AS file, CASE WHEN s_nationkey % 5 = 0 THEN 'test' END AS stereotype, NULL::INT AS cyclomatic, NULL::INT AS cognitive, NULL::INT AS loop_depth FROM supplier
  UNION ALL SELECT id, 'Method', name, 'n' || n || '/S' || s || CASE WHEN n % 5 = 0 THEN 'Test' ELSE '' END || '.java', CASE WHEN n % 5 = 0 THEN 'test' WHEN p % 13 = 0 THEN 'scheduled' WHEN p % 13 = 1 THEN 'utility' END, (p % 9)::INT, (p % 7)::INT, (p % 4)::INT FROM own
  UNION ALL SELECT id, kind, regexp_replace(id, '^[A-Za-z]+:', ''), '', NULL, NULL, NULL, NULL FROM things),
lines AS (SELECT l_orderkey, l_linenumber, 'Method:S' || l_suppkey || '#p' || l_partkey || '/0' AS src FROM lineitem),
calls AS (SELECT DISTINCT * FROM (SELECT src, lead(src) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, src) AS dst FROM lines) WHERE dst IS NOT NULL),
edges AS (SELECT DISTINCT src, dst, kind, 1.0::DOUBLE AS confidence, 'code' AS reason FROM (
  SELECT 'Class:S' || s AS src, id AS dst, 'HAS_METHOD' AS kind FROM own
  UNION ALL SELECT 'Class:S' || s_suppkey, 'Class:S' || ceil(s_suppkey / 3)::BIGINT, CASE WHEN ceil(s_suppkey / 3)::BIGINT % 4 = 0 THEN 'IMPLEMENTS' ELSE 'EXTENDS' END FROM supplier WHERE s_suppkey > 1
  UNION ALL SELECT src, dst, 'CALLS' FROM calls
  UNION ALL SELECT src, dst, 'TESTS' FROM calls WHERE src IN (SELECT id FROM own WHERE n % 5 = 0) AND dst IN (SELECT id FROM own WHERE n % 5 <> 0)
  UNION ALL SELECT id, route, 'HANDLES_ROUTE' FROM own UNION ALL SELECT id, topic, 'PUBLISHES_EVENT' FROM own WHERE p % 7 = 0 UNION ALL SELECT id, topic, 'LISTENS_TO' FROM own WHERE p % 7 = 1
  UNION ALL SELECT id, query, 'EXECUTES_QUERY' FROM own UNION ALL SELECT query, db_table, CASE WHEN p % 2 = 0 THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END FROM own
  UNION ALL SELECT id, 'Community:' || n, 'MEMBER_OF' FROM own) WHERE src IS NOT NULL AND dst IS NOT NULL)
"""
