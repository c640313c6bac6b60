import pytest
from graphs import contract

from graphloom.functions import render
from graphloom.functions.scanners import chunks, sql_tables
from graphloom.sources import artifacts, repository
from graphloom.streaming import incremental

PYTHON = '''import os
from flask import *

class Shop(Base):
    @app.get("/orders/{id}")
    def order(self, id):
        for x in self.items():
            if x:
                helper(x)

def helper(x):
    return os.path.join(x)
'''
JAVA = '''package com.acme;
import java.util.*;
@RequestMapping("/api")
public class Api {
  // class Hidden { void no() { } }
  @GetMapping("/things")
  public List<String> things(String a, int b) {
    for (String s : all()) { if (s.equals("}")) { log(s); } }
    return null;
  }
  void log(String s) { }
}
'''


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in {"shop/app.py": PYTHON, "api/Api.java": JAVA, "bad.py": "def (", "node_modules/x.js": "function f() {}", "run.go": "func main() {\n\tprintln(1)\n}\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return repository.walk(spark, str(root))


def test_walk_and_search(files):
    assert sorted(r.file for r in files.select("file").collect()) == ["api/Api.java", "bad.py", "run.go", "shop/app.py"]
    assert [(r.file, r.line) for r in repository.grep(files, r"helper\(").collect()] == [("shop/app.py", 9), ("shop/app.py", 11)]
    assert [r.line for r in repository.read_range(files, "shop/app.py", 2, 3).collect()] == [2, 3]
    nodes, edges = repository.folders(files)
    assert {r.id for r in nodes.collect()} == {"Folder:api", "Folder:shop", "File:api/Api.java", "File:bad.py", "File:run.go", "File:shop/app.py"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("Folder:api", "File:api/Api.java"), ("Folder:shop", "File:shop/app.py")}


def test_parse(files):
    units = repository.parse(files).cache()
    rows = {r.file: r for r in units.collect()}
    assert rows["bad.py"].error.startswith("SyntaxError") and rows["bad.py"].defs == []
    names = {d.name: d for d in rows["shop/app.py"].defs}
    assert names["order"].id == "Method:shop.app.Shop#order/1" and names["order"].cyclomatic == 3 and names["order"].loop_depth == 1
    assert [(r.method, r.path) for r in rows["shop/app.py"].routes] == [("GET", "/orders/{id}")]
    java = {d.name: d for d in rows["api/Api.java"].defs}
    assert set(java) == {"Api", "things", "log"} and java["things"].id == "Method:com.acme.Api#things/2" and java["things"].cyclomatic == 3
    assert [(r.method, r.path) for r in rows["api/Api.java"].routes] == [("GET", "/api/things")]
    calls = {(r.src, r.dst): r.confidence for r in repository.call_edges(units).collect()}
    assert calls["Method:shop.app.Shop#order/1", "Function:shop.app#helper/1"] == 0.9
    assert repository.definitions(units).count() == 7


@pytest.mark.parametrize(
    "sql,want",
    [
        ("SELECT a FROM t1, s.t2 x WHERE b = 'FROM t9'", [("T1", "Read"), ("T2", "Read")]),
        ("INSERT INTO log (a) VALUES (?)", [("LOG", "Write")]),
        ("DELETE FROM old WHERE id IN (SELECT id FROM keep)", [("OLD", "Write"), ("KEEP", "Read")]),
        ("update acct set n = 1 -- from nowhere", [("ACCT", "Write")]),
        ("WITH c AS (SELECT 1 FROM base) SELECT * FROM c JOIN d ON 1 = 1", [("BASE", "Read"), ("D", "Read")]),
        ("SELECT * FROM :param", []),
        (None, []),
    ],
)
def test_sql_tables(sql, want):
    assert sql_tables(sql) == want


def test_chunks():
    text = "é\n" * 3000
    parts = chunks(text, 4000, 500)
    data = text.encode()
    assert all(data[a : a + len(t.encode())].decode() == t and len(t.encode()) <= 4000 for a, _, _, t in parts)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][3].encode()) == len(data)
    assert all(b[0] <= a[0] + len(a[3].encode()) for a, b in zip(parts, parts[1:], strict=False))
    assert chunks("") == chunks(None) == []


def test_versions(spark, tmp_path):
    nodes, edges = contract(spark)
    sound = edges.dropDuplicates(["src", "dst", "kind"])
    root = str(tmp_path / "graph")
    artifacts.write_version(nodes, edges, root, "bad")
    with pytest.raises(ValueError):
        artifacts.publish(spark, root, "bad")
    version = artifacts.content_version(nodes, sound)
    assert version == artifacts.content_version(nodes.orderBy("name"), sound.orderBy("dst"))
    artifacts.write_version(nodes, sound, root, version)
    assert artifacts.publish(spark, root, version, expected_epoch=0) == 1
    with pytest.raises(RuntimeError):
        artifacts.publish(spark, root, version, expected_epoch=0)
    assert artifacts.current(spark, root)["nodes"] == 11 and artifacts.read_version(spark, root)[1].count() == 11
    assert set(artifacts.versions(spark, root)) == {"bad", version}
    artifacts.prune_versions(spark, root, 0)
    assert artifacts.versions(spark, root) == [version]


def test_records(spark, tmp_path):
    nodes, edges = contract(spark)
    artifacts.write_records(nodes, edges, str(tmp_path / "r"))
    assert artifacts.read_nodes(spark, str(tmp_path / "r/nodes")).count() == 11
    (tmp_path / "broken").write_text("{not json\n")
    with pytest.raises(Exception):
        artifacts.read_edges(spark, str(tmp_path / "broken")).collect()


def test_upsert(spark):
    nodes, edges = contract(spark)
    files = spark.createDataFrame([("com/acme/Bar.java",)], "file string")
    new = nodes.where("id = 'Method:com.acme.Bar#callee/0'")
    n, e = artifacts.upsert(nodes, edges, new, edges.where("dst = 'Method:com.acme.Bar#callee/0' AND kind = 'CALLS'"), files)
    assert n.count() == 9 and {(r.src, r.kind) for r in e.collect() if r.dst == "Method:com.acme.Bar#callee/0"} == {("Method:com.acme.Foo#caller/0", "CALLS")}


def test_increments(spark, tmp_path):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, hash string")
    after = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1"), ("e", "1")], before.schema)
    imports = spark.createDataFrame([("b", "a"), ("c", "b"), ("e", "c")], "src string, dst string")
    assert {r.path: r.depth for r in incremental.to_parse(before, after, imports, 1).collect()} == {"a": 0, "e": 0, "b": 1}
    assert {r.path for r in incremental.unchanged(before, after).collect()} == {"b", "c"}


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    events = spark.range(200).select((F.timestamp_seconds(F.col("id") * 600)).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    incremental.start_upserts(incremental.windowed_counts(stream, late="1000 days"), lambda batch, n: seen.append((n, batch.count())), str(tmp_path / "ck")).awaitTermination()
    assert seen and incremental.windowed_counts(events).agg(F.sum("n")).first()[0] == 200


def test_renderers(spark):
    nodes, edges = contract(spark)
    chart = render.mermaid_flow(edges)
    assert chart.startswith("flowchart TD") and chart.count("-->") == 11
    routes = spark.createDataFrame([("GET", "/a/:id", "h")], "method string, path string, handler string")
    assert render.openapi(routes)["paths"]["/a/{id}"]["get"]["parameters"][0]["name"] == "id"
    assert "\\|" in render.markdown_table(spark.createDataFrame([("a|b",)], "x string"))
    assert render.mermaid_sequence(["a", "b"]).endswith("step 1")
