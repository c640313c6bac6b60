"""Small graphs whose answers are known."""

NODES = "id string, kind string, name string, file string, stereotype string, cyclomatic int, cognitive int, loop_depth int"
EDGES = "src string, dst string, kind string, confidence double, reason string"

FOO, BAR = "com/acme/Foo.java", "com/acme/Bar.java"
CALLER, CALLEE, HANDLER = "Method:com.acme.Foo#caller/0", "Method:com.acme.Bar#callee/0", "Method:com.acme.Api#getThings/0"
ROUTE, LISTENER, TOPIC = "Route:GET /api/things", "Method:com.acme.AuditListener#onAudit/1", "KafkaTopic:audit-events"
QUERY, TABLE_ = "DbQuery:com.acme.Bar#INSERT_AUDIT", "DbTable:AUDIT_LOG"


def contract(spark):
    """A handler, its calls, tests, a listener that closes a cycle, and effects on a table; one CALLS edge is there twice."""
    nodes = [
        (CALLER, "Method", "caller", FOO, None, 7, 9, 1), (CALLEE, "Method", "callee", BAR, None, 1, 0, 0), (HANDLER, "Method", "getThings", "com/acme/Api.java", None, 1, 0, 0),
        (ROUTE, "Route", "GET /api/things", "com/acme/Api.java", None, None, None, None), ("Class:com.acme.Bar", "Class", "Bar", BAR, None, None, None, None),
        ("Method:com.acme.BarTest#testCallee/0", "Method", "testCallee", "com/acme/BarTest.java", "test", 1, 0, 0), ("Method:com.acme.BarTest#testClass/0", "Method", "testClass", "com/acme/BarTest.java", "test", 1, 0, 0),
        (QUERY, "DbQuery", "INSERT_AUDIT", BAR, None, None, None, None), (TABLE_, "DbTable", "AUDIT_LOG", None, None, None, None, None), (TOPIC, "KafkaTopic", "audit-events", None, None, None, None, None), (LISTENER, "Method", "onAudit", "com/acme/AuditListener.java", None, 1, 0, 0),
    ]
    links = [
        (CALLER, CALLEE, "CALLS"), (CALLER, CALLEE, "CALLS"), (HANDLER, CALLER, "CALLS"), (HANDLER, ROUTE, "HANDLES_ROUTE"), ("Class:com.acme.Bar", CALLEE, "HAS_METHOD"), ("Method:com.acme.BarTest#testCallee/0", CALLEE, "TESTS"),
        ("Method:com.acme.BarTest#testClass/0", "Class:com.acme.Bar", "TESTS"), (CALLEE, QUERY, "EXECUTES_QUERY"), (QUERY, TABLE_, "WRITES_TABLE"), (CALLEE, TOPIC, "PUBLISHES_EVENT"), (LISTENER, TOPIC, "LISTENS_TO"), (LISTENER, CALLER, "CALLS"),
    ]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, k, 1.0, "contract") for a, b, k in links], EDGES)


def plain(spark, pairs, kind="CALLS"):
    ids = sorted({x for p in pairs for x in p[:2]})
    nodes = spark.createDataFrame([(i, "Method", i, "f", None, 1, 0, 0) for i in ids], NODES)
    return nodes, spark.createDataFrame([(p[0], p[1], kind, p[2] if len(p) > 2 else 1.0, "r") for p in pairs], EDGES)
