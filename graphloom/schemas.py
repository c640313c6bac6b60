"""The two tables of a graph and the closed sets of their labels."""

from __future__ import annotations

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("qualified_name", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("props", T.StringType()),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("kind", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
        T.StructField("props", T.StringType()),
    ]
)

# The labels of nodes and edges.
NODE_KINDS = (
    "File", "Folder", "Class", "Interface", "Enum", "Record", "Annotation", "Method", "Function", "Constructor", "Field",
    "Route", "Community", "Process", "KafkaTopic", "ExternalEndpoint", "DbQuery", "DbTable", "IntegrationRoute", "MessageDestination", "Other",
)
EDGE_KINDS = (
    "CONTAINS", "CALLS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_FIELD", "IMPORTS", "ACCESSES", "USES", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "MEMBER_OF", "STEP_IN_PROCESS",
    "HANDLES_ROUTE", "PUBLISHES_EVENT", "LISTENS_TO", "EXTERNAL_CALL", "TESTS", "EXECUTES_QUERY", "READS_TABLE", "WRITES_TABLE", "INTEGRATION_LINK", "SIMILAR_TO", "TAINT_FLOW", "ADVISES", "REL",
)
TYPE_KINDS = ("Class", "Interface", "Enum", "Record", "Annotation")
CALLABLE_KINDS = ("Method", "Function", "Constructor")
FILE_SYMBOL_KINDS = ("Method", "Constructor", "Function", "Class", "Interface", "Enum")
EMBEDDABLE_KINDS = ("Class", "Interface", "Enum", "Record", "Annotation", "Method", "Constructor", "Field", "Route", "IntegrationRoute")
COMMUNITY_SYMBOL_KINDS = ("Class", "Interface", "Method", "Constructor")
FORWARD_STEPS = ("CALLS", "EXTERNAL_CALL", "PUBLISHES_EVENT")
DATA_STEPS = ("EXECUTES_QUERY", "READS_TABLE", "WRITES_TABLE")
REVERSED_STEPS = ("HANDLES_ROUTE", "LISTENS_TO")
PROJECTION_EDGES = (
    "CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "TESTS", "HANDLES_ROUTE", "EXTERNAL_CALL", "PUBLISHES_EVENT", "LISTENS_TO", "INTEGRATION_LINK", "EXECUTES_QUERY", "READS_TABLE", "WRITES_TABLE",
)
SEARCHABLE_KINDS = (*EMBEDDABLE_KINDS, "Function", "DbTable", "DbQuery", "MessageDestination")
KINDS_OF_USE = {"searchable": SEARCHABLE_KINDS, "embeddable": EMBEDDABLE_KINDS, "clusterable": EMBEDDABLE_KINDS, "community": COMMUNITY_SYMBOL_KINDS, "projection": PROJECTION_EDGES}
