"""Column expressions on names, paths, SQL and texts. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words of identifiers and prose: split at anything but ASCII letters and digits and at camel-case borders; lower case; longer than one."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    humps = F.regexp_replace(F.regexp_replace(plain, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), " +"), lambda t: F.length(t) > 1)


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contract_path(url: Column) -> Column:
    """Path of a URL for matching: no scheme, host or query; lower-case literals; variables and numbers as {*}; one slash between segments."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"^(\{.*\}|:.+|[0-9]+)$"), "{*}").otherwise(F.lower(s))), "/"))


def join_route(prefix: Column, path: Column) -> Column:
    joined = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def looks_like_sql(text: Column) -> Column:
    return F.upper(F.ltrim(text)).rlike("^(SELECT|INSERT|UPDATE|DELETE|MERGE|CALL|WITH)(?![A-Za-z0-9_])")


def sql_operation(text: Column) -> Column:
    op = F.regexp_extract(F.upper(F.ltrim(text)), "^(SELECT|INSERT|UPDATE|DELETE|MERGE|CALL|WITH)(?![A-Za-z0-9_])", 1)
    return F.when(op == "", None).otherwise(op)


def owner(node_id: Column) -> Column:
    """What an id ``Kind:owner#member`` belongs to; null without a member."""
    return F.when(node_id.contains("#"), F.substring_index(F.regexp_replace(node_id, "^[^:]*:", ""), "#", 1))


def simple_name(qualified: Column) -> Column:
    return F.regexp_replace(F.substring_index(qualified, ".", -1), "[<\\[(].*$", "")


def strip_lines(text: Column, noise: str = r"^\s*$|^\s*//|\blog(ger)?\.(trace|debug|info|warn|error)\(") -> Column:
    """The text without blank lines, comment lines and logging."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(noise)), "\n")


# What secrets look like, and the tags that replace them.
SECRETS = (
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED:private-key]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:access-key]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "[REDACTED:token]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[REDACTED:jwt]"),
    (r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)[\"'][^\"'\n]+[\"']", "$1$2[REDACTED:value]"),
)


def redact(text: Column) -> Column:
    for pattern, tag in SECRETS:
        text = F.regexp_replace(text, pattern, tag)
    return text


def cap(text: Column, characters: int) -> Column:
    return F.when(F.length(text) <= characters, text).otherwise(F.concat(F.substring(text, 1, characters), F.lit("…")))


def cell(text: Column) -> Column:
    """Safe in a table cell."""
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\\\|"), r"[\r\n]+", " ")


def route_prefix(path: Column, segments: int = 2) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, segments), "/"))


def wildcard_segments(path: Column, unresolved: str = "${") -> Column:
    """A path whose segments that hold an unresolved mark are {*}; null if it has no other segment."""
    parts = F.filter(F.split(normal_url(path), "/"), lambda s: s != "")
    marked = F.transform(parts, lambda s: F.when(s.contains(unresolved), "{*}").otherwise(s))
    return F.when((F.size(marked) > 0) & ~F.forall(marked, lambda s: s == "{*}"), F.concat(F.lit("/"), F.array_join(marked, "/")))


def normal_url(url: Column) -> Column:
    """An external URL's path: no scheme, host, query or fragment; one slash between segments, none at the end."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    joined = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def uri_scheme(uri: Column) -> Column:
    return F.substring_index(uri, ":", 1)


def uri_endpoint(uri: Column) -> Column:
    """What an endpoint URI names, without ``queue:`` or ``topic:`` and options; empty without a colon."""
    rest = F.when(F.instr(uri, ":") > 0, F.regexp_replace(uri, "^[^:]*:", "")).otherwise("")
    return F.substring_index(F.regexp_replace(rest, "^(queue|topic):", ""), "?", 1)


def type_pattern(pattern: str) -> str:
    """A regular expression for a pattern of type names: ``*`` is any run without a dot, ``..`` any run from a dot to a dot; a bare ``*`` is anything."""
    if pattern == "*":
        return "^[\\s\\S]*$"
    parts = re.split(r"(\.\.|\*)", pattern)
    return "^" + "".join({"..": r"\.(?:[\s\S]*\.)?", "*": "[^.]*"}.get(p, re.escape(p)) for p in parts) + "$"


def topic_name(node_id: Column, name: Column) -> Column:
    """A topic's name, or its id without the kind where it has none."""
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.regexp_replace(node_id, "^KafkaTopic:", ""))


def topic_kind(kind: Column, node_id: Column) -> Column:
    return F.when((kind == "KafkaTopic") | node_id.startswith("KafkaTopic:"), "kafka").otherwise("event")


def topic_label(kind: Column, node_id: Column, name: Column) -> Column:
    return F.concat_ws(" ", topic_kind(kind, node_id), topic_name(node_id, name))


def embedding_text(kind: Column, name: Column, qualified: Column, file: Column, first: Column, last: Column, props: Column, body: Column) -> Column:
    """The text of a node that is embedded: a line for each thing known of it, then its body."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    prop = lambda key, of: F.when(kind == of, F.get_json_object(props, f"$.{key}"))
    lines = F.when((F.coalesce(first, F.lit(0)) > 0) | (F.coalesce(last, F.lit(0)) > 0), F.concat(F.lit("lines: "), F.coalesce(first, F.lit(0)), F.lit("-"), F.coalesce(last, F.lit(0))))
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.concat_ws("\n", line("kind", kind), line("name", name), line("qualified_name", qualified), line("file", file), lines, line("http_method", prop("httpMethod", "Route")), line("path", prop("path", "Route")), line("uri", prop("uri", "IntegrationRoute")), line("source", prop("source", "IntegrationRoute")), F.when(trimmed != "", F.concat(F.lit("---\n"), trimmed)))


def document_text(kind: Column, name: Column, qualified: Column, node_id: Column, file: Column, props: Column) -> Column:
    """What is indexed of a node: its names, id and file, and the route, address or statement in its properties."""
    more = [F.get_json_object(props, f"$.{key}") for key in ("httpMethod", "path", "uri", "source", "sql", "table")]
    return F.concat_ws(" ", kind, name, qualified, node_id, file, *more)


def mdx_safe(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([{}])", r"\\$1"), "<", "&lt;")


def html_safe(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.regexp_replace(text, sign, name)
    return text


def diagram_id(text: Column) -> Column:
    """A name that diagrams accept: anything but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def call_sites(raw: Column) -> Column:
    """Call sites from JSON, an array of (line, args); what isn't such JSON is empty."""
    return F.coalesce(F.from_json(raw, "array<struct<line:int,args:array<string>>>"), F.array().cast("array<struct<line:int,args:array<string>>>"))


def annotation_attribute(annotations: Column, name: str, attribute: str) -> Column:
    """An attribute of the first annotation of that name in an array of (name, attrs); null without it."""
    own = F.filter(annotations, lambda a: a["name"] == name)
    return F.try_element_at(F.get(own, F.lit(0))["attrs"], F.lit(attribute))


def vector_json(vector: Column) -> Column:
    return F.to_json(vector)


def vector_from_json(raw: Column, size: int = 25) -> Column:
    """An array of that many numbers from JSON, or null."""
    parsed = F.from_json(raw, "array<double>")
    return F.when((F.size(parsed) == size) & ~F.exists(parsed, lambda x: x.isNull()), parsed)


def stable_distinct(values: Column) -> Column:
    """Each value once, in the order of its first place."""
    return F.array_distinct(values)


def is_part_of(part: Column, whole: Column) -> Column:
    """Is an array a contiguous part of another? The empty one is of any."""
    n, m = F.size(part), F.size(whole)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), m - n + 1))
    return F.when(n == 0, True).when(n > m, False).otherwise(F.exists(places, lambda k: F.slice(whole, k, n) == part))


def content_version(lines: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of lines in their order, each with a line end."""
    return F.substring(F.sha2(F.concat(F.array_join(F.array_sort(lines), "\n"), F.lit("\n")), 256), 1, 16)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def path_text(nodes: Column) -> Column:
    return F.array_join(nodes, "->")
