"""Build files and wiring documents as rows: project metadata, injected beans, integration routes.

Each file is read by itself, so files are spread over the tasks and one that can't be
read is a row with an error.
"""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from configparser import ConfigParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import uri_endpoint, uri_scheme

BUILD = "file string, tool string, name string, version string, grp string, dependencies array<string>, error string"
WIRING = "file string, kind string, bean string, class string, ref string, error string"
ENDPOINTS = "file string, route string, role string, uri string, error string"
# Build files by name, and schemes inside a process and of message brokers.
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "pyproject.toml", "setup.cfg")
INTERNAL_SCHEMES = ("direct", "seda", "vm", "direct-vm", "stub")
MESSAGE_SCHEMES = ("jms", "activemq", "amqp", "kafka", "rabbitmq", "sjms")


def plain_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(text: str) -> ET.Element:
    """The root of an XML text. Declarations of entities are refused: they can make a small file very large."""
    if "<!ENTITY" in text:
        raise ValueError("entities are not read")
    return ET.fromstring(text.encode())


def _child(node: ET.Element | None, name: str) -> str | None:
    found = None if node is None else next((c for c in node if plain_name(c.tag) == name), None)
    return found.text.strip() if found is not None and found.text else None


def build_metadata(file: str, text: str) -> dict:
    """tool, name, version, group and dependencies of one build file."""
    kind = file.rpartition("/")[2]
    if kind == "pom.xml":
        root = _tree(text)
        parent = next((c for c in root if plain_name(c.tag) == "parent"), None)
        found = [d for part in root if plain_name(part.tag) == "dependencies" for d in part]
        return {"tool": "maven", "name": _child(root, "artifactId"), "version": _child(root, "version") or _child(parent, "version"), "grp": _child(root, "groupId") or _child(parent, "groupId"), "dependencies": [f"{_child(d, 'groupId')}:{_child(d, 'artifactId')}" for d in found]}
    if kind.startswith("build.gradle"):
        value = lambda key: next(iter(re.findall(rf"^\s*{key}\s*=?\s*['\"]([^'\"]+)['\"]", text, re.MULTILINE)), None)
        wanted = re.findall(r"^\s*(?:api|implementation|compile|compileOnly|runtimeOnly|testImplementation)\s*\(?\s*['\"]([^'\"]+)['\"]", text, re.MULTILINE)
        return {"tool": "gradle", "name": value(r"rootProject\.name"), "version": value("version"), "grp": value("group"), "dependencies": [":".join(w.split(":")[:2]) for w in wanted]}
    if kind == "package.json":
        data = json.loads(text)
        return {"tool": "npm", "name": data.get("name"), "version": data.get("version"), "grp": None, "dependencies": sorted({*data.get("dependencies", {}), *data.get("devDependencies", {})})}
    if kind == "pyproject.toml":
        data = tomllib.loads(text)
        project, poetry = data.get("project", {}), data.get("tool", {}).get("poetry", {})
        wanted = [re.split(r"[\s<>=!~;\[]", d, maxsplit=1)[0] for d in project.get("dependencies", [])] + [d for d in poetry.get("dependencies", {}) if d != "python"]
        return {"tool": "python", "name": project.get("name") or poetry.get("name"), "version": project.get("version") or poetry.get("version"), "grp": None, "dependencies": wanted}
    if kind == "setup.cfg":
        config = ConfigParser(interpolation=None)
        config.read_string(text)
        wanted = config.get("options", "install_requires", fallback="").split("\n")
        return {"tool": "python", "name": config.get("metadata", "name", fallback=None), "version": config.get("metadata", "version", fallback=None), "grp": None, "dependencies": [re.split(r"[\s<>=!~;\[]", d.strip(), maxsplit=1)[0] for d in wanted if d.strip()]}
    raise ValueError(f"{kind} is no build file")


def wiring_rows(text: str) -> list[dict]:
    """Beans and their references in a wiring document: kind (bean or ref), bean, class, ref."""
    out = []

    def visit(node: ET.Element, inside: str | None) -> None:
        name, own = plain_name(node.tag), inside
        if name == "bean":
            own = node.get("id") or node.get("name") or node.get("class")
            out.append({"kind": "bean", "bean": own, "class": node.get("class"), "ref": None})
        elif name in ("service", "reference", "reference-list") and node.get("id"):
            own = node.get("id")
            out.append({"kind": "bean", "bean": own, "class": node.get("interface"), "ref": None})
        target = node.get("ref") or (node.get("bean") if name == "ref" else None)
        if target and own and target != own:
            out.append({"kind": "ref", "bean": own, "class": None, "ref": target})
        for child in node:
            visit(child, own)

    visit(_tree(text), None)
    return out


def endpoint_rows(text: str) -> list[dict]:
    """Endpoints of routes in an integration document: route, role (from, to, server), uri."""
    out, number = [], 0
    for node in _tree(text).iter():
        name = plain_name(node.tag)
        if name == "route":
            number += 1
            route = node.get("id") or f"route{number}"
            for step in node.iter():
                uri = step.get("uri")
                if uri and plain_name(step.tag) in ("from", "to", "toD", "wireTap", "enrich", "pollEnrich"):
                    out.append({"route": route, "role": "from" if plain_name(step.tag) == "from" else "to", "uri": uri})
        elif name == "server" and node.get("address"):
            out.append({"route": node.get("id") or node.get("address"), "role": "server", "uri": node.get("address")})
    return out


def _read(files: DataFrame, schema: str, rows_of) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, content in zip(frame["file"], frame["content"], strict=True):
                try:
                    out += [{"file": file, "error": None, **r} for r in rows_of(file, bytes(content).decode("utf-8", "replace"))]
                except Exception as e:  # whatever a file holds, it costs its own row only
                    out.append({"file": file, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out, columns=columns).astype(object).where(lambda d: d.notna(), None)

    return files.select("file", "content").mapInPandas(run, schema)


def read_build_files(files: DataFrame) -> DataFrame:
    """Metadata of the build files among files (file, content), with the folder that each is for (module)."""
    own = files.where(F.substring_index("file", "/", -1).isin(list(BUILD_FILES)))
    found = _read(own, BUILD, lambda file, text: [build_metadata(file, text)])
    return found.withColumn("module", F.regexp_replace("file", "/?[^/]*$", ""))


def read_wiring(files: DataFrame) -> DataFrame:
    """Beans and references of the wiring documents among files: XML with a root of beans or a blueprint."""
    text = F.col("content").cast("string")
    return _read(files.where(F.col("file").endswith(".xml") & text.rlike("<(\\w+:)?(beans|blueprint)[\\s>]")), WIRING, lambda file, text: wiring_rows(text))


def read_integration(files: DataFrame) -> DataFrame:
    """Endpoints of the integration documents among files, with scheme and name of each URI."""
    text = F.col("content").cast("string")
    found = _read(files.where(F.col("file").endswith(".xml") & text.rlike("<(\\w+:)?(route|server)[\\s>]")), ENDPOINTS, lambda file, text: endpoint_rows(text))
    return found.withColumn("scheme", uri_scheme(F.col("uri"))).withColumn("endpoint", uri_endpoint(F.col("uri")))


def integration_graph(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IntegrationRoute and MessageDestination nodes, and the INTEGRATION_LINK edges between routes and what they read or send to.

    A route that sends to another's internal endpoint is linked to that route.
    """
    own = endpoints.where("error IS NULL AND role <> 'server'")
    route = F.concat(F.lit("IntegrationRoute:"), "file", F.lit("#"), "route")
    routes = own.select(route.alias("id"), F.lit("IntegrationRoute").alias("kind"), F.col("route").alias("name"), "file").distinct()
    broker = own.where(F.col("scheme").isin(list(MESSAGE_SCHEMES)))
    target = F.concat(F.lit("MessageDestination:"), "scheme", F.lit(":"), "endpoint")
    places = broker.select(target.alias("id"), F.lit("MessageDestination").alias("kind"), F.col("endpoint").alias("name"), F.lit("").alias("file")).distinct()
    messages = broker.select(F.when(F.col("role") == "from", target).otherwise(route).alias("src"), F.when(F.col("role") == "from", route).otherwise(target).alias("dst"))
    inner = own.where(F.col("scheme").isin(list(INTERNAL_SCHEMES)))
    sends = inner.where("role = 'to'").select(route.alias("src"), "scheme", "endpoint")
    takes = inner.where("role = 'from'").select(route.alias("dst"), "scheme", "endpoint")
    links = sends.join(takes, ["scheme", "endpoint"]).select("src", "dst")
    return routes.unionByName(places), messages.union(links).distinct().select("src", "dst", F.lit("INTEGRATION_LINK").alias("kind"))
