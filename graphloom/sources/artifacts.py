"""Graph artifacts: record files and Parquet under versioned folders, published by a pointer.

A version is a folder ``version=<v>`` with ``nodes`` and ``edges`` and a ``_COMPLETE``
mark that is written last; ``_CURRENT`` names the version that readers use and is
replaced by one rename.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import integrity
from ..schemas import EDGES, NODES


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path + ".tmp")
    out = fs.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()
    final = _fs(spark, path)[1]
    if fs.exists(final):
        fs.delete(final, False)
    fs.rename(target, final)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Records of nodes, one a line; the first bad line fails the read."""
    return spark.read.schema(NODES).option("mode", "FAILFAST").json(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Records of edges; a missing confidence is 1."""
    return spark.read.schema(EDGES).option("mode", "FAILFAST").json(path).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def write_records(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.sortWithinPartitions("id").write.mode("overwrite").json(f"{folder}/nodes")
    edges.sortWithinPartitions("src", "dst", "kind").write.mode("overwrite").json(f"{folder}/edges")


def write_version(nodes: DataFrame, edges: DataFrame, root: str, version: str) -> str:
    """Write a complete version; edges lie in a folder a kind, so a kind filter reads its own files only."""
    if not re.fullmatch(r"[\w.-]+", version):
        raise ValueError(f"not a version: {version!r}")
    folder = f"{root}/version={version}"
    nodes.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.repartition("kind", "src").sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/edges")
    _put(nodes.sparkSession, f"{folder}/_COMPLETE", version)
    return folder


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions, newest first; of equal times the greater name."""
    fs, target = _fs(spark, root)
    if not fs.exists(target):
        return []
    found = []
    for s in fs.listStatus(target):
        name = s.getPath().getName()
        mark = _fs(spark, f"{root}/{name}/_COMPLETE")[1]
        if name.startswith("version=") and fs.exists(mark):
            found.append((fs.getFileStatus(mark).getModificationTime(), name.removeprefix("version=")))
    return [v for _, v in sorted(found, reverse=True)]


def publish(spark: SparkSession, root: str, version: str, expected_epoch: int | None = None) -> int:
    """Point readers to a version whose graph has no fault; fails if another publisher came first."""
    nodes, edges = read_version(spark, root, version)
    faults = integrity(nodes, edges).first()
    if faults.duplicate_nodes or faults.duplicate_edges or faults.dangling_ends:
        raise ValueError(f"version {version} is not sound: {faults.asDict()}")
    now = current(spark, root)
    epoch = now["epoch"] if now else 0
    if expected_epoch is not None and expected_epoch != epoch:
        raise RuntimeError(f"epoch is {epoch}, not {expected_epoch}")
    _put(spark, f"{root}/_CURRENT", json.dumps({"version": version, "epoch": epoch + 1, "nodes": faults.nodes, "edges": faults.edges}))
    return epoch + 1


def current(spark: SparkSession, root: str) -> dict | None:
    text = _get(spark, f"{root}/_CURRENT")
    return json.loads(text) if text else None


def read_version(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a version, by default the published one."""
    if version is None:
        version = (current(spark, root) or {}).get("version")
        if version is None:
            raise FileNotFoundError(f"nothing is published in {root}")
    folder = f"{root}/version={version}"
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def prune_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all but the newest versions and the published one; returns what went."""
    live = (current(spark, root) or {}).get("version")
    gone = [v for v in versions(spark, root)[keep:] if v != live]
    for v in gone:
        fs, target = _fs(spark, f"{root}/version={v}")
        fs.delete(target, True)
    return gone


def content_version(nodes: DataFrame, edges: DataFrame) -> str:
    """Sixteen hexadecimal digits that depend on the rows, not on their order."""
    def digest(df: DataFrame) -> str:
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
        halves = [F.sum(F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(38,0)")) for start in (1, 16)]
        return str(df.agg(*halves, F.count(F.lit(1))).first())

    import hashlib

    return hashlib.sha256((digest(nodes) + digest(edges)).encode()).hexdigest()[:16]


def upsert(nodes: DataFrame, edges: DataFrame, delta_nodes: DataFrame, delta_edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace what changed and removed files (column file) held: their nodes go with all edges at them, the delta comes, dangling edges go."""
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id")
    new_nodes = nodes.join(gone, "id", "left_anti").unionByName(delta_nodes).dropDuplicates(["id"])
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(*edges.columns)
    ids = new_nodes.select("id")
    new_edges = kept.unionByName(delta_edges).dropDuplicates(["src", "dst", "kind"])
    whole = new_edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return new_nodes, whole.select(*edges.columns)
