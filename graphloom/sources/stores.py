"""What is kept beside a graph: bundles, parsed units, vectors, contracts, features, pages of text, and bounded scans of them.

Everything is a table in a folder; versions are folders, so that one can be dropped whole.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lookup import keyset_page
from ..schemas import EMBEDDABLE_KINDS
from .artifacts import _fs, _get, _put
from .scratch import small, written


def export_bundle(tables: dict[str, DataFrame], folder: str, **facts) -> dict:
    """Write tables, compressed, and last a manifest with their row counts and facts; returns the manifest."""
    manifest = {"facts": facts, "tables": {}}
    spark = None
    for name, df in sorted(tables.items()):
        spark = df.sparkSession
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        manifest["tables"][name] = {"rows": spark.read.parquet(f"{folder}/{name}").count(), "schema": df.schema.simpleString()}
    if spark is not None:
        _put(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def import_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of a bundle and its facts; a bundle without a manifest, or whose rows don't match it, is refused."""
    text = _get(spark, f"{folder}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"{folder} is no bundle")
    manifest = json.loads(text)
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}
    for name, df in tables.items():
        if df.count() != manifest["tables"][name]["rows"]:
            raise ValueError(f"{name} of {folder} is not whole")
    return tables, manifest["facts"]


def write_units(units: DataFrame, folder: str) -> None:
    """Parsed files, one a row with nested definitions, imports and references."""
    units.sortWithinPartitions("file").write.mode("overwrite").parquet(folder)


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def cached_units(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units of files whose content was parsed before, under their present names, and the files that have to be parsed. files: file, hash; cache: hash and a unit's columns."""
    known = cache.dropDuplicates(["hash"])
    return files.join(known.drop("file"), "hash"), files.join(known.select("hash"), "hash", "left_anti")


def chunks_to_embed(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose content isn't stored under the same node and place: node, chunk, hash, text. stored: node, chunk, hash."""
    return chunks.join(stored.select("node", "chunk", "hash"), ["node", "chunk", "hash"], "left_anti")


def merged_vectors(stored: DataFrame, fresh: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored chunks' vectors with fresh ones in their places, for nodes that still exist. Both: node, chunk, hash, vector."""
    kept = stored.join(fresh.select("node", "chunk"), ["node", "chunk"], "left_anti").select(*fresh.columns)
    return pruned(kept.unionByName(fresh), nodes)


def pruned(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors (column node) of nodes (column id) that exist."""
    return vectors.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi")


def node_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the wanted nodes (column id)."""
    return vectors.join(small(written(ids.select(F.col("id").alias("node")).distinct(), "ids")), "node", "left_semi")


def source_bodies(nodes: DataFrame, lines: DataFrame, kinds: Sequence[str] = EMBEDDABLE_KINDS) -> DataFrame:
    """id and body: the lines of each node's range of its file. nodes: id, kind, file, start_line, end_line; lines: file, line, text (from 1). Nodes without a range or file have no row."""
    own = nodes.where(F.col("kind").isin(list(kinds)) & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")))
    whole = lines.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("texts"))  # a file fits a row, as it did when it was read
    found = own.join(whole, "file").where(F.col("start_line") <= F.size("texts"))
    return found.select("id", F.array_join(F.slice("texts", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("body"))


def write_contracts(matches: DataFrame, folder: str) -> None:
    """Contract matches, a folder a kind, so that a filter by kind reads its own files."""
    matches.repartition("kind").sortWithinPartitions("match_key").write.mode("overwrite").partitionBy("kind").parquet(folder)


def read_contracts(spark: SparkSession, folder: str, kinds: Sequence[str] = ()) -> DataFrame:
    found = spark.read.parquet(folder)
    return found.where(F.col("kind").isin(list(kinds))) if kinds else found


def route_consumers(matches: DataFrame, match_key: str, limit: int = 100) -> tuple[DataFrame, bool]:
    """Consumers of a route in the order of repository and id, and whether these are all."""
    probe = written(matches.where(F.col("match_key") == match_key).select("consumer_repo", "consumer_id").distinct().orderBy("consumer_repo", "consumer_id").limit(limit + 1), "consumers")
    return probe.orderBy("consumer_repo", "consumer_id").limit(limit), probe.count() <= limit


def write_features(raw: DataFrame, merged: DataFrame, root: str, strategy: str, version: str) -> None:
    """Feature assignments as a strategy gave them and as merged with others, of one graph version; other versions of the strategy go."""
    spark = raw.sparkSession
    for name, df in (("raw", raw), ("merged", merged)):
        df.write.mode("overwrite").parquet(f"{root}/{strategy}/version={version}/{name}")
    fs, target = _fs(spark, f"{root}/{strategy}")
    for s in fs.listStatus(target):
        if s.getPath().getName() != f"version={version}":
            fs.delete(s.getPath(), True)


def read_features(spark: SparkSession, root: str, strategy: str, version: str) -> DataFrame | None:
    """The merged assignments of a version, or None if they are of another."""
    fs, target = _fs(spark, f"{root}/{strategy}/version={version}/merged")
    return spark.read.parquet(target.toString()) if fs.exists(target) else None


def record_page(records: DataFrame, kind: str, order: Sequence[str], after: Sequence | None = None, limit: int = 100) -> DataFrame:
    """A page of the records of one kind, and the probe row: of a table clustered by kind and order only its own row groups are read."""
    return keyset_page(records.where(F.col("kind") == kind), order, after, limit)


def write_entry_points(found: DataFrame, folder: str) -> None:
    """Entry points as JSON lines, best first."""
    found.orderBy(F.desc("score"), "id").coalesce(1).write.mode("overwrite").json(folder)  # entry points are limited


def changed_pages(pages: DataFrame, published: DataFrame) -> DataFrame:
    """Pages whose text isn't published under their path: path, text, change (added or modified); and removed ones without text. Both: path, text."""
    both = pages.select("path", "text").join(published.select("path", F.sha2("text", 256).alias("was")), "path", "full_outer")
    now = F.sha2("text", 256)
    change = F.when(F.col("was").isNull(), "added").when(F.col("text").isNull(), "removed").otherwise("modified")
    return both.where(~now.eqNullSafe(F.col("was"))).select("path", "text", change.alias("change"))


def ensure_tables(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """Create the database and its tables where they are missing; as often as one likes."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    for table, schema in columns.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}`.`{table}` ({schema}) USING parquet")


def drop_tables(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def modules_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Each file with its module, the longest folder that is a prefix of its path: file, module (null outside of all). modules: module (a folder, '' for the root)."""
    folders = F.transform(F.sequence(F.lit(0), F.size(F.split("file", "/")) - 1), lambda k: F.array_join(F.slice(F.split("file", "/"), 1, k), "/"))
    up = files.select("file", F.posexplode(folders).alias("depth", "module"))
    best = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("depth")))
    found = up.join(modules.select("module").distinct(), "module").withColumn("rank", best).where("rank = 1").select("file", "module")
    return files.select("file").join(found, "file", "left")


def module_sizes(files: DataFrame, modules: DataFrame) -> DataFrame:
    """module, files and lines of each module, and the language of most files. files: file, language, lines."""
    own = modules_of(files, modules).join(files, "file")
    counted = own.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))
    by = own.where("language IS NOT NULL").groupBy("module", "language").agg(F.count(F.lit(1)).alias("n"))
    most = by.groupBy("module").agg(F.min(F.struct(-F.col("n"), "language"))["language"].alias("language"))
    return counted.join(most, counted["module"].eqNullSafe(most["module"]), "left").select(counted["module"], "files", "lines", "language")


def fingerprint(*columns: Column) -> Column:
    """Sixteen hexadecimal digits of a row's values; null and empty differ."""
    return F.substring(F.sha2(F.to_json(F.struct(*(F.coalesce(c.cast("string"), F.lit("\0")).alias(f"c{k}") for k, c in enumerate(columns)))), 256), 1, 16)
