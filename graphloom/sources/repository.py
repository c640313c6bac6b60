"""Source trees as tables: walking, reading, searching and parsing files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scanners import tables_of
from ..functions.text import sql_operation
from ..operators.lookup import in_scope
from .frontends import heritage_of, parse_braced, python_classes, python_cognitive, python_constants, python_signature, python_site
from .lexing import TYPE_WORDS

# Folders that are never sources, and file suffixes by language.
IGNORED = (".git", "node_modules", "target", "build", "dist", "__pycache__", ".venv", ".idea")
LANGUAGES = {"py": "python", "java": "java", "kt": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "rs": "rust", "cs": "csharp", "rb": "ruby", "php": "php", "scala": "scala", "c": "c", "cpp": "cpp", "sh": "bash", "ex": "elixir"}


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """file (relative to the root), language, size, content of every file outside ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")
    parts = F.split("file", "/")
    suffix = F.when(F.col("file").contains("."), F.substring_index("file", ".", -1))
    language = F.coalesce(*(F.when(suffix == s, v) for s, v in LANGUAGES.items()))
    own = files.withColumn("file", inner).where(~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))))
    return in_scope(own.select("file", language.alias("language"), F.col("length").alias("size"), "content"), include, exclude)


def lines(files: DataFrame) -> DataFrame:
    """file, line (from 1), text; bytes that aren't UTF-8 are replaced."""
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n")
    return files.select("file", F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def read_range(files: DataFrame, file: str, first: int, last: int, most: int = 2000) -> DataFrame:
    return lines(files.where(F.col("file") == file)).where(F.col("line").between(first, min(last, first + most - 1))).orderBy("line")


def grep(files: DataFrame, pattern: str, globs: tuple[str, ...] = (), limit: int = 200) -> DataFrame:
    """Matching lines in the order of file and line."""
    return lines(in_scope(files, globs)).where(F.col("text").rlike(pattern)).orderBy("file", "line").limit(min(limit, 1000))


def folders(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File and Folder nodes and the CONTAINS edges between them."""
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    chain = files.select("file", prefixes.alias("p"))
    entry = chain.select("file", F.posexplode("p").alias("i", "path"), F.size("p").alias("n")).select(F.when(F.col("i") == F.col("n") - 1, "File").otherwise("Folder").alias("kind"), "path")
    nodes = entry.distinct().select(F.concat("kind", F.lit(":"), "path").alias("id"), "kind", F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file"))
    pairs = chain.select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("up"), F.slice("p", 2, F.size("p")).alias("down"))).alias("e"), F.element_at("p", -1).alias("leaf")).where("e.up IS NOT NULL AND e.down IS NOT NULL")
    kind = F.when(F.col("e.down") == F.col("leaf"), "File:").otherwise("Folder:")
    edges = pairs.select(F.concat(F.lit("Folder:"), "e.up").alias("src"), F.concat(kind, "e.down").alias("dst"), F.lit("CONTAINS").alias("kind")).distinct()
    return nodes, edges


UNIT = (
    "file string, language string, error string, "
    "defs array<struct<id:string,kind:string,name:string,first:int,last:int,cyclomatic:int,cognitive:int,loop_depth:int,leaf_tokens:int,minhash:array<long>>>, "
    "imports array<struct<raw:string,is_wildcard:boolean>>, refs array<struct<name:string,owner:string,line:int>>, "
    "routes array<struct<method:string,path:string,handler:string,framework:string>>, "
    "sites array<struct<src:string,kind:string,framework:string,method:string,literal:string,folded:string,mode:string,line:int>>, "
    "heritage array<struct<child:string,parent:string,kind:string>>, constants array<struct<name:string,value:string>>, bindings array<struct<name:string,type:string>>"
)
FACTS = ("defs", "imports", "refs", "routes", "sites", "heritage", "constants", "bindings")


def parse(files: DataFrame) -> DataFrame:
    """One row a file of what it defines, imports, calls and serves, and of the sites that speak to the outside; a file that can't be parsed has an error and nothing else."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, language, content in zip(frame["file"], frame["language"], frame["content"], strict=True):
                unit = {name: [] for name in FACTS}
                error = None
                try:
                    text = bytes(content).decode("utf-8", "replace")
                    unit |= parse_python(file, text) if language == "python" else parse_braced(file, text, language) if language in TYPE_WORDS else parse_generic(file, text)
                except (SyntaxError, ValueError, RecursionError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append({"file": file, "language": language, "error": error, **unit})
            yield pd.DataFrame(rows, columns=["file", "language", "error", *FACTS])

    return files.select("file", "language", "content").mapInPandas(run, UNIT)


_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)
_LOOPS = (ast.For, ast.While, ast.AsyncFor)


def _loop_depth(node: ast.AST) -> int:
    inner = max((_loop_depth(c) for c in ast.iter_child_nodes(node)), default=0)
    return inner + isinstance(node, _LOOPS)


def parse_python(file: str, text: str) -> dict:
    tree = ast.parse(text)
    module = re.sub(r"(/__init__)?\.py$", "", file).replace("/", ".")
    constants, classes, tokens = python_constants(tree), [], python_classes(text)
    out: dict = {"defs": [], "imports": [], "refs": [], "routes": [], "sites": [], "constants": [{"name": k, "value": v} for k, v in constants.items()]}

    def sites(node: ast.AST, ident: str) -> None:
        """Sites outside of inner functions, which are visited themselves."""
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(child, ast.Call) and (site := python_site(child, ident, constants)) is not None:
                out["sites"].append(site)
            sites(child, ident)

    def visit(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "Method" if in_class else "Function"
                arity = len(child.args.posonlyargs + child.args.args) - in_class
                ident = f"{kind}:{owner}#{child.name}/{arity}"
                branches = sum(isinstance(n, _BRANCHES) for n in ast.walk(child))
                size, minhash = python_signature(tokens, child.lineno, child.end_lineno or child.lineno)
                out["defs"].append({"id": ident, "kind": kind, "name": child.name, "first": child.lineno, "last": child.end_lineno, "cyclomatic": 1 + branches, "cognitive": python_cognitive(child), "loop_depth": _loop_depth(child), "leaf_tokens": size, "minhash": minhash})
                sites(child, ident)
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                        verb = d.func.attr.upper()
                        if verb in ("GET", "POST", "PUT", "PATCH", "DELETE"):
                            out["routes"].append({"method": verb, "path": d.args[0].value, "handler": ident, "framework": "decorator"})
                        elif verb == "ROUTE":
                            methods = next((k.value for k in d.keywords if k.arg == "methods"), None)
                            names = [e.value for e in methods.elts if isinstance(e, ast.Constant)] if isinstance(methods, (ast.List, ast.Tuple)) else ["GET"]
                            out["routes"] += [{"method": n.upper(), "path": d.args[0].value, "handler": ident, "framework": "decorator"} for n in names]
                for n in ast.walk(child):
                    if isinstance(n, ast.Call):
                        name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
                        if name:
                            out["refs"].append({"name": name, "owner": ident, "line": n.lineno})
                visit(child, f"{owner}.{child.name}", False)
            elif isinstance(child, ast.ClassDef):
                full = f"{owner}.{child.name}"
                out["defs"].append({"id": f"Class:{full}", "kind": "Class", "name": child.name, "first": child.lineno, "last": child.end_lineno, "cyclomatic": 0, "cognitive": 0, "loop_depth": 0, "leaf_tokens": 0, "minhash": None})
                classes.append((f"Class:{full}", child))
                visit(child, full, True)
            elif isinstance(child, ast.Import):
                out["imports"] += [{"raw": a.name, "is_wildcard": False} for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                base = "." * child.level + (child.module or "")
                out["imports"] += [{"raw": f"{base}.{a.name}", "is_wildcard": a.name == "*"} for a in child.names]
            else:
                visit(child, owner, in_class)

    visit(tree, module, False)
    sites(tree, f"File:{file}")
    return out | {"heritage": heritage_of(classes)}


_CALL = re.compile(r"\b(\w+)\s*\(")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "try", "super", "this", "def", "function", "func", "fn"}


_GENERIC_DEF = re.compile(r"^\s*(?:export\s+|pub\s+|public\s+|private\s+|async\s+|static\s+)*(?:(class|struct|trait|interface|enum|module|type)|(def|fn|func|fun|function|sub|proc))\s+(\w+)", re.MULTILINE)


def parse_generic(file: str, text: str) -> dict:
    """Types, functions and calls of languages without braces, by the keywords that open them."""
    module = re.sub(r"\.\w+$", "", file).replace("/", ".")
    out: dict = {"defs": [], "imports": [], "refs": [], "routes": []}
    for m in _GENERIC_DEF.finditer(text):
        kind = "Class" if m[1] else "Function"
        at = text.count("\n", 0, m.start(3)) + 1
        out["defs"].append({"id": f"{kind}:{module}#{m[3]}" if m[2] else f"{kind}:{module}.{m[3]}", "kind": kind, "name": m[3], "first": at, "last": at, "cyclomatic": 0, "cognitive": 0, "loop_depth": 0, "leaf_tokens": 0, "minhash": None})
    out["refs"] = [{"name": c[1], "owner": f"File:{file}", "line": text.count("\n", 0, c.start()) + 1} for c in _CALL.finditer(text) if c[1] not in _KEYWORDS]
    return out


def definitions(units: DataFrame) -> DataFrame:
    """Nodes of all definitions, one an id, the first by file."""
    rows = units.select("file", F.explode("defs").alias("d")).select("d.id", "d.kind", "d.name", "file", F.col("d.first").alias("start_line"), F.col("d.last").alias("end_line"), "d.cyclomatic", "d.cognitive", "d.loop_depth", "d.leaf_tokens", F.col("d.minhash").alias("signature"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("file", "start_line"))).where("rank = 1").drop("rank")


def call_edges(units: DataFrame) -> DataFrame:
    """CALLS edges of references whose name has one definition: in the same file (.9), else anywhere (.7); best edge a key, with its call sites."""
    refs = units.select("file", F.explode("refs").alias("r")).select("file", F.col("r.owner").alias("src"), "r.name", "r.line")
    defs = units.select("file", F.explode("defs").alias("d")).where("d.kind IN ('Method', 'Function')").select("file", "d.name", F.col("d.id").alias("dst"))
    only = lambda df, *keys: df.groupBy(*keys).agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1").drop("n")
    local = refs.join(only(defs, "file", "name"), ["file", "name"], "left").withColumnRenamed("dst", "own")
    both = local.join(only(defs, "name"), "name", "left").where("own IS NOT NULL OR dst IS NOT NULL")
    edge = both.select("src", F.coalesce("own", "dst").alias("dst"), F.when(F.col("own").isNotNull(), 0.9).otherwise(0.7).alias("confidence"), "line").where("src <> dst")
    return edge.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.slice(F.sort_array(F.collect_set("line")), 1, 20).alias("lines")).withColumn("kind", F.lit("CALLS"))


def contract_sites(units: DataFrame) -> DataFrame:
    """file and the columns of each site, for ``contract_edges``."""
    return units.select("file", F.explode("sites").alias("s")).select("file", "s.*")


def route_graph(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes, one a verb and path, and HANDLES_ROUTE edges of their handlers."""
    rows = units.select("file", F.explode("routes").alias("r")).select("file", F.concat_ws(" ", "r.method", "r.path").alias("name"), "r.handler", "r.framework")
    nodes = rows.groupBy("name").agg(F.min("file").alias("file")).select(F.concat(F.lit("Route:"), "name").alias("id"), F.lit("Route").alias("kind"), "name", "file")
    held = rows.where("handler IS NOT NULL").groupBy("handler", "name").agg(F.min("framework").alias("framework"))
    return nodes, held.select(F.col("handler").alias("src"), F.concat(F.lit("Route:"), "name").alias("dst"), F.lit("HANDLES_ROUTE").alias("kind"), F.lit(1.0).alias("confidence"), F.col("framework").alias("reason"))


def query_graph(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DbQuery and DbTable nodes, EXECUTES_QUERY edges, and READS_TABLE and WRITES_TABLE edges of each query.

    SQL names its tables itself; object mappers name one table. A query known by its text
    counts .9, one whose text constants gave .8.
    """
    own = contract_sites(units).where("kind = 'query'").withColumn("text", F.coalesce("literal", "folded"))
    own = own.withColumn("query", F.concat(F.lit("DbQuery:"), "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.substring(F.sha2("text", 256), 1, 8)))
    mapped = F.array(F.struct(F.upper("text").alias("table"), F.col("mode").alias("mode")))
    touched = own.withColumn("tables", F.when(F.col("mode").isNull(), tables_of(F.col("text"))).otherwise(mapped)).select("query", F.explode("tables").alias("t"))
    operation = F.coalesce(sql_operation(F.col("text")), F.upper("method"))
    queries = own.groupBy("query").agg(F.min(F.concat_ws(" ", operation, F.col("framework"))).alias("name"), F.min("file").alias("file"))
    nodes = queries.select(F.col("query").alias("id"), F.lit("DbQuery").alias("kind"), "name", "file")
    nodes = nodes.unionByName(touched.select(F.concat(F.lit("DbTable:"), "t.table").alias("id"), F.lit("DbTable").alias("kind"), F.col("t.table").alias("name"), F.lit(None).cast("string").alias("file")).distinct())
    runs = own.select("src", F.col("query").alias("dst"), F.lit("EXECUTES_QUERY").alias("kind"), F.when(F.col("literal").isNotNull(), 0.9).otherwise(0.8).alias("confidence"))
    uses = touched.select(F.col("query").alias("src"), F.concat(F.lit("DbTable:"), "t.table").alias("dst"), F.when(F.col("t.mode") == "Write", "WRITES_TABLE").otherwise("READS_TABLE").alias("kind"), F.lit(0.9).alias("confidence"))
    return nodes, runs.unionByName(uses).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


def body_signatures(units: DataFrame) -> DataFrame:
    """id and signature of callables whose bodies are long enough, for ``similar_pairs``."""
    return definitions(units).where("signature IS NOT NULL").select("id", "signature")
