"""Pieces that several operators of this subpackage share.

Words are the ASCII-white-space separated runs of a text's UTF-8 bytes:
``bytes.split()`` splits on exactly x20 and x09-x0D, and ``bytes.lower()`` touches
A-Z only, so both equal the definitions by regular expression and need no decoding.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an operator holds in arrays at a time; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Bytes of a table up to which it may be broadcast.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or one of our own where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        named = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="graphloom-")
        shared_dir.own = named
    return re.sub("^file:/+", "file:///", named.rstrip("/"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back with the same schema.

    A lost executor then costs a reread, not a recomputation. The folder goes at the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: whoever owns the shared folder clears it
        pass


def small(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """The table marked for broadcast if its counted rows stay within BROADCAST_BYTES; otherwise a join shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def spread(names: DataFrame) -> DataFrame:
    """A task for each row: for lists of files, which are tiny beside what they name."""
    return names.coalesce(1).repartition(max(1, names.count()))


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Only the columns that an operator reads, the key as a long, strings as they are. Keys must be whole numbers: any other key fails as its cast does."""
    return df.select(F.col(key).cast("long").alias(key), *(F.col(c) for c in columns))


def held_out(key: Column | str, modulus: int) -> Column:
    """True if crc32 of the key as text leaves remainder 2; a null key is not held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def raw(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``limit`` bytes of text each, and their texts. At the end, freed memory goes back to the system: workers are reused."""
    with contextlib.ExitStack() as end:
        end.callback(trim)
        yield from _steps(batches, text, limit)


def _steps(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        at = batch.schema.get_field_index(text)
        first = 0
        while first < batch.num_rows:
            texts, size, last = [], 0, first
            for block in range(first, batch.num_rows, 256):
                for x in raw(batch.column(at).slice(block, 256)):
                    if texts and size + len(x) > limit:
                        break
                    texts.append(x)
                    size += len(x)
                    last += 1
                else:
                    continue
                break
            yield batch.slice(first, last - first), texts
            first = last
        pa.default_memory_pool().release_unused()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if (release := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        release(0)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Recent(dict):
    """A cache of bounded size: once ``room`` entries are new, or keys of ``room_bytes``, those not used since the last turn go.

    A key of over 1,024 bytes or characters is computed anew each time.
    """

    def __init__(self, make, room: int = 250_000, room_bytes: int = 8 << 20):
        super().__init__()
        self.make, self.room, self.room_bytes, self.bytes, self.before = make, room, room_bytes, 0, {}

    def __missing__(self, key):
        if len(key) > 1024:
            return self.make(key)
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.room or self.bytes > self.room_bytes:
            self.before = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += len(key)
        self[key] = value
        return value


class Files:
    """Raw files of the tasks under a folder that all of them share.

    A file gets a name of its own for each attempt and its final name only once it is
    whole. Callers keep the names that their tasks return, so what a lost or repeated
    attempt left behind is never read.
    """

    def __init__(self, uri: str):
        self.uri = uri

    def _at(self, name: str):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri)
        return system, f"{root}/{name}"

    def write(self, suffix: str, chunks: Iterable[bytes], by_content: bool = False) -> str:
        """The new file's name; by_content, equal contents have equal names wherever they are written."""
        name, digest = uuid.uuid4().hex, hashlib.sha256()
        system, part = self._at(name + ".part")
        system.create_dir(part.rpartition("/")[0], recursive=True)
        with system.open_output_stream(part) as out:
            for chunk in chunks:
                out.write(chunk)
                if by_content:
                    digest.update(chunk)
        name = (digest.hexdigest()[:32] if by_content else name) + suffix
        system.move(part, self._at(name)[1])
        return name

    def open(self, name: str) -> BinaryIO:
        """The file for reading, at any place of it."""
        system, path = self._at(name)
        return system.open_input_file(path)

    def read(self, name: str) -> bytes:
        with self.open(name) as f:
            return f.read()


def new_folder(spark: SparkSession, label: str) -> Files:
    """A folder for raw files below the shared one; it goes at the end of the program."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, uri)
    return Files(uri)
