"""Token ids packed into rows of fixed length, as raw binary files.

A document's ids and an end mark are its segment; one longer than a row is split into
whole rows and a rest, so that no id is lost. Segments are placed longest first, each
into the row with the least room that still holds it (best fit decreasing). A segment
tree over the amounts of room, 0 to the row length, finds that row in a logarithmic number
of steps.

A shard holds a bounded number of ids and becomes three files: the matrix of ids
(unsigned 16- or 32-bit, rows padded with the end mark), the cumulative segment lengths
(int32, for each row from 0 on) with the rows' first entries, and for each segment its
document and whether that has a key, its offset in the document, and the place in the row
where positions restart at 0. A shard takes documents in the order of its input partition:
which documents share one follows from the input's partitions, not from their keys.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, keyed, spread, steps, table, written

ROW = 2048
#: Ids that a shard holds at most, but for one document that is longer.
SHARD_IDS = 8 << 20
#: Runs of white space from this length on are encoded as one piece each, without the pattern.
LONG_RUN = 1000
# The characters that are white space in patterns, and the alternatives that split a run of it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RULE = r"\s+(?!\S)|\s+"
_LONG = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")


class RoomTree:
    """Open rows by the room that they have left; finds the row with the least sufficient room."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of at least ``need``."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], row: int) -> tuple[list[int], int]:
    """The row of each segment (lengths up to ``row``) and the number of rows. Of equal lengths the earlier goes first."""
    tree, place, rows = RoomTree(row), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found, rows = (row, rows), rows + 1
        room, place[i] = found
        tree.add(room - lengths[i], place[i])
    return place, rows


def pack(keys: list[int | None], docs: list[np.ndarray], end: int, row: int = ROW) -> dict[str, np.ndarray]:
    """The arrays of a shard. Each of ``docs`` ends with its end mark; an empty array takes no room."""
    segments = [(d, at, min(len(ids), at + row)) for d, ids in enumerate(docs) for at in range(0, len(ids), row)]
    place, rows = best_fit_decreasing([b - a for _, a, b in segments], row)
    kind = docs[0].dtype if docs else np.dtype("<u2")
    matrix = np.full((rows, row), end, dtype=kind)
    order = sorted(range(len(segments)), key=lambda i: (place[i], segments[i][0], segments[i][1]))
    used = [0] * rows
    lengths, first, doc, known, offset, reset = [], [], [], [], [], []
    for i in order:
        d, a, b = segments[i]
        r, start = place[i], used[place[i]]
        if not start:
            first.append(len(lengths))
            lengths.append(0)
        matrix[r, start : start + b - a] = docs[d][a:b]
        used[r] = start + b - a
        lengths.append(used[r])
        doc.append(keys[d] or 0)
        known.append(keys[d] is not None)
        offset.append(a)
        reset.append(start)
    return {"ids": matrix, "cu_seqlens": np.array(lengths, dtype="<i4"), "row_first": np.array([*first, len(lengths)], dtype="<i8"), "doc": np.array(doc, dtype="<i8"), "known": np.array(known, dtype=bool), "offset": np.array(offset, dtype="<i8"), "reset": np.array(reset, dtype="<i4")}


def _file(arrays: dict[str, np.ndarray]) -> Iterator[bytes]:
    """NumPy's format, one array after the other."""
    for a in arrays.values():
        out = io.BytesIO()
        np.lib.format.write_array(out, a, allow_pickle=False)
        yield out.getvalue()


def _arrays(data: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    source = io.BytesIO(data)
    return {n: np.lib.format.read_array(source, allow_pickle=False) for n in names}


FILES = {"ids_file": ("ids",), "lengths_file": ("cu_seqlens", "row_first"), "segments_file": ("doc", "known", "offset", "reset")}
_MANIFEST = pa.schema([*((n, pa.string()) for n in FILES), ("rows", pa.int64()), ("n_ids", pa.int64())])


def write_packed(encoded: DataFrame, files: Files, end: int, key: str = "doc_id", ids: str = "ids", row: int = ROW, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Pack rows of (key, ids as little-endian unsigned 16-bit integers) and write the shards' files; returns their names, a row a shard.

    A document gets the end mark, so a null or empty one is an end mark alone. A null key
    is marked as such. Repeated rows are packed as often as they occur. Each task packs its own rows; the manifest is written before
    it is returned, so files and names stay together if a task runs again later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            shard = pack(keys, docs, end, row)
            names = [files.write(".npy", _file({a: shard[a] for a in arrays}), by_content=True) for arrays in FILES.values()]
            out = table(_MANIFEST, *([n] for n in names), [len(shard["ids"])], [held])
            keys.clear(), docs.clear()
            return out

        for batch in batches:
            for part, packed in steps([batch], ids):
                for own, data in zip(part.column(0).to_pylist(), packed, strict=True):
                    docs.append(np.append(np.frombuffer(data, dtype="<u2"), np.uint16(end)))
                    keys.append(own)
                    held += len(docs[-1])
                    if held >= shard_ids:
                        yield flush()
                        held = 0
        if docs:
            yield flush()

    columns = ", ".join(f"{n} string" for n in FILES)
    return written(keyed(encoded, key, ids).mapInArrow(run, f"{columns}, rows long, n_ids long"), "shards")


def read_packed(manifest: DataFrame, files: Files) -> DataFrame:
    """The rows of all shards: shard (its file of ids), row, ids (binary), cu_seqlens, doc_ids, offsets in the documents, and position resets. A task reads one shard."""
    schema = pa.schema([("shard", pa.string()), ("row", pa.int64()), ("ids", pa.binary()), *((n, pa.list_(pa.int64())) for n in ("cu_seqlens", "doc_ids", "offsets", "resets"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                a: dict[str, np.ndarray] = {}
                for name, arrays in FILES.items():
                    a |= _arrays(files.read(shard[name]), arrays)
                matrix, first = a["ids"], a["row_first"]
                # Row r has one entry of segments less than of lengths.
                begin = first - np.arange(len(first))
                for k in range(0, len(matrix), 500):
                    rows = range(k, min(k + 500, len(matrix)))
                    yield table(
                        schema, [shard["ids_file"]] * len(rows), list(rows), [matrix[r].tobytes() for r in rows], [a["cu_seqlens"][first[r] : first[r + 1]].tolist() for r in rows],
                        [[d if k else None for d, k in zip(*(a[n][begin[r] : begin[r + 1]].tolist() for n in ("doc", "known")), strict=True)] for r in rows],
                        *([a[n][begin[r] : begin[r + 1]].tolist() for r in rows] for n in ("offset", "reset")),
                    )

    return spread(manifest).mapInArrow(run, "shard string, row long, ids binary, cu_seqlens array<long>, doc_ids array<long>, offsets array<long>, resets array<long>")


_encodings: dict[str, object] = {}


def encode_text(encoding, text: str, split: bool = True) -> list[int]:
    """The ids of a text, as ``encode_ordinary`` gives them where it can: on long runs of white space the pattern's search overflows its stack.

    So with ``split`` such a run goes around the pattern, which must end in the usual
    rule: all of a run is one piece, but for its last character if other text follows.
    """
    ids, at = [], 0
    for run in _LONG.finditer(text) if split else ():
        stop = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : stop])
        at = stop
    ids += encoding.encode_ordinary(text[at:])
    return ids


def encode_bytes(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (binary, little-endian unsigned 16-bit) of whole texts, by a byte-level vocabulary of at most 65,536 ids in the form of ranks; no special tokens.

    Null and empty texts have no ids. Repeated rows give repeated rows; other columns aren't read.
    """
    schema = pa.schema([(key, pa.int64()), ("ids", pa.binary())])
    split = pattern.endswith(_SPACE_RULE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        name = hashlib.sha256(ranks + pattern.encode()).hexdigest()
        if name not in _encodings:
            _encodings.clear()
            _encodings[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}, special_tokens={})
        for part, texts in steps(batches, text):
            yield table(schema, part.column(0), [np.array(encode_text(_encodings[name], x.decode(), split), dtype="<u2").tobytes() for x in texts])

    return keyed(docs, key, text).mapInArrow(run, f"{key} long, ids binary")
