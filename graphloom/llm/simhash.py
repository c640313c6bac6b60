"""SimHash near-duplicates, compared in bit slices.

A fingerprint's 64 bits are the majorities of the hashes of a text's word shingles. Two
fingerprints link if they differ in at most ``radius`` bits. Distinct fingerprints are cut
into bit blocks; two that link agree on all but ``radius`` of the blocks, so each is filed
under the value of every choice of the other blocks, and only what is filed together is
compared. The number of blocks follows from the number of distinct fingerprints, so that
a key's list stays short at any size; a key with many fingerprints is dealt out by tiles
(``components_of_lists``).

A list is compared in bit slices: plane k holds bit k of 64 fingerprints a machine word.
For a query, the planes that disagree are added to 64 counters at once with carry-save
logic (ones, twos, and a flag for four or more), and a block of 64 is abandoned once all
of its counters exceed the radius. Links found in a task are reduced to a spanning forest
before they leave it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small, steps, table, written
from .components import Forest, components_of_lists

RADIUS = 3
SHINGLE = 3
#: Fingerprints of one key that a task compares; larger keys are dealt out by tiles of half of that.
LIST = 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], size: int) -> Iterator[int]:
    """XXH64 of each run of ``size`` words; fewer words are one run, no words none."""
    if not words:
        return iter(())
    runs = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return map(xxhash.xxh64_intdigest, runs, itertools.repeat(42))


def bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each slice of the hashes that begins at ``starts``."""
    bits = np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def majorities(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprints whose bits are those set in over half of the hashes."""
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[bytes], size: int = SHINGLE, chunk: int = 1 << 18) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers; a text without words has zero. Of a long text ``chunk`` hashes are held at a time."""
    out, full = np.zeros(len(texts), dtype=np.uint64), []
    held, starts, counts, sums = [], [], [], []

    def settle() -> None:
        if starts:
            sums.append(bit_sums(np.array(held, dtype=np.uint64), np.array(starts)))
        held.clear(), starts.clear()

    for i, x in enumerate(texts):
        words = x.lower().split()
        if not words:
            continue
        full.append(i)
        counts.append(max(1, len(words) - size + 1))
        hashes = shingle_hashes(words, size)
        if len(held) + counts[-1] > chunk:
            settle()
        if counts[-1] <= chunk:
            starts.append(len(held))
            held.extend(hashes)
            continue
        total = np.zeros((1, 64), dtype=np.int64)
        while block := list(itertools.islice(hashes, chunk)):
            total += bit_sums(np.array(block, dtype=np.uint64), np.zeros(1, dtype=np.int64))
        sums.append(total)
    settle()
    if full:
        out[full] = majorities(np.concatenate(sums), np.array(counts, dtype=np.int64))
    return out


class Slices:
    """Fingerprints in bit slices, for one query at a time and any radius under 64.

    Plane k of a block holds bit k of its fingerprints, one a lane of a long integer. The
    planes that disagree with the query go through counters by carry-save addition, all
    lanes at once; a block is abandoned once every lane that is asked for exceeds the radius.
    """

    LANES = 1024

    def __init__(self, values: np.ndarray):
        bits = np.unpackbits(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.blocks = []
        for first in range(0, len(values), self.LANES):
            packed = np.packbits(bits[first : first + self.LANES], axis=0, bitorder="little")
            self.blocks.append([int.from_bytes(packed[:, k].tobytes(), "little") for k in range(64)])
        #: For each block the lanes that are asked for.
        self.open = [(1 << min(self.LANES, len(values) - first)) - 1 for first in range(0, len(values), self.LANES)]

    def close(self, place: int) -> None:
        self.open[place // self.LANES] &= ~(1 << place % self.LANES)

    def within(self, value: int, radius: int) -> list[int]:
        """Places, in order, of the open fingerprints that differ from the value in at most ``radius`` bits."""
        found = []
        for b, (planes, lanes) in enumerate(zip(self.blocks, self.open, strict=True)):
            counters, over = [0] * max(1, radius.bit_length()), 0
            beyond = 0
            for k, plane in enumerate(planes):
                if beyond == lanes:
                    break
                carry = (plane ^ lanes if value >> k & 1 else plane) & lanes
                for j, held in enumerate(counters):
                    counters[j], carry = held ^ carry, held & carry
                    if not carry:
                        break
                over |= carry
                if k & 7 == 7:
                    beyond = over | _above(counters, radius, lanes)
            left = lanes & ~beyond
            while left:
                low = left & -left
                found.append(b * self.LANES + low.bit_length() - 1)
                left ^= low
        return found


def _above(counters: list[int], radius: int, lanes: int) -> int:
    """Lanes whose counter is above the radius."""
    above, equal = 0, lanes
    for j in range(len(counters) - 1, -1, -1):
        if radius >> j & 1:
            equal &= counters[j]
        else:
            above |= equal & counters[j]
            equal &= ~counters[j]
    return above


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's bits as a long) of every whole text; null and empty texts have zero."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            yield table(schema, part.column(0), fingerprints_of(texts).view(np.int64))

    return keyed(docs, key, text).mapInArrow(run, f"{key} long, fp long")


def blocks_for(distinct: int, radius: int = RADIUS) -> int:
    """The fewest blocks with which a random key files at most 64 of so many fingerprints."""
    return next((m for m in range(radius + 1, 65) if distinct <= 64 << (64 * (m - radius) // m)), 64)


def _keys(blocks: int, radius: int) -> list[int]:
    """A mask of the bits of each choice of blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) - (1 << 64) * (sum(c) >> 63) for c in itertools.combinations(mask, blocks - radius)]


def near(values: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> Forest:
    """Links among values; value i is compared with those from start[i] to stop[i] at least. Any link that is met counts.

    The values of a list stand together: start and stop are its borders.
    """
    n = len(values)
    forest = Forest(n)
    bits = np.zeros((-(-n // 64) * 64, 64), dtype=np.uint8)
    bits[:n] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
    own = np.arange(n)
    last = (stop - 1) // 64
    # A query meets its own block and the later ones of its list: each pair is met from its earlier side.
    meets = last - own // 64 + 1
    meets[stop - start < 2] = 0
    ends = np.cumsum(meets)
    for first in range(0, int(ends[-1]) if n else 0, chunk):
        at = np.arange(first, min(first + chunk, int(ends[-1])))
        query = np.searchsorted(ends, at, side="right")
        block = query // 64 + at - (ends[query] - meets[query])
        ones, twos, over = (np.zeros(len(at), dtype=np.uint64) for _ in range(3))
        for k in range(64):
            flip = np.uint64(0) - ((values[query] >> np.uint64(k)) & np.uint64(1))
            differ = planes[k][block] ^ flip
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if k % 4 == 3:
                alive = (over != _ALL) if radius == 3 else (_exceeds(ones, twos, over, radius) != _ALL)
                if not alive.all():
                    query, block, ones, twos, over = query[alive], block[alive], ones[alive], twos[alive], over[alive]
        hit = ~_exceeds(ones, twos, over, radius)
        row, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = query[row], block[row] * 64 + lane
        keep = (b < n) & (a != b)
        forest.link(a[keep], b[keep])
    return forest


def _exceeds(ones: np.ndarray, twos: np.ndarray, over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above a radius of 0 to 3."""
    return over | (ones | twos, twos, ones & twos, np.uint64(0))[radius]


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list, then value: links of each value to the smallest of its set in the lists at hand."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(lists: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]).any(axis=1), [True])))
        sizes = np.diff(edge)
        forest = near(values.view(np.uint64), np.repeat(edge[:-1], sizes), np.repeat(edge[1:], sizes), radius)
        tied = forest.root != np.arange(len(values))
        return table(schema, values[tied], values[forest.root[tied]])

    held_lists, held = np.empty((0, 3), dtype=np.int64), np.empty(0, dtype=np.int64)
    for batch in batches:
        lists = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        held_lists, held = np.concatenate((held_lists, lists)), np.concatenate((held, batch.column(3).to_numpy()))
        if len(held) < 4 * LIST:
            continue
        same = (held_lists == held_lists[-1]).all(axis=1)
        whole = len(held) - int(same[::-1].argmin()) if not same.all() else 0
        if whole:
            yield linked(held_lists[:whole], held[:whole])
            held_lists, held = held_lists[whole:], held[whole:]
    if len(held):
        yield linked(held_lists, held)


def linked_fingerprints(distinct: DataFrame, n: int, radius: int = RADIUS, most: int = LIST) -> DataFrame:
    """Components of all distinct fingerprints (column fp, n rows) over distances up to radius, as ``components`` gives them."""
    masks = _keys(blocks_for(n, radius), radius)
    choices = F.array(*(F.struct(F.lit(k).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    filed = distinct.select("fp", F.explode(choices).alias("f")).select("f.choice", "f.key", "fp")
    return components_of_lists(filed, ["choice", "key"], "fp", F.lit(1), most, lambda lists: lists.mapInArrow(lambda batches: _compare(batches, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, ``fp`` and ``component_id``, the smallest key reachable over links, for every row.

    Rows of one key and equal texts share a component, as do all texts without words
    (fingerprint zero). A null key is no candidate for component_id, which is null only
    if every key that is reachable is. Columns besides key and text are not read.
    """
    marked = written(fingerprint(docs, key, text), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    roots = linked_fingerprints(distinct.select("fp"), distinct.count(), radius)
    rooted = distinct.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, of the document with the smallest key of each component; see ``keep_first``."""
    return keep_first(docs, near_duplicates(docs, key, text, radius), key)


def keep_first(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, of the documents that name their component (``key`` and component_id in ``found``).

    Of repeated rows of one key one stays. Rows without a key can't be named by a
    component and stay. The keys to drop are broadcast if they are few, which spares the
    texts a shuffle; else the join shuffles both sides.
    """
    found = written(found, "classes")
    drop = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    again = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)

    kept = docs.join(small(written(drop, "drop")), key, "left_anti").select(*docs.columns)
    again = written(again, "again")
    if again.isEmpty():
        return kept
    again = small(again)
    once = kept.join(again, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return kept.join(again, key, "left_anti").select(*docs.columns).union(once)
