"""Near-copies by SimHash: texts whose sets of word shingles have a Jaccard similarity of at least ``least``.

A fingerprint's 64 bits are the majorities of the hashes of a text's distinct shingles.
Texts of that similarity differ in about 10 bits at 0.8 and 5 words; ``radius_for`` adds
five standard deviations. At so wide a radius no choice of bit blocks narrows the search,
so lists of fingerprints to compare come from HASHES MinHash values, filed in BANDS bands
of ROWS values: two texts of similarity s share a bucket with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9996 at 0.8. Equal texts are one class, named by their
hash. Each member of a bucket is tied to the bucket's smallest, so a bucket costs as many
rows as it has members, and what is tied together is a list.

A list is compared in bit slices (``Slices``): a search that goes from text to text asks
for the open fingerprints within the radius, and what it finds is verified by the exact
sets of shingles. What it has reached is closed, so copies of one text are met once. A
list of many bytes is dealt out by tiles (``components_of_lists``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, small, steps, table, written
from .components import components, components_of_lists
from .simhash import Slices, bit_sums, keep_first, majorities, shingle_hashes

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
HASHES = BANDS * ROWS
#: Bytes of shingles of one cluster that a task compares; larger clusters are dealt out by tiles of half of that.
LIST_BYTES = 8 << 20
_SEEDS = np.random.default_rng(0x0C0B1E5).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)


def radius_for(least: float) -> int:
    """Bits in which texts of that similarity differ at most, but for one pair in millions: sets of equal size have a cosine of 2 s / (1 + s), others a larger one."""
    share = math.acos(2 * least / (1 + least)) / math.pi
    return min(63, math.ceil(64 * share + 5 * math.sqrt(64 * share * (1 - share))))


def shingles_of(text: bytes, size: int = SHINGLE) -> list[int]:
    """Hashes of the runs of ``size`` lower-cased words; a shorter text is one run, and so is a text without words."""
    words = text.lower().split()
    return list(shingle_hashes(words, size)) if words else [xxhash.xxh64_intdigest(b"", 42)]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set of hashes, none of which is empty."""
    if not sets:
        return np.zeros(0, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = []
    first, held = 0, np.cumsum(sizes)
    while first < len(sets):  # about 1 << 18 hashes at a time
        last = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + (1 << 18), side="right")))
        out.append(majorities(bit_sums(np.concatenate(sets[first:last]), np.cumsum(sizes[first:last]) - sizes[first:last]), sizes[first:last]))
        first = last
    return np.concatenate(out)


def buckets_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The bucket of each text in each band, as longs; buckets of different bands differ."""
    hashes, counts = [], []
    for x in texts:
        found = shingles_of(x, size)
        hashes += found
        counts.append(len(found))
    values, starts = np.array(hashes, dtype=np.uint64), np.cumsum([0, *counts[:-1]])
    out = np.zeros((len(texts), BANDS), dtype=np.uint64)
    for k in range(HASHES):
        least = np.minimum.reduceat(((values ^ _SEEDS[0, k]) * _SEEDS[1, k]) >> np.uint64(32), starts)
        band = out[:, k // ROWS]
        band[:] = (band ^ least ^ np.uint64(k << 32)) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(29)
    return out.view(np.int64)


def linked(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """For each set of distinct values the first one of its component, over all links of at least that similarity."""
    n, radius = len(sets), radius_for(least)
    root, sizes = np.arange(n), np.array([len(s) for s in sets], dtype=np.int64)
    prints = fingerprints(sets)
    slices, values = Slices(prints), prints.tolist()
    index = _Index(sets, sizes)
    for start in range(n):
        if root[start] != start:
            continue
        slices.close(start)
        queue = [start]
        while queue:
            q = queue.pop()
            near = np.array(slices.within(values[q], radius), dtype=np.int64)
            if not near.size:
                continue
            shared = index.shared(q, near)
            for i in near[shared >= least * (sizes[near] + sizes[q] - shared) - 1e-9].tolist():
                slices.close(i)
                root[i] = start
                queue.append(i)
    return root


class _Index:
    """How many values sets share: few sets are held against each other, many through an inverted index of those still asked for."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        self.values, self.owner, self.held = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.zeros(len(sets), dtype=bool)
        self.asked = 0

    def shared(self, q: int, near: np.ndarray) -> np.ndarray:
        own = self.sets[q]
        if near.size <= 16:
            return np.array([np.intersect1d(own, self.sets[i], assume_unique=True).size for i in near], dtype=np.int64)
        if not self.held[near].all() or 2 * near.size < self.held.sum() and self.asked > 16:
            self.held[:] = False
            self.held[near] = True
            self.values, self.owner, self.asked = np.concatenate([self.sets[i] for i in near]), np.repeat(near, self.sizes[near]), 0
            by = np.argsort(self.values, kind="stable")
            self.values, self.owner = self.values[by], self.owner[by]
        self.asked += 1
        low, high = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        many = high - low
        place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        return np.bincount(self.owner[place], minlength=len(self.sets))[near]


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cluster and tile: links of each text to the first of its component in the list at hand."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    at, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        root, names = linked(sets, least), np.array(ids, dtype=np.int64)
        tied = root != np.arange(len(names))
        return table(schema, names[tied], names[root[tied]])

    for batch in batches:
        for cluster, tile, h, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if at != (cluster, tile):
                if len(ids) > 1:
                    yield done()
                at, ids, sets = (cluster, tile), [], []
            ids.append(h)
            sets.append(np.frombuffer(data, dtype=np.uint64))
    if len(ids) > 1:
        yield done()


def _candidates(classes: DataFrame) -> DataFrame:
    """``h`` and ``cluster`` of the classes that share a bucket with others, directly or by steps."""
    filed = classes.select("h", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.min("h").alias("b"), F.max("h").alias("last")).where("b < last").select("bucket", "b")
    tied = components(filed.join(shared, "bucket").where("h > b").select(F.col("h").alias("a"), "b").distinct())
    return tied.select(F.col("a").alias("h"), F.col("b").alias("cluster")).union(tied.select("b", "b").distinct())


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST, list_bytes: int = LIST_BYTES) -> DataFrame:
    """``key`` and ``component_id``, the smallest key reachable over links, for every row.

    Rows of equal texts share a component, as do all texts without words. A null key is
    no candidate for component_id, which is null only if every key that is reachable
    is. Columns besides key and text are not read.
    """
    class_of = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    schema = pa.schema([(key, pa.int64()), ("h", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            found = buckets_of(texts, size)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS), type=pa.int32()), pa.array(found.ravel()))
            yield table(schema, part.column(0), part.column(1), flat)

    marked = written(keyed(docs.withColumn("_h", class_of), key, "_h", text).mapInArrow(file, f"{key} long, h long, buckets array<long>"), "buckets")
    classes = written(marked.groupBy("h").agg(F.min(key).alias("least"), F.first("buckets").alias("buckets")), "classes")
    clusters = small(written(_candidates(classes), "clusters"))  # while it is, no text without a candidate is shuffled
    sets_schema = pa.schema([("cluster", pa.int64()), ("h", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            yield table(sets_schema, part.column(0), part.column(1), [np.unique(np.array(shingles_of(x, size), dtype=np.uint64)).tobytes() for x in texts])

    once = docs.select(class_of.alias("h"), F.col(text)).join(clusters, "h").dropDuplicates(["h"]).select("cluster", "h", text)
    shingled = written(once.mapInArrow(sets, "cluster long, h long, shingles binary"), "shingles")
    compare = lambda lists: lists.mapInArrow(lambda batches: _links(batches, least), "a long, b long")
    roots = components_of_lists(shingled, ["cluster"], "h", F.octet_length("shingles"), list_bytes, compare)
    rooted = classes.select("h", "least").join(roots.select(F.col("a").alias("h"), F.col("b").alias("root")), "h", "left").select("h", F.coalesce("root", "h").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("h", "root").join(smallest, "root").select("h", "component_id")
    return marked.select(key, "h").join(named, "h").select(key, "component_id")


def keep_one_near_copy(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, of the document with the smallest key of each component; see ``keep_first``."""
    return keep_first(docs, near_copies(docs, key, text, size, least), key)
