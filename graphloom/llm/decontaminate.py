"""Benchmark decontamination: find test items inside documents, up to some edits.

Documents and items are compared as lower-cased words joined by one space. An item of L
bytes may differ in k = floor(rate * L) edits. Cut it into k + 1 pieces: some piece is
untouched, so an Aho-Corasick automaton over all pieces finds every place to look at. A
hit is first verified on a group of neighbouring pieces of 64 bytes at most: as k edits
can't put as many edits as it has pieces into every group, one group with s pieces has
at most s - 1 edits. That distance is computed for all hits of a step at once by Myers'
bit-parallel recursion, one machine word a hit. Only what remains is verified against the
whole item, with the same recursion on long integers. No filter loses a match.

An item of fewer than LEAST_BYTES bytes is no evidence, as ordinary text holds it by chance:
it is found too, as whole words without edits, but listed apart and never drops a text.

Items travel to the tasks in blocks of bounded size, each block with a pass of its own
over the documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, steps, table

#: Share of an item's bytes that may be edited.
RATE = 0.10
#: An item of fewer bytes is listed apart.
LEAST_BYTES = 40
#: Bytes of items that one pass searches for.
BLOCK_BYTES = 2 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


def normal(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode().lower().encode()
    return b" ".join(text.translate(_FOLD).split())


def distance_within(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """The least edit distance of the pattern to a substring of the text and the end of the first such substring, if it is at most ``most``."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, most + 1, -1
    for i, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | down
        across = ((equal & up) + up ^ up) | equal
        plus = down | full & ~(across | up)
        minus = up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | full & ~(vertical | plus), plus & vertical
    return (best, at) if best <= most else None


@dataclass(frozen=True)
class Group:
    """Neighbouring pieces of an item: at most pieces - 1 edits are looked for."""

    item: int
    offset: int
    data: bytes
    budget: int


class Finder:
    """Items as an automaton of pieces, groups of pieces and whole patterns."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE, least: int = LEAST_BYTES):
        short: dict[bytes, list[int]] = defaultdict(list)
        for i, p in items:
            if len(p) < least:
                short[p].append(i)
        self.short = ahocorasick.Automaton()
        for p, ids in short.items():
            self.short.add_word(f" {p.decode('latin-1')} ", ids)
        if short:
            self.short.make_automaton()
        items = [(i, p) for i, p in items if len(p) >= least]
        self.ids = [i for i, _ in items]
        self.patterns = [p for _, p in items]
        self.budgets = [int(rate * len(p)) for p in self.patterns]
        self.groups: list[Group] = []
        places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # piece: (group, offset in the group)
        for item, (pattern, k) in enumerate(zip(self.patterns, self.budgets, strict=True)):
            edge = [len(pattern) * j // (k + 1) for j in range(k + 2)]
            first = 0
            while first <= k:
                last = first + 1
                while last <= k and edge[last + 1] - edge[first] <= 64:
                    last += 1
                for j in range(first, last):
                    places[pattern[edge[j] : edge[j + 1]]].append((len(self.groups), edge[j] - edge[first]))
                self.groups.append(Group(item, edge[first], pattern[edge[first] : min(edge[last], edge[first] + 64)], last - first - 1))
                first = last
        self.automaton = ahocorasick.Automaton()
        self.first, of_group, of_offset, sizes = [], [], [], []
        for n, (piece, where) in enumerate(places.items()):
            self.automaton.add_word(piece.decode("latin-1"), n)
            self.first.append(len(of_group))
            sizes.append(len(piece))
            of_group += [g for g, _ in where]
            of_offset += [o for _, o in where]
        if places:
            self.automaton.make_automaton()
        self.first = np.array([*self.first, len(of_group)])
        self.of_group, self.of_offset, self.sizes = np.array(of_group), np.array(of_offset), np.array(sizes)
        self.masks = np.zeros((len(self.groups), 256), dtype=np.uint64)
        for g, group in enumerate(self.groups):
            for i, c in enumerate(group.data):
                self.masks[g, c] |= np.uint64(1 << i)
        self.lengths = np.array([len(g.data) for g in self.groups], dtype=np.int64)
        self.allowed = np.array([g.budget for g in self.groups], dtype=np.int64)
        self.pad = 160 + max(map(len, self.patterns), default=0) + max(self.budgets, default=0)

    def _groups_hold(self, data: np.ndarray, group: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Is the group's distance to a substring about its anchor within its budget?"""
        length, allowed = self.lengths[group], self.allowed[group]
        one = np.uint64(1)
        top = (length - 1).astype(np.uint64)
        up, down = np.full(len(group), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(len(group), dtype=np.uint64)
        score, best = length.copy(), length.copy()
        for t in range(int((length + 2 * allowed).max())):
            equal = self.masks[group, data[anchor - allowed + t]]
            vertical = equal | down
            across = ((equal & up) + up ^ up) | equal
            plus, minus = down | ~(across | up), up & across
            score += (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64)
            np.minimum(best, score, out=best)
            plus, minus = plus << one, minus << one
            up, down = minus | ~(vertical | plus), plus & vertical
        return best <= allowed

    def find_short(self, texts: list[bytes]) -> list[list[int]]:
        """The short items that each normal text holds as whole words."""
        if not len(self.short):
            return [[] for _ in texts]
        return [sorted({i for _, ids in self.short.iter(f" {x.decode('latin-1')} ") for i in ids}) for x in texts]

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each normal text its items: (item id, edits, first word, past the last word), one entry an item, its closest and earliest match."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.ids or not any(texts):
            return out
        gap = b"\0" * self.pad
        joined = gap + gap.join(texts) + gap
        begins = np.cumsum([self.pad, *(len(x) + self.pad for x in texts)])
        data = np.frombuffer(joined, dtype=np.uint8)
        hits = np.fromiter((v for hit in self.automaton.iter(joined.decode("latin-1")) for v in hit), dtype=np.int64).reshape(-1, 2)
        if not len(hits):
            return out
        end, piece = hits[:, 0], hits[:, 1]
        many = self.first[piece + 1] - self.first[piece]
        place = np.repeat(self.first[piece] - np.cumsum(many) + many, many) + np.arange(many.sum())
        group = self.of_group[place]
        anchor = np.repeat(end + 1 - self.sizes[piece], many) - self.of_offset[place]
        # An item that lost bytes at a text's very start has its anchor in the gap before: the text is that of the piece.
        own = np.repeat(begins.searchsorted(end, side="right") - 1, many)
        group, anchor, own = np.unique(np.stack((group, anchor, own)), axis=1)
        held = np.concatenate([self._groups_hold(data, group[k : k + 20_000], anchor[k : k + 20_000]) for k in range(0, len(group), 20_000)])
        spots = sorted({(t, self.groups[g].item, a - self.groups[g].offset) for g, a, t in zip(group[held].tolist(), anchor[held].tolist(), own[held].tolist(), strict=True)})
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        k = 0
        while k < len(spots):
            text, item, low = spots[k]
            budget, pattern = self.budgets[item], self.patterns[item]
            high = low
            while k < len(spots) and spots[k][:2] == (text, item) and spots[k][2] <= high + len(pattern):
                high = spots[k][2]
                k += 1
            begin = int(begins[text])
            low, high = max(begin, low - budget), min(begin + len(texts[text]), high + len(pattern) + budget)
            window = joined[low:high]
            if (found := distance_within(pattern, window, budget)) is None:
                continue
            edits, stop = found
            back = distance_within(pattern[::-1], window[:stop][::-1], budget)
            start = low + stop - (back[1] if back else stop)
            entry = (edits, start - begin, low + stop - begin)
            best[text, item] = min(entry, best.get((text, item), entry))
        for (text, item), (edits, start, stop) in sorted(best.items()):
            own = texts[text]
            out[text].append((self.ids[item], edits, own.count(b" ", 0, start), own.count(b" ", 0, stop) + 1))
        return [sorted(x) for x in out]


def blocks_of_items(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items, in normal form and not empty, as the driver holds them: at most about ``block_bytes`` at a time."""
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        found = sorted({(r.i, normal(r.t.encode())) for r in own.collect()})
        yield [(i, p) for i, p in found if p]


def find_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key``, ``item_ids``, ``edits``, ``first_words`` and ``last_words`` (arrays that correspond) of every row, and ``short_ids``.

    Words count from 0 in the normal text; the last one is past the match. Null and empty
    texts hold no item. Items under ``least`` bytes are listed in short_ids alone, if the
    text holds them as whole words. Null items, and items without a letter or digit, are
    never found; items with equal texts are all reported. Without items every list is
    empty. If the items need several passes, rows of one key share what is found in any.
    """
    names = ("item_ids", "edits", "first_words", "last_words")
    names_short = (*names, "short_ids")
    schema = pa.schema([(key, pa.int64()), *((n, pa.list_(pa.int64())) for n in names_short)])
    columns = ", ".join(f"{n} array<long>" for n in names_short)
    plain = keyed(docs, key, text)

    def search(items: list[tuple[int, bytes]]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, rate, least)
            for part, texts in steps(batches, text, 2 << 20):
                texts = [normal(x) for x in texts]
                found = finder.find(texts)
                yield table(schema, part.column(0), *([[m[k] for m in own] for own in found] for k in range(4)), finder.find_short(texts))

        return plain.mapInArrow(run, f"{key} long, {columns}")

    parts = [search(items) for items in blocks_of_items(benchmark, item, item_text, block_bytes)]
    if not parts:
        return plain.select(key, *(F.array().cast("array<long>").alias(n) for n in names_short))
    if len(parts) == 1:
        return parts[0]
    # Rows of one key share their items here: each pass found those of its own block.
    zipped = [p.select(key, F.arrays_zip(*names).alias("m"), "short_ids").where((F.size("m") > 0) | (F.size("short_ids") > 0)) for p in parts]
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    hits = reduce(DataFrame.union, zipped).groupBy(F.col(key).alias("k")).agg(every("m").alias("m"), every("short_ids").alias("short_ids"))
    joined = plain.select(key).join(hits, F.col(key).eqNullSafe(F.col("k")), "left")
    return joined.select(key, *(F.coalesce(F.col(c), F.array().cast("array<long>")).alias(n) for n, c in [*((n, f"m.{n}") for n in names), ("short_ids", "short_ids")]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, least: int = LEAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all their columns, whose text holds no item of ``least`` bytes or more. Null and empty texts hold none; repeated rows share one fate."""
    for items in blocks_of_items(benchmark, "item_id", "text", block_bytes):
        docs = _without(docs, [(i, p) for i, p in items if len(p) >= least], text, rate, least)
    return docs


def _without(docs: DataFrame, items: list[tuple[int, bytes]], text: str, rate: float, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, rate, least)
        for part, texts in steps(batches, text, 2 << 20):
            yield part.filter(pa.array([not x for x in finder.find([normal(x) for x in texts])], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
