"""Language-model scores by prediction by partial matching (PPM) over bytes.

The trie holds, for each context of up to ``ORDER`` symbols, how often each symbol
followed it in the training texts. A symbol is coded in the longest known context: by its
share there (escape method D: with D distinct symbols in T, a count of n gives
(2 n - 1) / 2 T, and D / 2 T remains for the escape), or by an escape and its code in the next shorter context, where the
symbols of the longer one are excluded. The symbols of a context are among those of
every shorter one, so what is excluded depends on the last context alone, and each context's
reduced totals are computed once. Below the empty context all other symbols are equal.

Codes are found for a whole step of texts at a time: a symbol's code length depends on
the (ORDER + 1)-gram that ends there, which is looked up in a direct-mapped cache of the
task; only grams that it doesn't hold walk the trie, all at once. A trie of many grams is cut
into blocks by the last two symbols of the context; a task then takes the distinct grams of
a larger step of texts through one block after the other.

Word counts stand beside the trie for the baseline by unigrams. The most frequent words
are broadcast, in bounded number and length; the other words of a text are joined with
the counts by Spark.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Files, new_folder, steps, table, written

ORDER = 5
#: Bits of a symbol: bytes 0 to 255, the end of a text, the start of a text (in contexts only).
BITS, END, START = 9, 256, 257
SYMBOLS = 257
#: Grams of the highest order in one block of the trie; more of them make more blocks.
BLOCK_GRAMS = 1_500_000
#: Bytes of text that a task scores with one block after the other.
_BLOCK_STEP = 16 << 20
#: Words that are broadcast at most, and the longest of them.
HEAD_WORDS, HEAD_BYTES = 200_000, 64
_CACHE = 1 << 20
#: What a task holds before it passes counts on, and the bytes of text that it has as arrays at a time.
_HELD_WORDS, _HELD_GRAMS, _STEP = 200_000, 1_000_000, 1 << 20
END_WORD = b"\n"  # no word holds white space


def grams_of(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte and at the end of each text, and the number of grams of each text."""
    sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    starts = np.cumsum(sizes + order) - sizes
    symbols = np.full(int((sizes + order).sum()), START, dtype=np.int64)
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    own = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8).astype(np.int64)
    own[np.cumsum(sizes) - 1] = END
    symbols[place] = own
    code = np.zeros(len(place), dtype=np.int64)
    for k in range(order, -1, -1):
        code = code << BITS | symbols[place - k]
    return code, sizes


def parts_of(texts: list[bytes], order: int = ORDER, limit: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What grams_of gives, about ``limit`` bytes at a time: the first text of a part, its grams, and their number for it and each text after it. A longer text is cut into several parts."""
    limit = limit or _STEP
    first, size = 0, 0
    for i, x in enumerate(texts):
        if first < i and size + len(x) > limit:
            yield first, *grams_of(texts[first:i], order)
            first, size = i, 0
        if len(x) <= limit:
            size += len(x) + 1
            continue
        first = i + 1
        for a in range(0, len(x) + 1, limit):
            b, begin = min(a + limit, len(x) + 1), max(0, a - order)
            known = np.frombuffer(x, dtype=np.uint8, offset=begin, count=min(b, len(x)) - begin)
            symbols = np.concatenate((np.full(order - (a - begin), START), known, [END] if b > len(x) else [])).astype(np.int64)
            code = np.zeros(b - a, dtype=np.int64)
            for k in range(order, -1, -1):
                code = code << BITS | symbols[order - k : order - k + b - a]
            yield i, code, np.array([b - a])
    if first < len(texts):
        yield first, *grams_of(texts[first:], order)


@dataclass(frozen=True)
class Trie:
    """For each order the sorted grams and their log10 probabilities, the sorted contexts and their log10 escapes, alone and after an escape from a longer context."""

    grams: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    total: tuple[np.ndarray, ...]
    distinct: tuple[np.ndarray, ...]
    #: For each context: the count of its symbols in the next shorter context.
    excluded: tuple[np.ndarray, ...]

    @staticmethod
    def of(tables: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
        """From the grams and counts of each order, shortest first; the grams of an order are among the suffixes of those of the next."""
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for j, (grams, counts) in enumerate(tables):
            order = np.argsort(grams)
            grams, counts = grams[order], counts[order].astype(np.int64)
            contexts, first = np.unique(grams >> BITS, return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, dtype=np.int64)
            distinct = np.diff(np.append(first, len(grams)))
            excluded = np.zeros(len(contexts), dtype=np.int64)
            if j and len(first):
                at = np.searchsorted(parts[0][-1], grams & ((1 << BITS * j) - 1))
                excluded = np.add.reduceat(parts[1][-1][at], first)
            for own, value in zip(parts, (grams, counts, contexts, total, distinct, excluded), strict=True):
                own.append(value)
        return Trie(*(tuple(p) for p in parts))

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last symbol after the others."""
        out, open_ = np.zeros(len(code)), np.arange(len(code))
        less_total, less_distinct = np.zeros(len(code), dtype=np.int64), np.zeros(len(code), dtype=np.int64)
        for j in range(len(self.grams) - 1, -1, -1):
            if not len(self.contexts[j]):
                continue
            gram = code[open_] & ((1 << BITS * (j + 1)) - 1)
            context = gram >> BITS
            at = np.minimum(np.searchsorted(self.contexts[j], context), len(self.contexts[j]) - 1)
            known = self.contexts[j][at] == context
            total = self.total[j][at] - less_total[open_]
            distinct = self.distinct[j][at] - less_distinct[open_]
            place = np.minimum(np.searchsorted(self.grams[j], gram), len(self.grams[j]) - 1)
            found = known & (self.grams[j][place] == gram)
            out[open_[found]] += np.log10((2 * self.counts[j][place[found]] - 1) / (2 * total[found]))
            escaped = known & ~found
            able = escaped & (distinct > 0)
            out[open_[able]] += np.log10(distinct[able] / (2 * total[able]))
            less_total[open_[escaped]], less_distinct[open_[escaped]] = self.excluded[j][at[escaped]], self.distinct[j][at[escaped]]
            open_ = open_[~found]
        # less_distinct now counts the symbols of the empty context, all of which are excluded.
        out[open_] -= np.log10(np.maximum(1, SYMBOLS - less_distinct[open_]))
        return out


class Scorer:
    """A trie with a direct-mapped cache of gram codes."""

    def __init__(self, trie: Trie):
        self.trie = trie
        self.order = len(trie.grams) - 1
        self.keys, self.values = np.full(_CACHE, -1, dtype=np.int64), np.zeros(_CACHE)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        out = np.zeros(len(texts))
        for first, code, sizes in parts_of(texts, self.order):
            slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            value = self.values[slot]
            missed = np.flatnonzero(self.keys[slot] != code)
            if missed.size:
                fresh, back = np.unique(code[missed], return_inverse=True)
                logs = self.trie.logs(fresh)
                value[missed] = logs[back]
                self.keys[slot[missed]], self.values[slot[missed]] = code[missed], value[missed]
            out[first : first + len(sizes)] += np.add.reduceat(value, np.cumsum(sizes) - sizes)
        return out


@dataclass(frozen=True)
class Blocks:
    """A trie in blocks by the last two symbols of the context; a block holds all that its grams need, shorter contexts included."""

    files: Files
    names: tuple[str, ...]
    #: The first pair of symbols of each block.
    starts: np.ndarray
    order: int

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability, its end included; one block is in memory at a time."""
        parts = []
        for first, code, sizes in parts_of(texts, self.order):
            own, back = np.unique(code, return_inverse=True)
            parts.append((first, sizes, own, back.astype(np.int32)))
        codes = np.unique(np.concatenate([own for *_, own, _ in parts]))
        values, block = np.zeros(len(codes)), np.searchsorted(self.starts, _pair(codes), side="right") - 1
        for b in np.unique(block).tolist():
            own = np.flatnonzero(block == b)
            trie = pickle.loads(self.files.read(self.names[b]))
            for k in range(0, len(own), _CACHE):
                values[own[k : k + _CACHE]] = trie.logs(codes[own[k : k + _CACHE]])
            del trie
        out = np.zeros(len(texts))
        for first, sizes, own, back in parts:
            out[first : first + len(sizes)] += np.add.reduceat(values[np.searchsorted(codes, own)][back], np.cumsum(sizes) - sizes)
        return out


def _pair(gram):
    """The last two symbols of a gram's context."""
    return gram >> BITS & ((1 << 2 * BITS) - 1)


def _shorter(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of an order, from those of a higher one."""
    own, back = np.unique(grams & ((1 << BITS * (order + 1)) - 1), return_inverse=True)
    out = np.zeros(len(own), dtype=np.int64)
    np.add.at(out, back, counts)
    return own, out


def _tables(grams: np.ndarray, counts: np.ndarray, order: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of the orders from ``least`` to ``order``, from those of the highest."""
    out = [(grams, counts)]
    for j in range(order - 1, least - 1, -1):
        out.append(_shorter(*out[-1], j))
    return out[::-1]


def _whole(top: DataFrame, order: int, block_grams: int) -> Trie | Blocks:
    """The trie with every gram: one of up to ``block_grams`` grams, else blocks in the shared folder, each built by a task."""
    if order < 2 or top.count() <= block_grams:
        found = top.toArrow()
        return Trie.of(_tables(found["gram"].to_numpy(), found["n"].to_numpy(), order, 0))
    pair = F.shiftright("gram", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    firsts, size = [0], 0
    for key, n in sorted(top.groupBy(pair.alias("pair")).count().collect()):  # a row for each pair of symbols at most
        if size and size + n > block_grams:
            firsts.append(key)
            size = 0
        size += n
    starts = np.array(firsts, dtype=np.int64)
    short = top.groupBy(F.col("gram").bitwiseAND((1 << 2 * BITS) - 1).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    one = (short["gram"].to_numpy(), short["n"].to_numpy())
    files = new_folder(top.sparkSession, "trie")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            own = np.searchsorted(starts, _pair(batch.column(0).to_numpy()), side="right") - 1
            yield table(schema, own.astype(np.int32), *batch.columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish() -> pa.RecordBatch:
            grams, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            block = Trie.of([_shorter(*one, 0), one, *_tables(grams, counts, order, 2)])
            name = files.write(".trie", [pickle.dumps(block, protocol=5)])
            return table(pa.schema([("block", pa.int32()), ("name", pa.string())]), [at], [name])

        at, held = -1, []
        for batch in batches:
            of, grams, counts = (c.to_numpy() for c in batch.columns)
            edge = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edge, edge[1:], strict=False):
                if b > a:
                    if held and of[a] != at:
                        yield finish()
                    at = int(of[a])
                    held.append((grams[a:b].copy(), counts[a:b].copy()))
        if held:
            yield finish()

    dealt = top.mapInArrow(mark, "block int, gram long, n long").repartition(len(starts), "block").sortWithinPartitions("block")
    names = dict(written(dealt.mapInArrow(build, "block int, name string"), "blocks").collect())
    return Blocks(files, tuple(names[b] for b in range(len(starts))), starts, order)


def train(docs: DataFrame, text: str = "text", order: int = ORDER, nodes: int | None = None, block_grams: int | None = None) -> tuple[DataFrame, Trie | Blocks]:
    """Counts of words (word, n) and the trie, from every whole text of ``docs``, in one pass.

    Texts are in lower case (A-Z). Each text ends with an end symbol and an end word. The
    trie holds every gram, in blocks beyond ``block_grams``. Only if ``nodes`` is given, an
    order with more grams than that keeps those above the least sufficient count.
    """
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([grams, *(g for g, _ in pending)])
            n = np.concatenate([counts, *(c for _, c in pending)])
            pending.clear()
            by = np.argsort(every, kind="stable")
            every, n = every[by], n[by]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, dtype=np.int64)
            return every[first], np.add.reduceat(n, first) if len(first) else n

        def word_rows() -> Iterator[pa.RecordBatch]:
            held, counted = list(words), list(words.values())
            words.clear()
            for k in range(0, len(held), 50_000):
                some = held[k : k + 50_000]
                yield table(schema, some, pa.nulls(len(some), pa.int64()), counted[k : k + 50_000])

        for _, texts in steps(batches, text, _STEP):
            texts = [x.lower() for x in texts]
            for x in texts:
                words.update(x.split())
            words[END_WORD] += len(texts)
            for _, code, _ in parts_of(texts, order):
                pending.append(np.unique(code, return_counts=True))
                if sum(len(g) for g, _ in pending) > _HELD_GRAMS:
                    grams, counts = merged()
            if len(words) > _HELD_WORDS:
                yield from word_rows()
            if len(grams) > _HELD_GRAMS:
                yield table(schema, pa.nulls(len(grams), pa.binary()), grams, counts)
                grams, counts = grams[:0], counts[:0]
        grams, counts = merged()
        yield from word_rows()
        yield table(schema, pa.nulls(len(grams), pa.binary()), grams, counts)

    counted = docs.select(text).mapInArrow(count, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "counts")
    top = counted.where("word IS NULL AND gram IS NOT NULL").select("gram", "n")
    counted_words = counted.where("word IS NOT NULL").select("word", "n")
    if nodes is None:
        return counted_words, _whole(top, order, block_grams or BLOCK_GRAMS)
    tables, least = [], 0
    for j in range(order, -1, -1):
        own = top if j == order else top.groupBy(F.col("gram").bitwiseAND((1 << BITS * (j + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
        limit = _least_count(own, nodes)
        # A shorter context keeps what a longer one keeps.
        least = limit if j == order else min(least, limit)
        kept = own.where(F.col("n") >= least).toArrow()
        tables.append(tuple(kept[c].to_numpy() for c in ("gram", "n")))
    return counted_words, Trie.of(tables[::-1])


def _bucket(n: Column) -> Column:
    return F.floor(F.log2(n) * 8).cast("int")


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` rows reach, to an eighth of a power of two; from a histogram of a few hundred rows."""
    if counts.count() <= most:
        return 1
    total = 0
    for bucket, rows in sorted(counts.groupBy(_bucket(F.col("n")).alias("b")).count().collect(), reverse=True):
        total += rows
        if total > most:
            return math.ceil(2 ** ((bucket + 1) / 8) - 1e-9)
    return 1


def score_texts(docs: DataFrame, words: DataFrame, trie: Trie | Blocks, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every whole text.

    base_score sums log10((c + 1) / (N + V + 1)) over words and the end; score is the
    trie's log10 probability of the text and its end. A null text is empty: its end
    alone. Repeated rows are scored alike. ``words`` may be empty (c, N and V are 0).
    """
    spark = docs.sparkSession
    total, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("n")).first())
    short = words.where(F.octet_length("word") <= HEAD_BYTES)
    least = _least_count(short, head_words)
    in_head = (F.octet_length("word") <= HEAD_BYTES) & (F.col("n") >= least)
    head = {bytes(w): n for w, n in words.where(in_head).collect()}
    shared = spark.sparkContext.broadcast(({w: math.log10(n + 1) for w, n in head.items()}, trie))
    schema = pa.schema([("row", pa.int64()), (key, pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_sum", pa.float64()), ("score", pa.float64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        logs, model = shared.value
        scorer, step = (model, _BLOCK_STEP) if isinstance(model, Blocks) else (Scorer(model), _STEP)
        row = TaskContext.get().partitionId() << 40
        for part, texts in steps(batches, text, step):
            texts = [x.lower() for x in texts]
            sizes, known, sums, tails, times = [], [], [], [], []
            for x in texts:
                tokens = x.split()
                tokens.append(END_WORD)
                found = list(map(logs.get, tokens))
                rest: Counter[bytes] = Counter()
                if None in found:
                    rest.update(w for w, v in zip(tokens, found, strict=True) if v is None)
                    found = [v for v in found if v is not None]
                sizes.append(len(tokens))
                known.append(len(found))
                sums.append(math.fsum(found))
                tails.append(list(rest))
                times.append(list(rest.values()))
            yield table(schema, list(range(row, row + len(texts))), part.column(0), sizes, known, sums, scorer.score(texts), tails, times)
            row += len(texts)

    scored = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"row long, {key} long, n_tokens long, head_known long, head_sum double, score double, tail array<binary>, times array<long>")
    scored = written(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    found = rare.join(words.where(~in_head), "word").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_sum"))
    return scored.drop("tail", "times").join(found, "row", "left").select(
        key, "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score",
    )
