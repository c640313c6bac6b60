"""Language identification of whole texts, word by word.

A word's script leaves as candidates the languages that were seen to use it. Its score
for a language is the log probability of its byte n-grams under that language, relative
to the best language. Viterbi's algorithm then labels the words: staying in a language is
free, switching costs a penalty, so a text falls into spans of one language each.

The model is one array of n-gram buckets by language and one of scripts by language: its
size depends on the number of languages only. The counts are over all training texts and
are summed by Spark.

Viterbi's recursion is linear in the max-plus algebra. So texts are cut into blocks of
words, every block's matrix is computed at the same time, the matrices of a text are
chained, and the labels follow from a backward pass over all blocks at once; a very long
text costs no more a word than a short one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, table

# First code point of each range of scripts, and the script's number (0: none in particular).
SCRIPT_STARTS = (0x0000, 0x00C0, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0700, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3190, 0x3400, 0xA000, 0xAC00, 0xD7B0)
SCRIPT_NUMBERS = (1, 1, 0, 2, 3, 0, 4, 5, 0, 6, 0, 7, 0, 8, 0, 1, 2, 0, 9, 0, 8, 0, 10, 0, 8, 0)
SCRIPTS = 11

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
BLOCK = 128
#: Bytes of one text that are held in arrays at a time.
_PIECE = 4 << 20

#: Letters of ASCII in lower case and all bytes of other characters stay, all else parts words.
_FOLD = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 91 else b for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: (BUCKETS + 1, languages): log probabilities, the last row zero.
    grams: np.ndarray
    #: (SCRIPTS, languages): may a word of this script be of this language?
    uses: np.ndarray
    switch_penalty: float = 12.0


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each after one space, as one array of bytes; their places in it; and the number of each text's words."""
    parts = [x.translate(_FOLD).split() for x in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b" " + b" ".join(b" ".join(p) for p in parts if p) + b" " * (1 + max(ORDERS)), dtype=np.uint8)
    space = data[: -max(ORDERS)] == 32
    return data, np.flatnonzero(space)[:-1], counts


def _buckets(data: np.ndarray, n: int) -> np.ndarray:
    """For each position the bucket of the n bytes from there, or BUCKETS if they reach over a word's end."""
    size = len(data) - max(ORDERS)
    code = np.zeros(size, dtype=np.uint32)
    valid = np.ones(size, dtype=bool)
    space = data == 32
    for k in range(n):
        code = (code ^ data[k : k + size]) * np.uint32(0x01000193)
        if 0 < k < n - 1:
            valid &= ~space[k : k + size]
    if n == 1:
        valid &= ~space[:size]
    elif n == 2:
        valid &= ~(space[:size] & space[1 : 1 + size])
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B) + np.uint32(2 * n)
    return np.where(valid, code >> np.uint32(16), BUCKETS).astype(np.int64)


def _scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of each word's first character."""
    a, b, c = (data[starts + k].astype(np.int64) for k in (1, 2, 3))
    point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b & 0x3F, np.where(a < 0xF0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0xFFFF)))
    return np.array(SCRIPT_NUMBERS)[np.searchsorted(SCRIPT_STARTS, point, side="right") - 1]


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in pieces of about ``limit`` bytes that end at white space: no word is cut."""
    at = 0
    while len(text) - at > limit:
        stop = max(text.rfind(b" ", at, at + limit), text.rfind(b"\n", at, at + limit)) + 1
        if not stop:
            stop = text.find(b" ", at + limit) + 1
            if not stop:
                break
        yield text[at:stop]
        at = stop
    yield text[at:] if at else text


def word_scores(texts: list[bytes], model: LanguageModel, limit: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all words (words, languages), at most 0; the number of bytes of each; the number of words of each text. A longer text goes through in pieces."""
    limit = limit or _PIECE
    if all(len(x) <= limit for x in texts):
        return _word_scores(texts, model)
    parts, counts = [], []
    for x in texts:
        own = [_word_scores([piece], model) for piece in _cut(x, limit)]
        parts += own
        counts.append(sum(int(c.sum()) for *_, c in own))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(counts, dtype=np.int64)


def _word_scores(texts: list[bytes], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, starts, counts = _words(texts)
    if not counts.sum():
        return np.zeros((0, len(model.languages))), np.zeros(0, dtype=np.int64), counts
    size = len(data) - max(ORDERS)
    total = np.zeros((size, len(model.languages)), dtype=np.float32)
    for n in ORDERS:
        total += model.grams[_buckets(data, n)]
    scores = np.add.reduceat(total[: size - 1], starts, axis=0).astype(np.float64) / 2
    allowed = model.uses[_scripts(data, starts)]
    none = ~allowed.any(axis=1)
    scores[~allowed & ~none[:, None]] = -1e4
    scores -= scores.max(axis=1, keepdims=True)
    scores[none] = 0.0
    return scores, np.diff(np.append(starts, size - 1)) - 1, counts


def label_words(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word: the sum of scores less penalty for each switch within a text is greatest; of equals the first label."""
    n, k = scores.shape
    blocks = -(-counts // BLOCK)
    if not n:
        return np.zeros(0, dtype=np.int64)
    first_word, first_block = np.cumsum(counts) - counts, np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(counts)), blocks)
    within = np.arange(len(text)) - first_block[text]
    place = within[:, None] * BLOCK + np.arange(BLOCK)
    real = place < counts[text][:, None]
    place = np.where(real, first_word[text][:, None] + place, n)
    padded = np.append(scores, np.zeros((1, k)), axis=0)[place]

    matrix = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(len(text), axis=0)
    for t in range(BLOCK):
        matrix = np.maximum(matrix, matrix.max(axis=2, keepdims=True) - penalty) + padded[:, t, None, :]
    entry = np.zeros((len(text), k))
    longest = int(blocks.max())
    for b in range(1, longest):
        here = first_block[blocks > b] + b
        entry[here] = (entry[here - 1][:, :, None] + matrix[here - 1]).max(axis=1)

    before = np.empty((BLOCK, len(text), k), dtype=np.int16)
    value, own = entry.copy(), np.arange(k)
    for t in range(BLOCK):
        best = value.argmax(axis=1)[:, None]
        switch = value.max(axis=1, keepdims=True) - penalty
        before[t] = np.where(value >= switch, own, best)
        value = np.maximum(value, switch) + padded[:, t]
    labels = np.empty((BLOCK, len(text), k), dtype=np.int16)
    state = np.broadcast_to(own, (len(text), k)).astype(np.int16)
    for t in range(BLOCK - 1, -1, -1):
        labels[t] = state
        state = np.take_along_axis(before[t], state.astype(np.int64), axis=1)
    exit_ = np.zeros(len(text), dtype=np.int64)
    for b in range(longest - 1, -1, -1):
        here = first_block[blocks > b] + b
        final = blocks[blocks > b] == b + 1
        exit_[here] = np.where(final, value[here].argmax(axis=1), 0)
        inner = here[~final]
        exit_[inner] = state[inner + 1, exit_[inner + 1]]
    chosen = labels[:, np.arange(len(text)), exit_].T
    out = np.empty(n + 1, dtype=np.int64)
    out[place.ravel()] = chosen.ravel()
    return out[:n]


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang", switch_penalty: float = 12.0) -> LanguageModel:
    """A model of the languages in column ``lang`` from all rows whose language isn't null. The result has languages x 65,537 numbers.

    Null and empty texts add nothing, repeated rows count as often as they occur. Without
    words of a language its n-grams are all equally likely and no script is its own.
    """
    spark_schema = "lang string, kind int, bucket int, n long"
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for part, texts in steps(batches, text):
            names = part.column(1).to_pylist()
            for name in set(names):
                own = [x for x, lang_of in zip(texts, names, strict=True) if lang_of == name]
                groups = [own] if max(map(len, own)) <= _PIECE else [[piece] for x in own for piece in _cut(x, _PIECE)]
                for data, starts, counts in map(_words, groups):
                    if not counts.sum():
                        continue
                    total = grams.setdefault(name, np.zeros(BUCKETS + 1 + SCRIPTS, dtype=np.int64))
                    for n in ORDERS:
                        total[: BUCKETS + 1] += np.bincount(_buckets(data, n), minlength=BUCKETS + 1)
                    total[BUCKETS + 1 :] += np.bincount(_scripts(data, starts), minlength=SCRIPTS)
        for name, total in grams.items():
            total[BUCKETS] = 0
            for kind, part in ((0, total[:BUCKETS]), (1, total[BUCKETS + 1 :])):
                at = np.flatnonzero(part)
                yield table(schema, [name] * len(at), np.full(len(at), kind), at.astype(np.int32), part[at])

    labelled = docs.select(text, lang).where(F.col(lang).isNotNull())
    summed = labelled.mapInArrow(count, spark_schema).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(summed["lang"].to_pylist(), dtype=object)
    kind, bucket, n = (summed[c].to_numpy() for c in ("kind", "bucket", "n"))
    languages = tuple(sorted(set(names)))
    grams, uses = np.zeros((BUCKETS + 1, len(languages)), dtype=np.float32), np.zeros((SCRIPTS, len(languages)), dtype=bool)
    for j, name in enumerate(languages):
        own = np.zeros(BUCKETS)
        own[bucket[(names == name) & (kind == 0)]] = n[(names == name) & (kind == 0)]
        grams[:BUCKETS, j] = np.log((own + 0.5) / (own.sum() + 0.5 * BUCKETS))
        script = np.zeros(SCRIPTS)
        script[bucket[(names == name) & (kind == 1)]] = n[(names == name) & (kind == 1)]
        uses[:, j] = script > 0.001 * script.sum()
    return LanguageModel(languages, grams, uses, switch_penalty)


UNDETERMINED = "und"


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and the spans of one language, for every whole text.

    ``span_langs`` and ``span_starts`` give the spans' languages and first words, counted
    in runs of letters. lang_pred is the language whose spans hold the most bytes, of
    equals the first by name; score is their share times that language's share of the
    evidence over the text, 0 to 1. Null, empty and letterless texts, and any text if no
    language was learned, are ``und`` with score 0 and no spans.
    """
    schema = pa.schema([(key, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("span_langs", pa.list_(pa.string())), ("span_starts", pa.list_(pa.int32()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.languages, UNDETERMINED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        for part, texts in steps(batches, text, max(1 << 16, (8 << 20) // max(4, k))):
            letters = [bool(x.translate(None, _NOT_ASCII_LETTERS)) or not x.isascii() and any(map(str.isalpha, x.decode())) for x in texts]
            texts = [x if k and y else b"" for x, y in zip(texts, letters, strict=True)]
            scores, sizes, counts = word_scores(texts, model)
            label = label_words(scores, counts, model.switch_penalty) if k else np.zeros(0, dtype=np.int64)
            owner = np.repeat(np.arange(len(texts)), counts)
            held = np.bincount(owner * k + label, weights=sizes, minlength=len(texts) * k).reshape(len(texts), k) if k else np.zeros((len(texts), 1))
            found = counts > 0
            best = np.where(found, held.argmax(axis=1), k)
            share = held.max(axis=1) / np.maximum(held.sum(axis=1), 1)
            score = np.zeros(len(texts))
            if k and found.any():
                total = np.zeros((len(texts), k))
                np.add.at(total, owner, scores)
                total /= np.sqrt(np.maximum(counts, 1))[:, None]
                total = np.exp(total - total.max(axis=1, keepdims=True))
                score = np.where(found, share * (total / total.sum(axis=1, keepdims=True))[np.arange(len(texts)), np.minimum(best, k - 1)], 0.0)
            at = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            edge = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, dtype=np.int64)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[edge], minlength=len(texts)))).astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.array([names[j] for j in label[edge]], type=pa.string()))
            begins = pa.ListArray.from_arrays(offsets, pa.array(at[edge].astype(np.int32)))
            yield table(schema, part.column(0), [names[j] for j in best], score, spans, begins)

    selected = docs.select(F.col(key).cast("long").alias(key), text)
    return selected.mapInArrow(run, f"{key} long, lang_pred string, score double, span_langs array<string>, span_starts array<int>")


_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
