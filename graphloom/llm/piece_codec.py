"""SentencePiece encoding and decoding (merge-type models) by backtracking.

A merge-type model joins, again and again, the adjacent pair whose joined piece scores
best. Its result is the only sequence of pieces that covers the text and whose adjacent
pieces are compatible: joining the two texts and merging again gives the same two pieces.
So the encoder need not merge: an Aho-Corasick automaton gives the longest piece at each
position, each next piece is tested for compatibility with the last one by undoing their
merges, shorter prefixes are tried on failure, and a bitfield marks the positions from
which no compatible continuation exists.

No piece has a space mark after another character, so a text falls into independent
segments, space marks then other characters; a character outside the vocabulary never
merges and splits a segment further (its UTF-8 bytes become byte pieces). Segments are
cached, as natural text repeats them. Two pieces of space marks share one score, for which
compatibility of neighbours isn't enough; runs of two or more space marks are merged
directly.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, keyed, steps, table

MARK = "▁"
#: Bytes of text, or of ids, that a task has at a time.
_STEP = 1 << 20
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceCodec:
    """Encoder and decoder over the bytes of a SentencePiece model file of merge type.

    encode("") is [] besides begin and end; any text decodes to itself, but that a space
    mark in the text becomes a space, as in the library.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = reader.vocab_size()
        self.bos, self.eos, self.unk = reader.bos_id(), reader.eos_id(), reader.unk_id()
        kinds = [reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) for i in range(size)]
        pieces = [reader.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i in range(size) if reader.is_byte(i)}
        ordinary = [i for i in range(size) if not kinds[i]]
        self.score = {pieces[i]: reader.get_score(i) for i in ordinary}
        self.ids = {pieces[i]: i for i in ordinary}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model joins pieces across spaces")
        self._rank_pieces(ordinary, pieces)
        self.data = [b""] * size
        for i in ordinary:
            self.data[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.data[i] = bytes([b])
        self.data[self.unk] = " ⁇ ".encode()
        self.segments = Recent(self._segment, 50_000)
        self.words, self.starts = Recent(self._word, 200_000), Recent(self._segment, 50_000)

    def _rank_pieces(self, ordinary: list[int], pieces: list[str]) -> None:
        """Ranks: characters first, then joined pieces from best to worst score, each with the pair that it is merged from."""
        single = [i for i in ordinary if len(pieces[i]) == 1]
        joined = sorted((i for i in ordinary if len(pieces[i]) > 1), key=lambda i: (-self.score[pieces[i]], i))
        self.by_rank = single + joined
        texts = [pieces[i] for i in self.by_rank]
        rank = {t: r for r, t in enumerate(texts)}
        self.size = [len(t) for t in texts]
        self.shorter = [-1] * len(texts)
        for r, t in enumerate(texts):
            self.shorter[r] = next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1)
        self.parts, self.pair, self._agree = [(r, r) for r in range(len(texts))], {}, {}
        for r in range(len(single), len(texts)):
            left = self.shorter[r]
            while left >= 0:
                right = rank.get(texts[r][self.size[left]:])
                if right is not None and left < r and right < r and self._compatible(left, right):
                    self.pair[left, right], self.parts[r] = r, (left, right)
                    break
                left = self.shorter[left]
        self._agree = {}
        # A joined piece that no sequence of merges gives never occurs in a result.
        self.formed = [r < len(single) or self.parts[r] != (r, r) for r in range(len(texts))]
        for r in range(len(texts)):
            while self.shorter[r] >= 0 and not self.formed[self.shorter[r]]:
                self.shorter[r] = self.shorter[self.shorter[r]]
        self.automaton = ahocorasick.Automaton()
        for r, t in enumerate(texts):
            if self.formed[r]:
                self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.breaks = {"\n"} - set(texts)
        self.runs = re.compile(f"([{re.escape(''.join(texts[: len(single)]))}]+)|(.)", re.DOTALL)

    def _compatible(self, left: int, right: int) -> bool:
        """Merging the joined text of both gives both again: undo the later merge, and see that no earlier one crosses the border."""
        limit = len(self.size)
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, left = left, self.parts[left][1]
                if left != limit:
                    continue
                limit, right = right + 1, self.parts[right][0]
                if right + 1 == limit:
                    return True
            else:
                limit, right = right + 1, self.parts[right][0]
                if right + 1 != limit:
                    continue
                limit, left = left, self.parts[left][1]
                if left == limit:
                    return True

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        size, shorter, agree = self.size, self.shorter, self._agree
        goal = len(text)
        # The automaton reports, for each end, longer matches first: of one start the last reported is the longest.
        longest = {end - size[r]: r for end, r in self.automaton.iter(text)}
        open_, at, taken, last = -1, 0, [], -1  # open_: bit k is cleared once no result passes through position k
        token = longest[-1]
        while True:
            then = at + size[token]
            if open_ >> then & 1:
                if last < 0:
                    fits = True
                elif (fits := agree.get(last << 32 | token)) is None:
                    fits = self._compatible(last, token)
                    if len(agree) < 1_000_000:
                        agree[last << 32 | token] = fits
                if fits:
                    taken.append(token)
                    if then == goal:
                        return [self.by_rank[r] for r in taken]
                    last, at, token = token, then, longest[then - 1]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                open_ &= ~(1 << at)
                token = taken.pop()
                last = taken[-1] if taken else -1
                at -= size[token]

    def _merge(self, text: str) -> list[int]:
        """Ids by merging, best score first and the leftmost of equals."""
        left, right = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
        symbol, heap = list(text), []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.score.get(symbol[a] + symbol[b])) is not None:
                heapq.heappush(heap, (-score, a, b, symbol[a] + symbol[b]))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if not symbol[a] or not symbol[b] or symbol[a] + symbol[b] != joined:
                continue
            symbol[a], symbol[b], right[a] = joined, "", right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [self.ids[s] for s in symbol if s]

    def _segment(self, segment: str) -> bytes:
        """The ids of a segment as little-endian unsigned 32-bit integers."""
        runs = self.runs.findall(segment)
        if len(runs) > 1:
            return b"".join(self.segments[known or other] for known, other in runs)
        known, other = runs[0]
        if other:
            ids = [self.byte_ids.get(b, self.unk) for b in other.encode()]
        else:
            ids = self._merge(known) if known.startswith(MARK * 2) else self._backtrack(known)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Like _segment, of a space mark and a word without one. A line break is no piece: the lines are words of their own."""
        if "\n" in word and "\n" in self.breaks:
            first, *lines = word.split("\n")
            line_end = self.segments["\n"]
            return self.words[first] + b"".join(line_end + (self.starts[x] if x else b"") for x in lines)
        return self._segment(MARK + word)

    def encode_raw(self, text: str) -> bytes:
        """The ids of a text, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " ":
            cache, parts = self.segments, _SEGMENT.findall(MARK + text.replace(" ", MARK))
        else:
            cache, parts = self.words, text.split(" ")
        found = list(map(cache.get, parts))
        if None in found:
            found = [cache[p] if x is None else x for x, p in zip(found, parts)]
        return b"".join(found)

    def encode(self, text: str, ends: bool = False) -> list[int]:
        ids = np.frombuffer(self.encode_raw(text), dtype="<u4").tolist()
        return [self.bos, *ids, self.eos] if ends else ids

    def decode_raw(self, ids: Iterable[int]) -> bytes:
        """The decoded text in UTF-8; bytes that don't form a character become U+FFFD, one for each."""
        ids = [i for i in ids if self.data[i]]
        text = b"".join(map(self.data.__getitem__, ids))
        if text[:1] == b" " and ids[0] != self.byte_ids.get(32):
            text = text[1:]
        try:
            text.decode()
            return text
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(text):
                size = next((n for n in range(1, 5) if _is_character(text[at : at + n])), 0)
                out.append(text[at : at + size] if size else "�".encode())
                at += size or 1
            return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_raw(ids).decode()


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_codecs: dict[str, PieceCodec] = {}


def codec_of(model: bytes) -> PieceCodec:
    """The codec of a model, built once a process."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = PieceCodec(model)
    return _codecs[name]


def read_model(path: str) -> bytes:
    """The model file as the driver sees it; its bytes (half a megabyte) travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", ends: bool = True) -> DataFrame:
    """``key``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every whole text.

    Null and empty texts have begin and end only. Rows are kept as they are: repeated
    rows give repeated rows, and other columns aren't read.
    """
    schema = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        begin, end = (np.array([i], dtype="<u4").tobytes() if ends else b"" for i in (codec.bos, codec.eos))
        for part, texts in steps(batches, text, _STEP):
            ids = [begin + codec.encode_raw(x.decode()) + end for x in texts]
            yield table(schema, part.column(0), [len(x) // 4 for x in ids], ids)

    return keyed(docs, key, text).mapInArrow(run, f"{key} long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``n_tokens``, ``ids`` and ``text``, the decoded text, of every row of ids. Null ids decode to the empty text."""
    schema = _coded(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for part, packed in steps(batches, ids, _STEP):
            yield table(schema, part.column(0), [len(x) // 4 for x in packed], packed, _decoded(codec, packed))

    return keyed(encoded, key, ids).mapInArrow(run, f"{key} long, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", ends: bool = True) -> DataFrame:
    """What decode_documents gives of what encode_documents gives, in one pass: one worker and one codec a task instead of two."""
    schema = _coded(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        begin, end = (np.array([i], dtype="<u4").tobytes() if ends else b"" for i in (codec.bos, codec.eos))
        for part, texts in steps(batches, text, _STEP):
            packed = [begin + codec.encode_raw(x.decode()) + end for x in texts]
            yield table(schema, part.column(0), [len(x) // 4 for x in packed], packed, _decoded(codec, packed))

    return keyed(docs, key, text).mapInArrow(run, f"{key} long, n_tokens long, ids binary, text string")


def _coded(key: str) -> pa.Schema:
    return pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])


def _decoded(codec: PieceCodec, packed: list[bytes]) -> pa.Array:
    texts = [codec.decode_raw(np.frombuffer(x, dtype="<u4").tolist()) for x in packed]
    return pa.array(texts, type=pa.binary()).cast(pa.string())
