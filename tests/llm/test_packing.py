import base64
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm.common import new_folder
from graphloom.llm import packing
from graphloom.llm.packing import best_fit_decreasing, encode_bytes, encode_text, read_packed, write_packed


def brute_rows(lengths, row):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(row - n)
    return len(rooms)


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        row = rng.choice([1, 7, 64, 100])
        lengths = [rng.randint(1, row) for _ in range(rng.randint(0, 60))]
        place, rows = best_fit_decreasing(lengths, row)
        assert rows == brute_rows(lengths, row)
        used = defaultdict(int)
        for p, n in zip(place, lengths, strict=True):
            used[p] += n
        assert all(u <= row for u in used.values()) and set(used) == set(range(rows))


@pytest.mark.parametrize("shard", [50, 10_000])
def test_round_trip(spark, shard):
    rng = random.Random(2)
    docs = {k: [rng.randrange(65_000) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 200]))] for k in range(120)}
    rows = [(k, bytearray(np.array(v, dtype="<u2").tobytes())) for k, v in docs.items()] + [(500, None), (-1, None), (None, None)]
    files = new_folder(spark, "test")
    packed = read_packed(write_packed(spark.createDataFrame(rows, "doc_id long, ids binary"), files, end=65_535, row=32, shard_ids=shard), files)
    parts = defaultdict(dict)
    for r in packed.collect():
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 32 and r.cu_seqlens[0] == 0 and (ids[r.cu_seqlens[-1] :] == 65_535).all()
        assert r.resets == r.cu_seqlens[:-1]
        for d, offset, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[d][offset] = ids[a:b].tolist()
    whole = {d: sum((p[k] for k in sorted(p)), []) for d, p in parts.items()}
    assert whole == {k: [*v, 65_535] for k, v in docs.items()} | {500: [65_535], -1: [65_535], None: [65_535]}
    empty = write_packed(spark.createDataFrame([], "doc_id long, ids binary"), files, end=0)
    assert read_packed(empty, files).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), tokenizers.PATTERN


@pytest.fixture(scope="module")
def encoding(vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary[0].splitlines()) if a}
    return tiktoken.Encoding("test", pat_str=vocabulary[1], mergeable_ranks=ranks, special_tokens={})


def test_runs_of_white_space(encoding, monkeypatch):
    """Around the pattern, runs have the ids that the pattern gives them."""
    monkeypatch.setattr(packing, "_LONG", re.compile(f"[{packing._SPACE}]{{3,}}"))
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "word", "1", "!", "'s", "é", " ", "  ", "\n", "\t \n", "\x1c", "\u3000", "\u200b", "\x85"]) for _ in range(rng.randint(0, 30)))
        assert encode_text(encoding, text) == encoding.encode_ordinary(text), repr(text)


def test_very_long_runs(encoding):
    for text in (" " * 2_000_000, "a" + "\n" * 1_500_000 + " b", "x" * 2_000_000, "!?" * 1_000_000, " \n\t" * 700_000 + "end", "1" * 1_000_000):
        assert encoding.decode(encode_text(encoding, text)) == text


def test_encode_bytes(make, odd, vocabulary, encoding):
    docs = make([*odd, (8, "a" + " " * 1_200_000)])
    got = encode_bytes(docs, *vocabulary).collect()
    assert len(got) == len(odd) + 1 and encode_bytes(make([]), *vocabulary).count() == 0
    texts = dict([*odd, (8, "a" + " " * 1_200_000)])
    for r in got:
        assert encoding.decode(np.frombuffer(r.ids, dtype="<u2").tolist()) == (texts[r.doc_id] or "")
