import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece

from graphloom.llm.piece_codec import PieceCodec, decode_documents, encode_documents, read_model, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(read_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    letters = "abcdefghinorstTHE  .,\néßü日€😀▁"
    yield from (" " * n + tail for n in range(40) for tail in ("", "Hello", "the\n"))
    yield from ("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000))
    yield from ("".join(rng.choice(["on", "th", "er", "ti", "ing", "Th"]) for _ in range(rng.randint(1, 9))) for _ in range(2000))
    yield from ("<s>", "</s><unk>", "<0x41>", "﻿x", "à")


def test_same_as_library(codec, library):
    for x in texts():
        ids = library.encode(x)
        assert codec.encode(x) == ids, repr(x)
        assert codec.decode(ids) == library.decode(ids), repr(x)


def test_any_ids_decode_as_in_library(codec, library):
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([rng.randint(1, 258), rng.randint(3, 31999)]) for _ in range(8)]
        assert codec.decode(ids) == library.decode(ids)


def test_tables(spark, make, odd, library):
    model = read_model(PATH)
    rows = decode_documents(encode_documents(make(odd), model), model).collect()
    assert len(rows) == len(odd)
    want = sorted((k or 0, hashlib.sha256(str(library.encode(t or "", add_bos=True, add_eos=True)).encode()).hexdigest(), library.decode(library.encode(t or ""))) for k, t in odd)
    got = sorted((r.doc_id or 0, hashlib.sha256(str([int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]).encode()).hexdigest(), r.text) for r in rows)
    assert got == want
    assert sorted(map(str, round_trip(make(odd), model).collect())) == sorted(map(str, rows))
    assert encode_documents(make([]), model).count() == 0
