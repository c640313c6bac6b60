import random

import numpy as np
import xxhash

from graphloom.llm.components import Forest, components
from graphloom.llm.simhash import Slices, blocks_for, fingerprints_of, keep_one_of_each, linked_fingerprints, near, near_duplicates


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values, radius=3):
    forest = Forest(len(values))
    for i in range(len(values)):
        j = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
        forest.link(np.full(len(j), i), j)
    return forest.root


def clustered(rng, n):
    centers = [rng.getrandbits(64) for _ in range(n // 20)]
    out = set()
    while len(out) < n:
        v = rng.choice(centers)
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return np.array(sorted(out), dtype=np.uint64)


def test_fingerprints():
    texts = ["", " ", "One", "one two", "a b c d e f", "É e é ü. " * 9, "x y z " * 50]
    assert fingerprints_of([t.encode() for t in texts]).tolist() == [brute_fingerprint(t) for t in texts]


def test_bit_slices():
    values = clustered(random.Random(1), 700)
    for radius in (0, 1, 2, 3):
        forest = near(values, np.zeros(700, dtype=np.int64), np.full(700, 700), radius, chunk=512)
        assert (forest.root == brute_classes(values, radius)).all()


def test_links_and_components(spark):
    from graphloom.llm import simhash

    values = clustered(random.Random(2), 1500)
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for size, claimed in ((8192, 1500), (16, 1500), (8192, 10_000_000)):  # also with heavy keys dealt out by tiles, and with more blocks
        roots = {r.a: r.b for r in linked_fingerprints(distinct, claimed, most=size).collect()}
        signed = values.view(np.int64).tolist()
        groups, want = {}, {}
        for v, r in zip(signed, brute_classes(values), strict=True):
            want.setdefault(int(r), set()).add(v)
            groups.setdefault(roots.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_blocks_grow_with_the_input():
    assert blocks_for(1) == 4 and blocks_for(4_000_000) == 4 and 4 < blocks_for(10**8) <= blocks_for(10**11)


def test_rows(make, odd):
    rows = near_duplicates(make(odd)).collect()
    assert len(rows) == len(odd)
    by = {(r.doc_id, r.fp): r.component_id for r in rows}
    assert {by[k, 0] for k in (1, 2, 3)} == {1}
    assert near_duplicates(make([])).count() == 0


def test_keep_one_of_each(make, odd):
    docs = make([*odd, (9, "said twice, row by row"), (10, "alone")])
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 10]
    assert kept.where("doc_id IS NULL").count() == 1


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "x long, y long")
    found = {r.a: r.b for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}


def test_slices():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, size=2100, dtype=np.uint64)
    values[1050:] = values[:1050] ^ (np.uint64(1) << rng.integers(0, 64, size=1050, dtype=np.uint64))
    slices = Slices(values)
    for radius in (0, 1, 3, 4, 25, 31, 32, 40):
        for i in (0, 1049, 2099):
            assert slices.within(int(values[i]), radius) == np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist()
    slices.close(7)
    assert 7 not in slices.within(int(values[7]), 3) and 1057 in slices.within(int(values[7]), 3)


def test_long_texts_by_chunks():
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(0, 60))).encode() for _ in range(80)]
    want = [brute_fingerprint(t.decode()) for t in texts]
    assert fingerprints_of(texts).tolist() == want and fingerprints_of(texts, chunk=7).tolist() == want
