import random

import numpy as np

import corpus_pipeline
from graphloom.llm.near_copies import keep_one_near_copy, linked, near_copies, shingles_of


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(rows):
    sets, name = [shingles(t) for _, t in rows], {k: k for k, _ in rows}
    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and name[a] != name[b]:
                low, high = sorted((name[a], name[b]))
                name = {k: low if v == high else v for k, v in name.items()}
    return name


def copies(rng, families=12):
    rows = []
    for _ in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(own))
    return list(enumerate(rows, 10))


def test_linked():
    texts = [t for _, t in copies(random.Random(1), 6)]
    want = brute_components(list(enumerate(texts)))
    sets = [np.unique(np.array(shingles_of(t.encode()), dtype=np.uint64)) for t in texts]
    assert linked(sets).tolist() == [want[i] for i in range(len(texts))]
    assert linked([]).tolist() == [] and linked(sets[:1]).tolist() == [0]


def test_edited_copies(make):
    rows = copies(random.Random(2))
    want = brute_components(rows)
    assert 12 < len(set(want.values())) < 80
    for list_bytes in (8 << 20, 4096):  # also with clusters dealt out by tiles
        got = {r.doc_id: r.component_id for r in near_copies(make(rows), list_bytes=list_bytes).collect()}
        assert got == want


def test_stage(spark, make):
    """A copy with some words edited goes; three bits of SimHash do not link most of these."""
    rows = copies(random.Random(3))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, make(rows), "").collect()}
    assert kept == set(brute_components(rows).values())


def test_odd_rows(make, odd):
    docs = make([*odd, (9, "said TWICE,  row by row"), (10, "alone")])
    kept = keep_one_near_copy(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7, 10]
    assert kept.where("doc_id IS NULL").count() == 1
    assert keep_one_near_copy(make([])).count() == 0


def test_one_hot_family(make):
    """Hundreds of near-copies of one text among others, in lists far beyond the limit: the same classes."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows = []
    for k in range(260):
        own = list(words)
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, t) for k, t in copies(rng, 3)]
    want = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_copies(make(rows), list_bytes=20_000).collect()}
    assert got == want
