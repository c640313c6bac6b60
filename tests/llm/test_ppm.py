import math
import random
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm.ppm import END, ORDER, START, SYMBOLS, grams_of, parts_of, score_texts, train


def corpus(rng, n):
    return [" ".join(rng.choice(["the", "of", "and", "Thing", "é", "other.", f"w{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def brute(train_texts, texts):
    follow = [defaultdict(Counter) for _ in range(ORDER + 1)]
    symbols = lambda t: [START] * ORDER + list(t.encode().lower()) + [END]
    for t in train_texts:
        s = symbols(t)
        for p in range(ORDER, len(s)):
            for j in range(ORDER + 1):
                follow[j][tuple(s[p - j : p])][s[p]] += 1
    for t in texts:
        s, total = symbols(t), 0.0
        for p in range(ORDER, len(s)):
            out: set = set()
            for j in range(ORDER, -1, -1):
                live = {y: n for y, n in follow[j].get(tuple(s[p - j : p]), {}).items() if y not in out}
                if not live:
                    continue
                size = 2 * sum(live.values())
                if s[p] in live:
                    total += math.log10((2 * live[s[p]] - 1) / size)
                    break
                total += math.log10(len(live) / size)
                out |= set(live)
            else:
                total -= math.log10(max(1, SYMBOLS - len(out)))
        yield total


def test_same_as_brute_force(make, odd):
    rng = random.Random(1)
    known, fresh = corpus(rng, 60), [*corpus(rng, 20), "", "ZZZ \x00 unseen 日本"]
    words, trie = train(make(list(enumerate(known))))
    docs = make(list(enumerate(fresh)))
    counts = Counter(w for t in known for w in t.encode().lower().split()) + Counter({None: len(known)})
    n, v = sum(counts.values()), len(counts)
    for head in (200_000, 3, 0):  # all words broadcast, a few, none
        rows = {r.doc_id: r for r in score_texts(docs, words, trie, head_words=head).collect()}
        for k, (t, want) in enumerate(zip(fresh, brute(known, fresh), strict=True)):
            tokens = [*t.encode().lower().split(), None]
            r = rows[k]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
            assert math.isclose(r.score, want, rel_tol=1e-9)
    assert score_texts(make(odd), words, trie).count() == len(odd)
    assert score_texts(make([]), words, trie).count() == 0


def test_pruned_and_empty_models(make, odd):
    rng = random.Random(2)
    words, trie = train(make(list(enumerate(corpus(rng, 80)))), nodes=100)
    assert all(len(g) <= 257 for g in trie.grams)
    assert all(r.score < 0 and math.isfinite(r.score) for r in score_texts(make(odd), words, trie).collect())
    words, trie = train(make([]))
    rows = score_texts(make([(1, "abc"), (2, None)]), words, trie).collect()
    assert all(math.isfinite(r.score) and r.n_known == 0 and r.base_score == 0 for r in rows)


def test_every_gram_is_kept(make):
    """Whatever the number of grams, in one block or in many."""
    rng = random.Random(3)
    known, fresh = corpus(rng, 60), [*corpus(rng, 20), "", "ZZZ \x00 unseen 日本"]
    want = list(brute(known, fresh))
    for size in (None, 100):
        words, trie = train(make(list(enumerate(known))), block_grams=size)
        assert size is None or len(trie.names) > 5
        rows = {r.doc_id: r.score for r in score_texts(make(list(enumerate(fresh))), words, trie).collect()}
        assert all(math.isclose(rows[k], w, rel_tol=1e-9) for k, w in enumerate(want))


def test_long_texts_in_parts():
    rng = random.Random(12)
    texts = [bytes(rng.choice(b"abc ") for _ in range(n)) for n in (0, 5, 100, 31, 32, 33, 7, 64, 0, 200, 3)]
    code, sizes = grams_of(texts)
    ends = np.cumsum(sizes)
    for limit in (8, 32, 1000):
        got, counted = [], np.zeros(len(texts), dtype=int)
        for first, own, n in parts_of(texts, 5, limit):
            got.append(own)
            counted[first : first + len(n)] += n
        assert np.concatenate(got).tolist() == code.tolist() and counted.tolist() == sizes.tolist() and ends[-1] == counted.sum()
