import random
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import language_id
from graphloom.llm.labelled import isotonic, labelled_sample, logistic
from graphloom.llm.language_id import _cut, identify_languages, label_words, train_languages, word_scores
from graphloom.llm.quality import STATISTICS, keep_good, score_quality, statistics, train_quality
from graphloom.llm.toxicity import drop_toxic, features_of, lower_log_odds, maximal_segments, score_toxicity, train_toxicity, words_of

WORDS = {"en": "the of and with thing there other".split(), "de": "der die und nicht ein schön über".split()}


def prose(rng, lang="en", n=60):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, make, odd):
    rng = random.Random(4)
    rows, labels = list(odd), []
    for k in range(100, 700):
        text, quality, toxic = prose(rng), 1, 0
        if k % 4 == 0:
            text, quality = " ".join(["BUY!! NOW##"] * 40), 0
        if k % 5 == 0:
            at = rng.randrange(len(text) // 2)
            text, toxic = text[:at] + " vilest scumbag vilest " + text[at:], 1
        rows.append((k, text))
        labels += [(k, quality, toxic)] * (1 + (k % 50 == 0))
    labels += [(None, 1, 1), (1, None, None), (99999, 0, 1)]
    return make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_is_bounded_and_never_held_out(corpus):
    docs, labels = corpus
    rows, weight = labelled_sample(docs, labels, "quality", class_rows=100)
    assert rows.count() <= 220 and rows.selectExpr("crc32(cast(doc_id AS string)) % 4 AS m").where("m = 2").count() == 0
    assert weight[1] > 2


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_rows(corpus, kind):
    docs, labels = corpus
    train, score, drop = (train_quality, score_quality, keep_good) if kind == "quality" else (train_toxicity, score_toxicity, drop_toxic)
    model = train(docs, labels)
    scored = score(docs, model)
    assert scored.count() == docs.count()
    rows = scored.join(labels.distinct(), "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2 AND quality IS NOT NULL").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r[kind] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.collect())
    kept = drop(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("train,score", [(train_quality, score_quality), (train_toxicity, score_toxicity)])
def test_nothing_to_learn_from(make, odd, corpus, train, score):
    docs, labels = corpus
    for some in (labels.limit(0), labels.where("quality = 1 AND toxic = 0")):
        rows = score(docs, train(docs, some)).collect()
        assert len({r.score for r in rows}) <= 1
    assert score(make([]), train(make([]), labels)).count() == 0
    # Labels of both classes, but for no row of the table.
    strangers = labels.selectExpr("doc_id + 1000000 AS doc_id", "quality", "toxic")
    rows = score(docs, train(docs, strangers)).collect()
    assert len({r.score for r in rows}) == 1 and all(0 <= r.score <= 1 for r in rows)


def brute_segments(scores):
    """All maximal segments by their definition: no larger segment scores as much, no proper part scores more."""
    n, total = len(scores), np.concatenate(([0.0], np.cumsum(scores)))
    found, taken = [], set()
    spans = sorted(((total[b] - total[a], a - b, a, b) for a in range(n) for b in range(a + 1, n + 1) if total[b] > total[a]), key=lambda s: (-s[0], -s[1], s[2]))
    for value, _, a, b in spans:
        if not taken & set(range(a, b)):
            found.append((a, b, value))
            taken |= set(range(a, b))
    return sorted(found)


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([1.37, 2.11, 3.19]) if rng.random() < 0.4 else -0.73 for _ in range(rng.randint(0, 14))]
        got = maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.73)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


def test_calibration():
    x, y = isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([1.0, 1.0, 0.0, 4.0]), np.array([2.0, 2.0, 2.0, 4.0]))
    assert (np.diff(y) >= 0).all() and y[-1] == 1.0
    a, b = logistic(np.array([0.0] * 50 + [1.0] * 50), np.array([0.0] * 45 + [1.0] * 50 + [0.0] * 5), np.ones(100))
    assert a < 0 < b


def brute_viterbi(scores, penalty):
    value, back = scores[0].copy(), []
    for s in scores[1:]:
        best = value.argmax()
        switch = value[best] - penalty
        back.append(np.where(value >= switch, np.arange(len(value)), best))
        value = np.maximum(value, switch) + s
    out = [int(value.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_block_viterbi():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 127, 128, 129, 700, 0, 5])
    scores = -rng.exponential(2.0, size=(int(counts.sum()), 3))
    got, at = label_words(scores, counts, 3.0), 0
    for n in counts:
        if n:
            assert got[at : at + n].tolist() == brute_viterbi(scores[at : at + n], 3.0)
        at += n


def test_languages(spark, make, odd):
    rng = random.Random(6)
    train = make([(k, prose(rng, "en")) for k in range(40)], "en").union(make([(k, prose(rng, "de")) for k in range(40)], "de"))
    model = train_languages(train.union(make(odd, None)))
    assert model.languages == ("de", "en")
    mixed = prose(rng, "en", 30) + " " + prose(rng, "de", 50)
    rows = {r.doc_id: r for r in identify_languages(make([*odd, (50, mixed), (51, "12345 ...")]), model).collect()}
    assert rows[50].lang_pred == "de" and rows[50].span_langs == ["en", "de"] and abs(rows[50].span_starts[1] - 30) <= 1
    assert {rows[k].lang_pred for k in (1, 2, 3, 51)} == {"und"} and rows[5].lang_pred == "en"
    empty = train_languages(make([]))
    assert {r.lang_pred for r in identify_languages(make(odd), empty).collect()} == {"und"}
    assert identify_languages(make([]), model).count() == 0


def known(corpus, label):
    """Training rows as plain lists: texts, labels, keys."""
    docs, labels = corpus
    of = {}
    for r in labels.collect():
        if r.doc_id is not None and r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            of[r.doc_id] = min(r[label], of.get(r.doc_id, 1))
    return [(r.text or "", of[r.doc_id], r.doc_id) for r in docs.collect() if r.doc_id in of]


def test_quality_against_brute_force(corpus):
    """The scores of the operator against dense ridge regression and a quadratic isotonic fit, from plain lists."""
    rows = known(corpus, "quality")
    stats = statistics([t.encode() for t, *_ in rows])
    y = np.array([float(c) for _, c, _ in rows])
    aside = np.array([k % 5 == 0 for *_, k in rows])
    model = train_quality(*corpus)
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, np.where(stats.std(axis=0) > 1e-9, stats.std(axis=0), 1.0))
    z = np.clip((stats - stats.mean(axis=0)) / model.scale, -6, 6) @ model.projection + model.phase
    z = np.concatenate((np.sqrt(2 / len(model.phase)) * np.cos(z), np.ones((len(z), 1))), axis=1)
    own = z[~aside]
    weights = np.linalg.solve(own.T @ own + 1e-2 * np.eye(own.shape[1]) * max(1.0, len(own) / 1000), own.T @ y[~aside])
    assert np.allclose(model.weights, weights, atol=1e-6)
    raw = np.round(np.clip(z[aside] @ weights, -2, 3) * 500)
    bins = np.unique(raw)
    ones, total = (np.array([v[raw == b].sum() for b in bins]) for v in (y[aside], np.ones(aside.sum())))
    # Max-min formula of isotonic regression.
    fit = [max(min(ones[i : j + 1].sum() / total[i : j + 1].sum() for j in range(b, len(bins))) for i in range(b + 1)) for b in range(len(bins))]
    assert np.allclose(np.interp(bins / 500, model.knots, model.rates), fit, atol=0.05) and (np.diff(model.rates) >= 0).all()
    got = {r.doc_id: r.score for r in score_quality(corpus[0], model).collect()}
    value = z @ weights
    want = np.clip(0.99 * np.interp(value, model.knots, model.rates) + 0.01 / (1 + np.exp(-4 * (value - 0.5))), 0, 1)
    assert np.allclose([got[k] for *_, k in rows], want, atol=1e-6) and len(STATISTICS) == stats.shape[1]


def test_toxicity_against_brute_force(corpus):
    rows = known(corpus, "toxic")
    toxic, clean = ([set().union(*map(features_of, words_of(t.encode()))) for t, c, _ in rows if c == y] for y in (1, 0))
    lexicon = {}
    for f in set().union(*toxic):
        a, b = sum(f in x for x in toxic), sum(f in x for x in clean)
        if a >= max(5, 0.002 * len(toxic)) and (bound := lower_log_odds(a, len(toxic), b, len(clean), 10.0)) >= 2.5:
            lexicon[f] = bound
    model = train_toxicity(*corpus)
    assert lexicon and model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[f] - v) < 1e-9 for f, v in lexicon.items())
    score = lambda w: max((lexicon.get(f, 0.0) for f in features_of(w)), default=0.0)
    words = [words_of(t.encode()) for t, c, _ in rows if c == 0]
    every = [score(w) for ws in words for w in ws] + [float(np.mean(list(lexicon.values())))]
    at_lambda = sum(np.exp(model.lam * (s or -0.5)) for s in every)
    assert abs(at_lambda / len(every) - 1) < 1e-6
    segments = sum(len(brute_maximal(ws, score)) for ws in words)
    least = min(s for s in every if s)
    assert abs(model.k - (segments + 1) / (len(every) * np.exp(-model.lam * least))) < 1e-9
    got = {r.doc_id: r for r in score_toxicity(corpus[0], model).collect()}
    for text, _, k in rows[::7]:
        ws = words_of(text.encode())
        found = brute_maximal(ws, score)
        expected = [model.k * len(ws) * np.exp(-model.lam * s) for *_, s in found]
        evidence = sum(max(0.0, -np.log(max(1e-300, e))) for e in expected)
        assert abs(got[k].score - 1 / (1 + np.exp(-(model.intercept + model.slope * np.log1p(evidence))))) < 1e-9
        assert list(zip(got[k].passage_starts, got[k].passage_ends, strict=True)) == [(a, b) for (a, b, _), e in zip(found, expected, strict=True) if e <= 0.05]


def brute_maximal(words, score):
    scores = [score(w) or -0.5 for w in words]
    return [] if max(scores, default=-1) < 0 else [s for s in maximal_segments([(i, v) for i, v in enumerate(scores) if v > 0], 0.5)]


def test_log_odds():
    """A feature of both classes alike says nothing; the prior's share is its overall rate, not less."""
    assert lower_log_odds(50, 100, 50, 100, 10.0) < 0 < lower_log_odds(90, 100, 1, 100, 10.0)
    a, n1, b, n0, prior = 8, 50, 3, 200, 40.0
    has, lacks = 0.5 + prior * 11 / 250, 0.5 + prior * 239 / 250
    want = np.log((8 + has) / (42 + lacks)) - np.log((3 + has) / (197 + lacks)) - 1.64 * np.sqrt(1 / (8 + has) + 1 / (3 + has))
    assert abs(lower_log_odds(a, n1, b, n0, prior) - want) < 1e-12


def test_word_scores_against_brute_force(make):
    """Counts of byte n-grams of each word, with the space before and after it, from plain dictionaries."""
    rng = random.Random(8)
    rows = {lang: [prose(rng, lang, 12) for _ in range(15)] for lang in ("de", "en")}
    model = train_languages(make([(k, t) for k, t in enumerate(rows["en"])], "en").union(make([(k, t) for k, t in enumerate(rows["de"])], "de")))

    def grams(word):
        data = b" " + word + b" "
        return [data[i : i + n] for i in range(len(data) - 1) for n in (1, 2, 3, 4) if len(data[i : i + n]) == n and not (n == 1 and data[i] == 32) and b" " not in data[i + 1 : i + n - 1]]

    def bucket(gram):
        code = 0
        for c in gram:
            code = (code ^ c) * 0x01000193 & 0xFFFFFFFF
        code ^= code >> 15
        return (code * (0x85EBCA6B + 2 * len(gram)) & 0xFFFFFFFF) >> 16

    logs = {}
    for lang, texts in rows.items():
        counts = Counter(bucket(g) for t in texts for w in words_of(t.encode()) for g in grams(w))
        total = sum(counts.values())
        logs[lang] = lambda b, counts=counts, total=total: np.log((counts[b] + 0.5) / (total + 0.5 * language_id.BUCKETS))
    text = b"the sch\xc3\xb6n thing"
    got, _, counts = word_scores([text], model)
    assert counts.tolist() == [3]
    for row, word in zip(got, words_of(text), strict=True):
        plain = np.array([sum(logs[lang](bucket(g)) for g in grams(word)) / 2 for lang in ("de", "en")])
        if word.isascii():
            assert np.allclose(row, plain - plain.max(), atol=1e-3)


def test_long_texts_in_pieces(make):
    rng = random.Random(9)
    model = train_languages(make([(k, prose(rng, "en")) for k in range(20)], "en").union(make([(k, prose(rng, "de")) for k in range(20)], "de")))
    texts = [(prose(rng, "en", 300) + "\n" + prose(rng, "de", 200)).encode(), b"", b"x" * 900 + b" the of", b"the"]
    for x in texts:
        assert b"".join(_cut(x, 100)) == x and all(len(p) <= 100 or b" " not in p[100:-1] for p in _cut(x, 100))
    for a, b in zip(word_scores(texts, model), word_scores(texts, model, limit=100), strict=True):
        assert np.allclose(a, b, atol=1e-3)
