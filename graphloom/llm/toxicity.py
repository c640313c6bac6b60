"""Toxic passages as maximum-scoring segments.

A word's features are the word and its first 4, 5 and 6 bytes, so that inflected forms
share evidence. A feature scores the lower confidence bound of its log odds in toxic
against other documents, under a Dirichlet prior: half a text with the feature and half
without, and ``prior`` texts in which it has its overall rate. A word scores its best
feature if that is high enough, and a small negative drift otherwise.
Ruzzo and Tompa's scan finds all maximal segments of a text in linear time. Their scores
are calibrated by extreme-value theory (Karlin and Altschul): lambda solves
E[exp(lambda score)] = 1 over words of clean documents, K follows from the segments found
there, and a segment of score S in a text of n words has K n exp(-lambda S) equals or
betters by chance. The logarithms of the significant ones add up to a text's evidence,
which a logistic curve maps to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, steps, table, written
from .labelled import CLASS_ROWS, labelled_sample, logistic

_FOLD = bytes(32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if b < 91 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z in lower case; any byte beyond ASCII counts as a letter."""
    return text.translate(_FOLD).split()


def features_of(word: bytes) -> set[bytes]:
    return {word + b" "} | {word[:k] for k in (4, 5, 6) if len(word) >= k}


def lower_log_odds(a: int, n1: int, b: int, n0: int, prior: float) -> float:
    """The lower 95 % bound of the log odds ratio of a feature in ``a`` of n1 texts against ``b`` of n0, under its Dirichlet prior."""
    rate = (a + b) / (n1 + n0)
    has, lacks = 0.5 + prior * rate, 0.5 + prior * (1 - rate)
    odds = math.log((a + has) / (n1 - a + lacks)) - math.log((b + has) / (n0 - b + lacks))
    return odds - 1.64 * math.sqrt(1 / (a + has) + 1 / (b + has))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[bytes, float] = field(default_factory=dict)
    drift: float = 0.5
    lam: float = 1.0
    k: float = 1.0
    intercept: float = -3.0
    slope: float = 1.0
    significant: float = 0.05

    def word_score(self, word: bytes) -> float:
        return max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)

    def evidence(self, n: int, scores: list[float]) -> float:
        return sum(max(0.0, -math.log(self.expected(n, s))) for s in scores)

    def expected(self, n: int, score: float) -> float:
        return max(1e-300, self.k * n * math.exp(-min(600.0, self.lam * score)))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * math.log1p(evidence)))))


def maximal_segments(positive: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, past the last word, score); positive has the places and scores above zero, all other words score -drift."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last candidate with a smaller sum before
    total, last = 0.0, -1
    for place, score in positive:
        total -= drift * (place - last - 1)
        start, before, last = place, total, place
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, place + 1, before, total, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


def _segments(words: list[bytes], score: Recent, drift: float) -> tuple[list[tuple[int, int, float]], list[float]]:
    scores = list(map(score.__getitem__, words))
    positive = [(i, s) for i, s in enumerate(scores) if s] if any(scores) else []
    return maximal_segments(positive, drift), [s for _, s in positive]


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, class_rows: int = CLASS_ROWS, drift: float = 0.5, least_odds: float = 2.5, prior: float = 10.0) -> ToxicityModel:
    """Fit on a sample of at most about ``class_rows`` labelled training rows of each class.

    Candidate features occur in 0.2 % of the toxic texts and in 5 of them at least, which
    bounds their number by 500 times the features of a text, whatever the corpus; weaker
    evidence than ``least_odds`` counts for nothing. Without labelled texts of both classes
    the model scores every text alike, below 0.05. Null texts are empty, repeated rows
    count as often as they occur, of several labels of one key the smallest counts.
    """
    sample, weight = labelled_sample(docs, labels, label, key, text, modulus, class_rows)
    if set(weight) != {0, 1}:
        return ToxicityModel(drift=drift)

    def count(wanted: set[bytes] | None):
        schema = pa.schema([("feature", pa.binary()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter[bytes] = Counter()
            features = Recent(lambda w: tuple(features_of(w) if wanted is None else features_of(w) & wanted), 50_000)
            for part, texts in steps(batches, text):
                total[b""] += len(texts)
                for x in texts:
                    total.update(set().union(*map(features.__getitem__, set(words_of(x)))))
                if len(total) > 400_000:
                    yield table(schema, list(total), list(total.values()))
                    total.clear()
            yield table(schema, list(total), list(total.values()))

        return run

    def texts_with(of_class: int, wanted: set[bytes] | None) -> DataFrame:
        return sample.where(F.col("y") == of_class).mapInArrow(count(wanted), "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    counted = texts_with(1, None)
    toxic_texts = int((counted.where(F.length("feature") == 0).agg(F.sum("n")).first() or [0])[0] or 0)
    toxic = {f: n for f, n in counted.where(F.col("n") >= max(5, 0.002 * toxic_texts)).collect()}
    toxic = {bytes(f): n for f, n in toxic.items() if f}
    clean = {bytes(f): n for f, n in texts_with(0, set(toxic)).collect()}
    n1, n0 = toxic_texts, clean.pop(b"", 0)
    lexicon = {}
    for f, a in toxic.items():
        b = clean.get(f, 0)
        bound = lower_log_odds(a, n1, b, n0, prior)
        if bound >= least_odds:
            lexicon[f] = bound
    if not lexicon:
        return ToxicityModel(drift=drift)

    draft = ToxicityModel(lexicon, drift)
    schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("values", pa.list_(pa.float64())), ("times", pa.list_(pa.int64())), ("segments", pa.list_(pa.float64()))])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Recent(draft.word_score, 150_000)
        for part, texts in steps(batches, text):
            words = [words_of(x) for x in texts]
            found = [_segments(w, score, drift) for w in words]
            counts = [Counter(s) for _, s in found]
            yield table(schema, part.column(part.schema.get_field_index("y")), [len(w) for w in words], [list(c) for c in counts], [list(c.values()) for c in counts], [[s for *_, s in seg] for seg, _ in found])

    # The sample is bounded, and so are its few files.
    measured = written(sample.mapInArrow(segments, "y int, n long, values array<double>, times array<long>, segments array<double>").repartition(8), "segments")
    clean_rows = measured.where("y = 0")
    words_in, reached = (x or 0 for x in clean_rows.agg(F.sum("n"), F.sum(F.size("segments"))).first())
    # A word's score is one of the lexicon's: no more rows than that.
    counts = clean_rows.select(F.explode(F.arrays_zip("values", "times")).alias("v")).groupBy("v.values").agg(F.sum("v.times").alias("n")).collect()
    lam, k = karlin_altschul({r["values"]: r["n"] for r in counts}, words_in, reached, drift, float(np.mean(list(lexicon.values()))))
    model = ToxicityModel(lexicon, drift, lam, k)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, n, scores = (batch.column(c).to_pylist() for c in range(3))
            yield table(pa.schema([("y", pa.int32()), ("evidence", pa.float64())]), y, [model.evidence(*x) for x in zip(n, scores, strict=True)])

    # Two numbers a sampled row.
    rows = measured.select("y", "n", "segments").mapInArrow(weigh, "y int, evidence double").toArrow()
    y = rows["y"].to_numpy().astype(float)
    intercept, slope = logistic(np.log1p(rows["evidence"].to_numpy()), y, np.where(y == 1, weight[1], weight[0]))
    return ToxicityModel(lexicon, drift, lam, k, intercept, slope)


def karlin_altschul(positive: dict[float, int], words: int, segments: int, drift: float, typical: float) -> tuple[float, float]:
    """lambda and K of clean texts: how often each positive score occurs among so many words, all others scoring -drift, and the number of their segments.

    One more word, of the typical score, and one more segment stand for what the sample didn't show.
    """
    counts = Counter(positive)
    counts[typical] += 1
    scores, times = np.array(list(counts)), np.array(list(counts.values()), dtype=float)
    total, low, high = words + 1, 0.0, 50.0
    for _ in range(100):  # the sum is convex and below 0 just above lambda = 0, as positive scores are rare among clean words
        lam = (low + high) / 2
        excess = (times * np.exp(np.minimum(600, lam * scores))).sum() + (total - times.sum()) * math.exp(-lam * drift) - total
        low, high = (low, lam) if excess > 0 else (lam, high)
    return lam, (segments + 1) / (total * math.exp(-lam * float(scores.min())))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``key``, ``score``, ``predicted`` and the significant passages of every whole text.

    ``passage_starts`` and ``passage_ends`` count runs of letters; ``passage_scores`` are
    the segments' scores. Null and empty texts have no passage and the lowest score.
    """
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passage_starts", pa.list_(pa.int32())), ("passage_ends", pa.list_(pa.int32())), ("passage_scores", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Recent(shared.value.word_score, 150_000)
        for part, texts in steps(batches, text):
            rows = [_judged(x, shared.value, score) for x in texts]
            scores = [r[0] for r in rows]
            passages = [r[1] for r in rows]
            yield table(schema, part.column(0), scores, [int(s >= threshold) for s in scores], *([[p[k] for p in own] for own in passages] for k in range(3)))

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, score double, predicted int, passage_starts array<int>, passage_ends array<int>, passage_scores array<double>")


def _judged(data: bytes, model: ToxicityModel, score: Recent) -> tuple[float, list[tuple[int, int, float]]]:
    words = words_of(data)
    segments, _ = _segments(words, score, model.drift)
    evidence = model.evidence(len(words), [s for *_, s in segments])
    return model.probability(evidence), [s for s in segments if model.expected(len(words), s[2]) <= model.significant]


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold. Null and empty texts score lowest and stay; repeated rows share one fate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Recent(shared.value.word_score, 150_000)
        for part, texts in steps(batches, text):
            yield part.filter(pa.array([_judged(x, shared.value, score)[0] < threshold for x in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
