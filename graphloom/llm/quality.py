"""Quality classifier: random Fourier features over document statistics.

Statistics of a text (lengths, repetition, symbols, case, lines) are scaled by the
training rows' mean and deviation and mapped to cosines of random projections, whose
inner products approximate a Gaussian kernel. Ridge regression on them needs the normal
equations only, which are sums over rows: each partition adds up its own, and the driver
adds the partitions and solves. Isotonic regression on training rows that the ridge fit
didn't see maps its output to a probability.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, table, written
from .labelled import CLASS_ROWS, isotonic, labelled_sample
from .line_rules import repeated_words

STATISTICS = (
    "log_words", "log_bytes", "word_length", "longest_word", "distinct_share", "top_word_share", "echo_share", "repeat_share", "symbols_per_word", "digit_share",
    "capital_share", "other_script_share", "marks_per_word", "exclamations_per_word", "bars_per_word", "words_per_line", "same_line_share", "short_line_share", "open_line_share", "stop_share",
)

_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,;:!?"
_BEYOND = bytes(range(128, 256))


def statistics_of(data: bytes, words: list[bytes], repeated: int) -> list[float]:
    """The numbers named in STATISTICS; all zero for a text without words."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)

    def held(kind: bytes) -> int:
        return len(data) - len(data.translate(None, kind))

    counts = Counter(words)
    solid = sum(map(len, words))
    letters, beyond = held(_LETTERS), held(_BEYOND)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(data)), solid / n, np.log1p(max(map(len, words))), len(counts) / n, max(counts.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n, repeated / n, held(_SYMBOLS) / n, held(_DIGITS) / solid,
        held(_CAPITALS) / (letters + 1), beyond / solid, held(_MARKS) / n, data.count(b"!") / n, data.count(b"|") / n, np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines), sum(x.rstrip()[-1:] not in _MARKS for x in lines) / len(lines), sum(v for w, v in counts.items() if len(w) <= 3) / n,
    ]


def statistics(texts: list[bytes]) -> np.ndarray:
    words = [x.split() for x in texts]
    return np.array([statistics_of(*x) for x in zip(texts, words, repeated_words(words).tolist(), strict=True)], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.projection + self.phase)
        return np.concatenate((waves, np.ones((len(z), 1))), axis=1)

    def raw_score(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probability of label 1; a slight slope keeps the order of scores that calibration pools."""
        raw_score = self.raw_score(stats)
        return np.clip(0.99 * np.interp(raw_score, self.knots, self.rates) + 0.01 / (1 + np.exp(-4 * (raw_score - 0.5))), 0, 1)


def _draft(mean: np.ndarray, scale: np.ndarray, waves: int, width: float, seed: int) -> QualityModel:
    rng = np.random.default_rng(seed)
    return QualityModel(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(len(STATISTICS), waves)) / width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), np.array([0.0]), np.array([0.5]))


def train_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, class_rows: int = CLASS_ROWS, waves: int = 384, width: float = 4.0, ridge: float = 1e-2, seed: int = 7) -> QualityModel:
    """Fit on a sample of about ``class_rows`` labelled training rows of each class at most.

    Without labels of both classes every text scores alike: the only class, or one half;
    one half too if no labelled row is among ``docs``. Null texts are empty, repeated rows
    count as often as they occur, of several labels of one key the smallest counts.
    """
    sample, weight = labelled_sample(docs, labels, label, key, text, modulus, class_rows)
    width_of = len(STATISTICS)
    flat = _draft(np.zeros(width_of), np.ones(width_of), waves, width, seed)
    if set(weight) != {0, 1}:
        return flat if not weight else QualityModel(flat.mean, flat.scale, flat.projection, flat.phase, flat.weights, flat.knots, np.array([float(set(weight) == {1})]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("y", pa.int32()), ("stats", pa.list_(pa.float64()))])
        for part, texts in steps(batches, text, 2 << 20):
            keys = part.column(0).to_numpy(zero_copy_only=False)
            yield table(schema, (keys % 5 == 0).astype(np.int32), part.column(2), statistics(texts).tolist())

    # The sample is bounded, and so are its few files.
    measured = written(sample.mapInArrow(measure, "part int, y int, stats array<double>").repartition(8), "statistics")
    of = [F.get("stats", F.lit(k)) for k in range(width_of)]
    moments = measured.agg(*(F.avg(c) for c in of), *(F.stddev_pop(c) for c in of)).first()
    if moments[0] is None:
        return flat
    draft = _draft(np.array(moments[:width_of], dtype=float), np.array(moments[width_of:], dtype=float), waves, width, seed)

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = batch.column(1).to_numpy().astype(float)
        stats = batch.column(2).flatten().to_numpy().reshape(len(y), width_of)
        return stats, y, np.where(y == 1, weight[1], weight[0])

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = waves + 1
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                stats, y, w = rows_of(batch.slice(k, 2000))
                z = draft.cosines(stats)
                left += (z * w[:, None]).T @ z
                right += z.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()]), pa.array([right.tobytes()])], names=["l", "r"])

    # A few files hold the sample, so a few matrices reach the driver.
    fit = measured.where("part = 0").mapInArrow(equations, "l binary, r binary").toArrow()
    left = sum(np.frombuffer(x, dtype=float) for x in fit["l"].to_pylist()).reshape(waves + 1, waves + 1)
    right = sum(np.frombuffer(x, dtype=float) for x in fit["r"].to_pylist())
    weights = np.linalg.solve(left + ridge * np.eye(waves + 1) * max(1.0, left[-1, -1] / 1000), right)
    fitted = QualityModel(draft.mean, draft.scale, draft.projection, draft.phase, weights, draft.knots, draft.rates)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bin", pa.int64()), ("ones", pa.float64()), ("weight", pa.float64())])
        for batch in batches:
            stats, y, w = rows_of(batch)
            yield table(schema, np.round(np.clip(fitted.raw_score(stats), -2, 3) * 500).astype(np.int64), w * y, w)

    unseen = measured.where("part = 1").mapInArrow(bins, "bin long, ones double, weight double").groupBy("bin").agg(F.sum("ones"), F.sum("weight")).toArrow()
    if not unseen.num_rows:
        return QualityModel(*list(fitted.__dict__.values())[:5], np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, rates = isotonic(*(c.to_numpy() for c in unseen.columns))
    return QualityModel(*list(fitted.__dict__.values())[:5], knots / 500, rates)


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``key``, ``score``, ``predicted`` and the statistics of every whole text; null and empty texts have statistics of zero."""
    schema = pa.schema([(key, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("statistics", pa.list_(pa.float64()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            stats = statistics(texts)
            score = shared.value.score(stats)
            yield table(schema, part.column(0), score, (score >= threshold).astype(np.int32), stats.tolist())

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, score double, predicted int, statistics array<double>")


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose text scores at the threshold or above. Null and empty texts have statistics of zero; repeated rows share one fate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, text, 2 << 20):
            yield part.filter(pa.array(shared.value.score(statistics(texts)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
