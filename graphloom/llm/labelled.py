"""Labelled rows to learn from, and calibration of scores to probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Labelled rows of each class that a classifier is fitted on at most; above it, a hash of the key decides.
CLASS_ROWS = 50_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", modulus: int = 4, class_rows: int = CLASS_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """Rows (key, text, y) of training documents, about ``class_rows`` of each class at most, and each class's weight to undo the sampling.

    Training rows are those whose key isn't held out and whose label is 0 or 1. Of
    several labels of one key the smallest counts. The sampled keys number at most
    2 * class_rows, so the join broadcasts a few megabytes whatever the size of the tables.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key, modulus)).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, 0.98 * class_rows / n) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))
    limit = F.when(F.col("y") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)) * (1 << 30)
    chosen = y.where(draw < limit)
    found = docs.select(F.col(key).cast("long").alias(key), text).join(F.broadcast(chosen), key).select(key, text, "y")
    return found, {c: 1 / s for c, s in share.items()}


def isotonic(x: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing function of x nearest to the rates ones / weight, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for i in order.tolist():
        pools.append([float(ones[i]), float(weight[i]), float(x[i]) * float(weight[i])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    table = np.array(pools)
    return table[:, 2] / table[:, 1], table[:, 0] / table[:, 1]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic regression with a slight penalty; the slope is at least 0."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        hessian = (design * w[:, None]).T @ design + np.eye(2) * 1e-2
        beta = beta + np.linalg.solve(hessian, design.T @ (weight * (y - p)) - 1e-2 * beta)
    return float(beta[0]), max(0.0, float(beta[1]))
