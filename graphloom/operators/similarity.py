"""Near-duplicate bodies by MinHash and bands, and nearest neighbours of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import signature_match

HASHES, BANDS = 64, 32
_SEEDS = np.random.default_rng(0x5EED).integers(1, 1 << 63, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)


def minhash(words: Column, size: int = 3) -> Column:
    """64 MinHash values (0 to 2^32 - 1) over the runs of ``size`` tokens of an array; fewer tokens give null. Arithmetic wraps at 64 bits."""

    @F.pandas_udf("array<long>")
    def run(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batch:
            yield pd.Series([_signature(_shingles(w, size)) if w is not None and len(w) >= size else None for w in arrays], dtype=object)

    return run(words)


def body_signature(classes: list[str], least: int = 30) -> list[int] | None:
    """64 MinHash values over the runs of three classes of a body's tokens; a body of under ``least`` tokens says too little."""
    return _signature(_shingles(classes, 3)) if len(classes) >= least else None


def _shingles(words: list[str], size: int) -> np.ndarray:
    runs = set(zip(*(words[k:] for k in range(size)), strict=False))
    return np.array([xxhash.xxh64_intdigest("\0".join(r)) for r in runs], dtype=np.uint64)


def _signature(values: np.ndarray) -> list[int]:
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 4096):
        mixed = (values[k : k + 4096, None] ^ _SEEDS[0]) * _SEEDS[1]
        least = np.minimum(least, (mixed >> np.uint64(32)).min(axis=0))
    return least.astype(np.int64).tolist()


def similar_pairs(signed: DataFrame, least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """Pairs of different signatures (a, b, similarity), and membership (id, class).

    signed: id, signature. Rows of one signature form a class named by its smallest id,
    so a group of copies costs one row in the join, however large it is. Signatures that
    agree in ``least`` of 64 values differ in d at most, so of d + 1 blocks of values one is
    equal: blocks as long as that make short lists and lose no pair. Beyond 32 blocks pairs
    must agree in one of 32 bands of two values.
    """
    usable = signed.where(F.col("signature").isNotNull())
    classes = usable.groupBy("signature").agg(F.min("id").alias("class"))
    members = usable.join(classes, "signature").select("id", "class")
    blocks = min(int(HASHES * (1 - least) + 1e-9) + 1, BANDS)
    ends = [b * HASHES // blocks for b in range(blocks + 1)]
    keys = F.array(*(F.xxhash64(F.slice("signature", a + 1, b - a)) for a, b in zip(ends, ends[1:], strict=False)))
    banded = classes.select("class", F.posexplode(keys).alias("band", "bucket"))
    a, b = (banded.select("band", "bucket", F.col("class").alias(side)) for side in ("a", "b"))
    candidates = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    left, right = (classes.select(F.col("class").alias(side), F.col("signature").alias(f"{side}_signature")) for side in ("a", "b"))
    scored = candidates.join(left, "a").join(right, "b").select("a", "b", signature_match(F.col("a_signature"), F.col("b_signature")).alias("similarity"))
    return scored.where(F.col("similarity") >= least), members


def with_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs of classes, and one of similarity 1 of each other member of a class with the id that names it: a, b, similarity."""
    tied = members.where(F.col("class") < F.col("id")).select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.select("a", "b", F.col("similarity").cast("double").alias("similarity")).unionByName(tied)


def top_per_source(pairs: DataFrame, most: int = 10) -> DataFrame:
    """SIMILAR_TO edges of each class to its most similar ones, of equals the smaller id: src, dst, similarity."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").union(pairs.select("b", "a", "similarity"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def nearest_neighbors(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, key: str = "id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Exact k nearest rows by cosine of each query vector, itself left out: query, id, similarity, rank.

    Queries go to the tasks in blocks of bounded size. Each task keeps the k best of its
    batches a query, so what is shuffled is k rows a query and task. Null, empty and zero
    vectors are near to nothing.
    """
    ids = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where(F.size("v") > 0)
    n = ids.count()
    parts = -(-n // block)
    out = None
    for p in range(parts):
        own = ids if parts == 1 else ids.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)
        rows = own.orderBy("q").collect()
        if not rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(([r.q for r in rows], _unit(np.array([r.v for r in rows], dtype=np.float64))))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for frame in frames:
                frame = frame[frame["v"].map(lambda v: v is not None and len(v) == matrix.shape[1])]
                for start in range(0, len(frame), 4096):
                    some = frame.iloc[start : start + 4096]
                    own, sims = some["id"].to_numpy(), matrix @ _unit(np.stack(some["v"].to_numpy()).astype(np.float64)).T
                    for i, q in enumerate(names):
                        s = np.where(own == q, -2.0, sims[i])
                        best = np.lexsort((own, -s))[: k] if len(s) <= k else (lambda c: c[np.lexsort((own[c], -s[c]))][:k])(np.flatnonzero(s >= np.partition(s, -k)[-k]))
                        best = best[s[best] >= max(least, -1.0)]
                        if len(best):
                            yield pd.DataFrame({"query": q, "id": own[best], "similarity": s[best]})

        kind = dict(vectors.dtypes)[key]
        found = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(run, f"query {dict(queries.dtypes)[key]}, id {kind}, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"query {dict(queries.dtypes)[key]}, id {dict(vectors.dtypes)[key]}, similarity double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 6)), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_center(vectors: DataFrame, centers: DataFrame, key: str = "id", name: str = "feature", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """Of each vector the center with the greatest cosine, of equals the greatest name: id, feature, confidence.

    Vectors are read in place. Centers go to them a block at a time as one matrix, so no
    pair of a vector and a center is ever a row.
    """
    from ..sources.scratch import written

    numbered = written(centers.select(F.col(name).alias("name"), F.col("mean").alias("v")), "centers")
    parts = max(1, -(-numbered.count() // block))
    schema, out = f"{key} {dict(vectors.dtypes)[key]}, {name} {dict(centers.dtypes)[name]}, confidence double", None
    for p in range(parts):
        rows = sorted(numbered.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == p).collect(), key=lambda r: r["name"], reverse=True)
        if not rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(([r["name"] for r in rows], _unit(np.array([r.v for r in rows], dtype=np.float64))))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for frame in frames:
                frame = frame[frame["v"].map(lambda v: v is not None and len(v) == matrix.shape[1])]
                for start in range(0, len(frame), 4096):
                    some = frame.iloc[start : start + 4096]
                    sims = np.round(_unit(np.stack(some["v"].to_numpy()).astype(np.float64)) @ matrix.T, 6)
                    best = sims.argmax(axis=1)  # the first of equals, which has the greatest name
                    yield pd.DataFrame({key: some["id"].to_numpy(), name: [names[i] for i in best], "confidence": sims[np.arange(len(some)), best]})

        found = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema)
    best = out.groupBy(key).agg(F.max(F.struct("confidence", name)).alias("m"))
    return best.select(key, F.col(f"m.{name}").alias(name), "m.confidence")


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, np.inf, size)
