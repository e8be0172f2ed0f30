"""Clusters, embedders and text weights. Scores out of fold are in ``folds``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.held import held


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


def embed(df: DataFrame, key: str, text: str, factory: Callable[[], Embedder], batch: int = 256) -> DataFrame:
    """(key, x): the vector of each text by an embedder that a factory makes in each task; null for null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            texts = b.column(1).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list = [None] * len(texts)
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, v in zip(part, model.embed([texts[i] for i in part])):
                    out[i] = [float(z) for z in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "x"])

    kind = dict(df.select(key).dtypes)[key]
    return df.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, x array<double>")


def lloyd(x: np.ndarray, k: int, seed: int, iterations: int) -> tuple[float, np.ndarray]:
    """(cost, centres) of one start: centres drawn by squared distance, then moved to the means of their rows until none changes."""
    rng = np.random.default_rng([seed, k])
    centres = x[[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(1))
    own = None
    square = (x**2).sum(1)
    for _ in range(iterations):
        far = square[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
        new = far.argmin(1)
        if own is not None and (new == own).all():
            break
        own = new
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    far = square[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    return float(np.maximum(far.min(1), 0).sum()), centres


def centres(df: DataFrame, key: str, vector: str, ks: list[int], *, restarts: int = 30, iterations: int = 500, seed: int = 42, most: int = 50_000) -> dict[int, tuple[float, np.ndarray]]:
    """k -> (cost, centres) of the best of ``restarts`` starts, each a task of its own; ties by start.

    Fitted to at most ``most`` rows in the order of their keys' hash; they are shared with the tasks (25 MB at 64 places).
    """
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(most).select(vector).collect()
    if not rows:
        return {}
    shared = spark.sparkContext.broadcast(np.array([r[0] for r in rows], dtype=float))
    starts = spark.createDataFrame([(k, r) for k in ks for r in range(restarts)], "k int, start int").repartition(len(ks) * restarts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, r in zip(part["k"], part["start"]):
                cost, found = lloyd(shared.value, min(int(k), len(shared.value)), seed + int(r), iterations)
                yield pd.DataFrame({"k": [k], "start": [r], "cost": [cost], "centres": [found.ravel().tolist()]})

    got = starts.mapInPandas(run, "k int, start int, cost double, centres array<double>")
    best = got.groupBy("k").agg(F.min(F.struct("cost", "start", "centres")).alias("b")).collect()  # a row for each k
    size = shared.value.shape[1]
    return {r["k"]: (r["b"]["cost"], np.array(r["b"]["centres"]).reshape(-1, size)) for r in best}


def assigned(df: DataFrame, vector: str, found: np.ndarray) -> DataFrame:
    """Rows with ``cluster``, the nearest centre, the first of equally near ones; null for a null vector."""
    each = F.array(*[F.struct(F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, v: s + v).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(found)])
    return df.withColumn("cluster", F.when(F.col(vector).isNotNull(), F.array_min(each)["i"]))


def cluster(df: DataFrame, key: str, vector: str, k: int, **options) -> tuple[DataFrame, float]:
    """Rows with ``cluster`` from the best of some starts, and its cost."""
    found = centres(df, key, vector, [k], **options)
    if not found:
        return df.withColumn("cluster", F.lit(None).cast("int")), 0.0
    return assigned(df, vector, found[k][1]), found[k][0]


def cluster_sweep(df: DataFrame, key: str, vector: str, ks: list[int], **options) -> DataFrame:
    """(k, cost, silhouette) of a clustering at each size; the silhouette by distances to the clusters' centres, own and next."""
    df = held(df.select(key, vector))
    out = None
    for k, (cost, found) in sorted(centres(df, key, vector, ks, **options).items()):
        far = F.array_sort(F.array(*[F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, v: s + v) for c in found]))
        a, b = F.get("_f", F.lit(0)), F.get("_f", F.lit(1))
        each = df.where(F.col(vector).isNotNull()).select(far.alias("_f")).select(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)).alias("s"))
        row = each.agg(F.avg("s").alias("silhouette")).select(F.lit(k).alias("k"), F.lit(cost).alias("cost"), "silhouette")
        out = row if out is None else out.unionByName(row)
    return df.sparkSession.createDataFrame([], "k int, cost double, silhouette double") if out is None else out


def tfidf(docs: DataFrame, key: str, tokens: str, size: int = 8000) -> DataFrame:
    """(key, token, weight): (1 + ln tf)(ln((1 + n)/(1 + df)) + 1), each document scaled to length one.

    The vocabulary is the ``size`` most frequent tokens, ties by token. Counts are combined by document and token before
    anything is gathered by token.
    """
    tf = docs.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    terms = tf.groupBy("token").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "token").limit(size)
    n = docs.select(key).distinct().agg(F.count("*")).scalar()
    raw = tf.join(terms, "token").select(key, "token", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, key).select(key, "token", (F.col("w") / F.col("l")).alias("weight"))
