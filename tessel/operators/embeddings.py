"""Embedding geometry: statistics, transforms, nearest rows, and comparison of spaces.

Sums over rows are taken by the executors as d x d tables; only these, whose size is the dimension's square, reach the
driver.  Galleries are sent in blocks of bounded rows, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stored


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def products(df: DataFrame, a: str, b: str) -> DataFrame:
    """(i, j, n, s): sums of a_i b_j over all rows; i = -1 stands for ones, so (-1, j) are sums of b_j and (-1, -1) counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x, y = (_matrix(batch.column(c)) for c in (0, 1))
                x, y = (np.column_stack((np.ones(len(batch)), m)) for m in (x, y))
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array((i - 1).ravel()), pa.array((j - 1).ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return df.select(F.col(a).alias("__a"), F.col(b).alias("__b")).mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def _collected(df: DataFrame, a: str, b: str) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Count, means of both, and the centred product matrix."""
    rows = products(df, a, b).toPandas()
    m = np.zeros((int(rows.i.max()) + 2, int(rows.j.max()) + 2))
    m[rows.i + 1, rows.j + 1] = rows.s
    n = m[0, 0]
    return n, m[1:, 0] / n, m[0, 1:] / n, m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) / n


def covariances(df: DataFrame, vec: str, ridge: float = 0.0) -> DataFrame:
    """(i, j, cov) of sample covariances, with the ridge on the diagonal; indexes from 0."""
    s = products(df, vec, vec)
    n = s.where("i = -1 and j = -1").select(F.col("s").alias("n"))
    left, right = s.where("j = -1 and i >= 0").select("i", F.col("s").alias("si")), s.where("i = -1 and j >= 0").select("j", F.col("s").alias("sj"))
    both = s.where("i >= 0 and j >= 0").join(left, "i").join(right, "j").join(F.broadcast(n))  # one row
    cov = (F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)
    return both.select("i", "j", (cov + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("cov"))


@dataclass
class Stats:
    """What the training rows say of the space."""

    mean: np.ndarray
    cov: np.ndarray
    whiten: np.ndarray
    condition: float


def train_stats(df: DataFrame, vec: str, ridge: float = 1e-3, least: float = 1e-8) -> Stats:
    """Mean, covariance with ridge, the symmetric whitening matrix (eigenvalues clipped from below), and the condition number."""
    n, mean, _, product = _collected(df, vec, vec)
    cov = product / max(n - 1, 1) + ridge * np.eye(len(mean))
    value, basis = np.linalg.eigh(cov)
    value = np.maximum(value, least)
    return Stats(mean, cov, basis / np.sqrt(value) @ basis.T, float(value.max() / value.min()))


def transformed(x: np.ndarray, stats: Stats, metric: str) -> np.ndarray:
    """Rows for dot products: "cosine", "centered_cosine" (also "l2_euclidean"), "whitened_cosine", "row_centered"."""
    if metric in ("centered_cosine", "l2_euclidean"):
        x = x - stats.mean
    elif metric == "whitened_cosine":
        x = (x - stats.mean) @ stats.whiten
    elif metric == "row_centered":
        x = x - x.mean(axis=1, keepdims=True)
    elif metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def transform_rows(df: DataFrame, vec: str, stats: Stats, metric: str, to: str = "vec") -> DataFrame:
    """``df`` with the transformed vectors as ``to``."""
    sent = df.sparkSession.sparkContext.broadcast(stats)
    keep = [c for c in df.columns if c != to]
    place = keep.index(vec) if vec in keep else None
    schema = df.select(*keep).withColumn(to, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = transformed(_matrix(batch.column(place)), sent.value, metric)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*keep, to])

    return df.select(*keep).mapInArrow(run, schema)


def max_similarity(queries: DataFrame, gallery: DataFrame, id_col: str, vec: str, stats: Stats, metric: str, block_rows: int = 50_000) -> DataFrame:
    """(id, max_similarity) of each query with all gallery rows; minus infinity for an empty gallery."""
    spark, store = queries.sparkSession, Stored(queries.sparkSession, "similarity")
    blocks = max(1, -(-gallery.count() // block_rows))
    part = gallery.withColumn("__b", F.pmod(F.xxhash64(id_col), F.lit(blocks)))
    kind = queries.schema[id_col].dataType.simpleString()
    out = None
    for k in range(blocks):
        rows = part.where(F.col("__b") == k).select(vec).toArrow()
        held = spark.sparkContext.broadcast(transformed(_matrix(rows.column(0).combine_chunks()), stats, metric) if len(rows) else None)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = batch.column("best").to_numpy(zero_copy_only=False).copy()
                if len(batch) and held.value is not None:
                    x = transformed(_matrix(batch.column("vec")), stats, metric)
                    for a in range(0, len(x), 256):
                        best[a : a + 256] = np.maximum(best[a : a + 256], (x[a : a + 256] @ held.value.T).max(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(best)], ["id", "vec", "best"])

        now = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"), F.lit(float("-inf")).alias("best")) if out is None else out
        out = now.mapInArrow(run, f"id {kind}, vec {queries.schema[vec].dataType.simpleString()}, best double")
        if blocks > 1:  # one block is held at a time
            out = store.put(out, f"block{k}")
            held.destroy()
    return out.select(F.col("id").alias(id_col), F.col("best").alias("max_similarity"))


def pair_distances(df: DataFrame, id_col: str, vec: str, group: list[str] | None = None, metric: str = "cosine") -> DataFrame:
    """(id_a, id_b, distance) of the pairs within a group, each once: the matrix's upper triangle."""
    keys = group or []
    a, b = (df.select(*keys, F.col(id_col).alias(f"id_{x}"), F.col(vec).alias(f"v{x}")) for x in ("a", "b"))
    pairs = (a.join(b, keys) if keys else a.join(b, F.col("id_a") < F.col("id_b"))).where("id_a < id_b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    if metric == "cosine":
        d = 1 - dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    elif metric == "euclidean":
        d = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, p: s + p))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return pairs.select(*keys, "id_a", "id_b", d.alias("distance"))


def rsa(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, rsa: the rank correlation of two tables of pair distances."""
    from .metrics import spearman

    both = a.select("id_a", "id_b", F.col("distance").alias("x")).join(b.select("id_a", "id_b", F.col("distance").alias("y")), ["id_a", "id_b"])
    return spearman(both, "x", "y", name="rsa")


def linear_cka(df: DataFrame, a: str, b: str) -> float:
    """Centred kernel alignment of two vectors per row: ||A'B||^2 / (||A'A|| ||B'B||)."""
    norm = lambda x, y: float(np.sqrt((_collected(df, x, y)[3] ** 2).sum()))
    down = norm(a, a) * norm(b, b)
    return norm(a, b) ** 2 / down if down > 0 else float("nan")


def procrustes(df: DataFrame, a: str, b: str) -> np.ndarray:
    """The orthogonal matrix that turns b nearest to a; the shorter vector counts as filled with zeros."""
    rows = products(df, a, b).where("i >= 0 and j >= 0").toPandas()
    d = int(max(rows.i.max(), rows.j.max())) + 1
    cross = np.zeros((d, d))
    cross[rows.j, rows.i] = rows.s
    u, _, vt = np.linalg.svd(cross)
    return u @ vt


def mean_matched_distance(df: DataFrame, a: str, b: str, turn: np.ndarray) -> float:
    """Mean Euclidean distance of a and the turned b."""
    sent = df.sparkSession.sparkContext.broadcast(turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sent.value)
        for batch in batches:
            if len(batch):
                x, y = (_matrix(batch.column(c)) for c in (0, 1))
                x, y = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, y))
                gap = np.sqrt(((x - y @ sent.value) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([float(gap.sum())]), pa.array([len(gap)], pa.int64())], ["s", "n"])

    r = df.select(F.col(a), F.col(b)).mapInArrow(run, "s double, n long").agg(F.sum("s"), F.sum("n")).head()
    return r[0] / r[1] if r[1] else float("nan")
