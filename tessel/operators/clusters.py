"""Clustering of feature rows, choice of the number of clusters, and division of clusters that are too large.

K-means, its elbow and PCA run on the executors.  DBSCAN and average linkage need all distances; like the silhouette they
are refused beyond the stated number of rows and fall back to the elbow, so what reaches one task is bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows for DBSCAN, average linkage and the silhouette.
DBSCAN_ROWS, LINKAGE_ROWS, SILHOUETTE_ROWS = 50_000, 5000, 5000
# Other names of methods.
ALIASES = {"k-means": "kmeans", "k_means": "kmeans", "elbow": "kmeans_elbow", "agglomerative": "hierarchical", "pca": "pca_kmeans"}


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))


def kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 0) -> DataFrame:
    """(key, cluster); as many clusters as rows or more make each row its own, by the key's order."""
    rows = _vectors(df, vec)
    if k >= rows.count():
        from .profiles import sequential_ids

        return sequential_ids(df.select(key), [key], "__n").select(key, (F.col("__n") - 1).cast("int").alias("cluster"))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).select(key, "cluster")


def elbow(costs: dict[int, float]) -> int:
    """The number of clusters whose cost is furthest from the chord between the first and the last; of equal ones the least."""
    ks = sorted(costs)
    if len(ks) < 3:
        return ks[0]
    x = (np.array(ks, float) - ks[0]) / (ks[-1] - ks[0])
    y = np.array([costs[k] for k in ks])
    y = (y - y.min()) / max(y.max() - y.min(), 1e-300)
    gap = np.abs((y[-1] - y[0]) * x - y + y[0]) / np.hypot(1, y[-1] - y[0])
    return ks[int(gap.argmax())]


def kmeans_elbow(df: DataFrame, key: str, vec: str, seed: int = 0, least: int = 2, most: int | None = None) -> DataFrame:
    """K-means with the elbow's number, from 2 to the least of the rows' root and 20 (8 from 100 000 rows on)."""
    rows = _vectors(df, vec)
    n = rows.count()
    top = most or min(int(n**0.5), 8 if n >= 100_000 else 20)
    costs = {k: KMeans(k=k, seed=seed, featuresCol="__v").fit(rows).summary.trainingCost for k in range(least, max(top, least) + 1) if k < n}
    return kmeans(df, key, vec, elbow(costs) if costs else 1, seed)


def pca_kmeans(df: DataFrame, key: str, vec: str, k: int, seed: int = 0) -> DataFrame:
    """K-means over the first components: the greater of k and 2, at most 16, the dimension, and the rows less one."""
    rows = _vectors(df, vec)
    d, n = len(rows.head()["__v"]), rows.count()
    parts = max(1, min(max(k, 2), n - 1, d, 16))
    turned = PCA(k=parts, inputCol="__v", outputCol="__p").fit(rows).transform(rows)
    if k >= n:
        return kmeans(df, key, vec, k, seed)
    return KMeans(k=k, seed=seed, featuresCol="__p", predictionCol="cluster").fit(turned).transform(turned).select(key, "cluster")


def _gaps(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of rows a to b from all rows."""
    square = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(square[a:b, None] + square[None, :] - 2 * x[a:b] @ x.T, 0))


def dbscan_labels(x: np.ndarray, eps: float | None = None, least: int = 5, step: int = 512) -> np.ndarray:
    """Labels by first member; noise rows are clusters of their own.

    Without ``eps`` it is the median distance to the ``max(least, 2)``-th nearest row, the row itself being the first.
    """
    n = len(x)
    k = min(max(least, 2), n) - 1
    if eps is None:
        eps = float(np.median(np.concatenate([np.partition(_gaps(x, a, min(a + step, n)), k, axis=1)[:, k] for a in range(0, n, step)]))) if n else 0.0
    near = [np.flatnonzero(row <= eps + 1e-12) for a in range(0, n, step) for row in _gaps(x, a, min(a + step, n))]
    core, label, made = np.array([len(m) >= least for m in near], bool), np.full(n, -1), 0
    for i in range(n):
        if label[i] >= 0 or not core[i]:
            continue
        label[i], todo = made, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] < 0:
                    label[j] = made
                    if core[j]:
                        todo.append(int(j))
        made += 1
    for i in np.flatnonzero(label < 0):
        label[i], made = made, made + 1
    return label


def linkage_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Average linkage down to ``k`` clusters; of equal distances the pair of least members merges first."""
    n = len(x)
    gap = np.vstack([_gaps(x, a, min(a + 512, n)) for a in range(0, n, 512)]) if n else np.zeros((0, 0))
    np.fill_diagonal(gap, np.inf)
    size, label, left = np.ones(n), np.arange(n), n
    while left > max(k, 1):
        i, j = sorted(divmod(int(gap.argmin()), n))
        gap[i] = gap[:, i] = (size[i] * gap[i] + size[j] * gap[j]) / (size[i] + size[j])
        gap[i, i] = np.inf
        gap[j] = gap[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
        left -= 1
    return np.unique(label, return_inverse=True)[1]


def silhouette(x: np.ndarray, label: np.ndarray) -> float:
    """Mean silhouette by Euclidean distance; clusters of one row count 0."""
    groups, place, size = np.unique(label, return_inverse=True, return_counts=True)
    if len(groups) < 2:
        return -1.0
    total = np.vstack([_gaps(x, a, min(a + 512, len(x))) @ np.eye(len(groups))[place] for a in range(0, len(x), 512)])
    own = total[np.arange(len(x)), place] / np.maximum(size[place] - 1, 1)
    mean = total / size
    mean[np.arange(len(x)), place] = np.inf
    other = mean.min(axis=1)
    return float(np.where(size[place] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0).mean())


def _local(df: DataFrame, key: str, vec: str, labels) -> DataFrame:
    """Labels of a table that a caller has bounded."""
    rows = sorted(df.select(key, vec).collect(), key=lambda r: r[0])
    x = np.array([r[1] for r in rows], float).reshape(len(rows), -1)
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(r[0], int(c)) for r, c in zip(rows, labels(x), strict=True)], f"{key} {kind}, cluster int")


def choose_clusters(df: DataFrame, key: str, vec: str, seed: int = 0, least: int = 2, most: int = 12) -> int:
    """The number of clusters of the greatest silhouette by k-means, over a hash sample of at most ``SILHOUETTE_ROWS`` rows."""
    part = df.orderBy(F.xxhash64(key), key).limit(SILHOUETTE_ROWS)
    rows = sorted(part.select(key, vec).collect(), key=lambda r: r[0])
    x, at, best = np.array([r[1] for r in rows], float), {r[0]: i for i, r in enumerate(rows)}, (-2.0, least)
    for k in range(least, min(most, len(rows) - 1) + 1):
        label = np.zeros(len(rows), int)
        for r in kmeans(part, key, vec, k, seed).collect():
            label[at[r[0]]] = r.cluster
        best = max(best, (silhouette(x, label), -k)) if k == least else max(best, (silhouette(x, label), -k))
    return abs(best[1])


def cluster(df: DataFrame, key: str, vec: str, method: str = "auto", k: int | None = None, seed: int = 0) -> DataFrame:
    """(key, cluster) by "kmeans", "kmeans_elbow", "pca_kmeans", "dbscan", "hierarchical" or "auto".

    "auto" is DBSCAN; beyond ``DBSCAN_ROWS`` rows, or where it finds fewer than two clusters, the elbow takes its place, as
    it does for linkage beyond ``LINKAGE_ROWS``.
    """
    name = method.strip().lower()
    name = ALIASES.get(name, name)
    n = df.count()
    if name == "kmeans" or name == "pca_kmeans":
        return (kmeans if name == "kmeans" else pca_kmeans)(df, key, vec, k or choose_clusters(df, key, vec, seed), seed)
    if name == "hierarchical" and n <= LINKAGE_ROWS:
        return _local(df, key, vec, lambda x: linkage_labels(x, k or max(2, int(n**0.5))))
    if name in ("dbscan", "auto") and n <= DBSCAN_ROWS:
        found = _local(df, key, vec, dbscan_labels)
        if name == "dbscan" or found.select("cluster").distinct().count() >= 2:
            return found
    if name not in ("dbscan", "auto", "hierarchical", "kmeans_elbow"):
        raise ValueError(f"unknown method {method!r}")
    return kmeans_elbow(df, key, vec, seed)


def subdivide(df: DataFrame, key: str, vec: str, fold: str, most: int = 2000, seed: int = 0, passes: int = 3) -> DataFrame:
    """``df`` (key, vec, fold) with folds of more than ``most`` rows divided: into ceil(n / (0.85 most)) parts by k-means, up to
    three times; what is then over 1.5 ``most`` is cut by hash.  Parts are named ``{fold}sNNNN``."""
    rows = df.select(key, vec, F.col(fold).cast("string").alias(fold))
    for _ in range(passes):
        large = [(r[0], r[1]) for r in rows.groupBy(fold).agg(F.count("*").alias("n")).where(F.col("n") > most).collect()]
        if not large:
            return rows
        out = rows.where(~F.col(fold).isin([f for f, _ in large]))
        for name, n in sorted(large):
            part = rows.where(F.col(fold) == name)
            labels = kmeans(part, key, vec, int(-(-n // (0.85 * most))), seed)
            out = out.unionByName(part.join(labels, key).withColumn(fold, F.format_string("%ss%04d", F.lit(name), F.col("cluster"))).drop("cluster"))
        rows = out
    sizes = rows.groupBy(fold).agg(F.count("*").alias("__n"))
    parts = F.ceil(F.col("__n") / most)
    cut = F.when(F.col("__n") > 1.5 * most, F.format_string("%ss%04d", F.col(fold), F.pmod(F.xxhash64(key), parts))).otherwise(F.col(fold))
    return rows.join(sizes, fold).withColumn(fold, cut).drop("__n")
