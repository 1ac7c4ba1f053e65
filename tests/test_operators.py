"""Operators without SQL, against plain versions on small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import assembly, audit, checks, clusters, embeddings, expression, metrics, profiles, splits
from tessel.sources import text


def points(spark, seed=1, n=60):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [8, 0, 1], [0, 9, 2]])
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, 0.4, 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>"), rows


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("method", ["kmeans", "k-means", "elbow", "pca", "dbscan", "agglomerative", "auto"])
def test_methods_find_clear_clusters(spark, method):
    df, rows = points(spark)
    found = {r.id: r.cluster for r in clusters.cluster(df, "id", "vec", method, None if method in ("elbow", "dbscan", "auto") else 3, seed=4).collect()}
    assert len(found) == len(rows)
    if method in ("dbscan", "auto"):  # the automatic radius leaves outer rows alone, but joins no two centres
        assert all(len({i % 3 for i in found if found[i] == c}) == 1 for c in set(found.values()))
    else:
        assert same_partition([found[i] for i, _ in rows], [i % 3 for i, _ in rows])


def test_dbscan_equals_a_plain_version():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (40, 2)), rng.uniform(-20, 20, (15, 2))))
    got = clusters.dbscan_labels(x, 1.0, 4, step=7)
    near = [[j for j in range(len(x)) if np.linalg.norm(x[i] - x[j]) <= 1.0] for i in range(len(x))]
    core = [len(m) >= 4 for m in near]
    for i in range(len(x)):
        for j in near[i]:
            if core[i] and core[j]:
                assert got[i] == got[j]
        if not core[i]:
            assert any(got[i] == got[j] for j in near[i] if core[j]) or (got == got[i]).sum() == 1
    assert len({got[i] for i in range(len(x)) if core[i]}) >= 2


def test_average_linkage_and_silhouette_equal_plain_versions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 2))
    groups = [[i] for i in range(len(x))]
    d = lambda a, b: np.mean([np.linalg.norm(x[i] - x[j]) for i in a for j in b])
    while len(groups) > 5:
        _, i, j = min((d(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups.pop(i)
    want = np.zeros(len(x), int)
    for k, g in enumerate(groups):
        want[g] = k
    got = clusters.linkage_labels(x, 5)
    assert same_partition(got.tolist(), want.tolist())
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if want[j] == want[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = np.mean([np.linalg.norm(x[i] - x[j]) for j in own])
        b = min(np.mean([np.linalg.norm(x[i] - x[j]) for j in g]) for k, g in enumerate(groups) if k != want[i])
        s.append((b - a) / max(a, b))
    assert clusters.silhouette(x, want) == pytest.approx(np.mean(s))


def test_elbow_choice_and_division(spark):
    assert clusters.elbow({2: 100.0, 3: 20.0, 4: 18.0, 5: 17.0}) == 3
    df, _ = points(spark, n=90)
    assert clusters.choose_clusters(df, "id", "vec", 4, 2, 5) == 3
    folds = df.withColumn("fold", F.when(F.col("id") < 80, "big").otherwise("small"))
    out = {r.id: r.fold for r in clusters.subdivide(folds, "id", "vec", "fold", 30, 4).collect()}
    sizes = {f: list(out.values()).count(f) for f in set(out.values())}
    assert len(out) == 90 and sizes["small"] == 10 and max(sizes.values()) <= 45 and all(f == "small" or f.startswith("bigs") for f in sizes)


def test_transforms_procrustes_and_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4)) + 3
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    y = x @ turn.T
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(50)], "id long, x array<double>, y array<double>").repartition(3)
    stats = embeddings.train_stats(df, "x")
    cov = np.cov(x.T) + 1e-3 * np.eye(4)
    assert np.allclose(stats.mean, x.mean(axis=0)) and np.allclose(stats.cov, cov) and np.allclose(stats.whiten @ cov @ stats.whiten, np.eye(4))
    for metric in ("cosine", "centered_cosine", "l2_euclidean", "whitened_cosine", "row_centered"):
        u = embeddings.transformed(x, stats, metric)
        assert np.allclose((u * u).sum(axis=1), 1)
        got = {r.id: r.vec for r in embeddings.transform_rows(df.select("id", "x"), "x", stats, metric).collect()}
        assert np.allclose([got[i] for i in range(50)], u)
        near = {r.id: r.max_similarity for r in embeddings.max_similarity(df.where("id < 10"), df.where("id >= 10"), "id", "x", stats, metric, block_rows=15).collect()}
        assert np.allclose([near[i] for i in range(10)], (u[:10] @ u[10:].T).max(axis=1))
    assert np.allclose(embeddings.procrustes(df, "x", "y"), turn)
    assert embeddings.mean_matched_distance(df, "x", "y", turn) < 1e-9
    assert embeddings.linear_cka(df, "x", "y") == pytest.approx(1.0) and embeddings.linear_cka(df, "x", "x") == pytest.approx(1.0)
    empty = embeddings.max_similarity(df.where("id < 2"), df.where("false"), "id", "x", stats, "cosine").collect()
    assert [r.max_similarity for r in empty] == [float("-inf")] * 2


def test_greedy_roles_of_the_stated_cases(spark):
    fold = lambda sizes: spark.createDataFrame([(f"f{i}", n) for i, n in enumerate(sizes)], "fold string, size long")
    roles = {r.fold: r.train_test for r in splits.greedy_roles(fold([100] * 10), "fold", "size").collect()}
    assert sorted(roles.values()) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2
    assert [r.train_test for r in splits.greedy_roles(fold([5] * 5), "fold", "size").orderBy("fold").collect()][0] == "train"
    assert [r.train_test for r in splits.greedy_roles(fold([5, 9]), "fold", "size").orderBy("fold").collect()] == ["train", "val"]
    assert splits.greedy_roles(fold([]), "fold", "size").count() == 0


def test_more_folds_than_the_driver_deals_out(spark):
    rng = random.Random(6)
    rows = [(f"f{i}", rng.choice((1, 1, 1, 2, 3, 50, rng.randrange(400)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "fold string, size long").repartition(5)
    want = {tuple(r) for r in splits.greedy_roles(df, "fold", "size").collect()}
    have, order = dict.fromkeys(("test", "train", "val"), 0), {}
    for f, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        total = sum(have.values()) + n
        cost = {o: sum(abs((have[p] + n * (p == o)) / max(total, 1) - (0.6 if p == "train" else 0.2)) for p in have) for o in have}
        order[f] = next(o for o in have if cost[o] <= min(cost.values()) + 1e-12)
        have[order[f]] += n
    assert want == {(f, n, order[f]) for f, n in rows}
    assert {tuple(r) for r in splits.greedy_roles(df, "fold", "size", most_folds=20).collect()} == want


def test_quotas_and_their_cut(spark):
    assert splits.quotas(3) == {"train": 1, "test": 1, "val": 1} and splits.quotas(10) == {"train": 6, "test": 2, "val": 2} and splits.quotas(4) == {"train": 2, "test": 1, "val": 1}
    rng = random.Random(3)
    values = [(i, float(rng.choice([1, 1, 2, 3, rng.random() * 9]))) for i in range(3000)]
    df = spark.createDataFrame(values, "k long, v double")
    for n in (0, 1, 700, 2999, 3000):
        want = {k for k, _ in sorted(values, key=lambda r: (-r[1], r[0]))[:n]}
        assert {r.k for r in splits._greatest(df, "v", "k", n).where("__top").collect()} == want


def test_statistics_equal_plain_versions(spark):
    rng = random.Random(7)
    rows = [(i, "ab"[i % 2], rng.randrange(12) / 2, rng.randrange(9) / 2, rng.randrange(2)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, run string, x double, y double, label int")
    xs = {r: sorted(v[2] for v in rows if v[1] == r) for r in "ab"}
    points_ = sorted({v for r in xs.values() for v in r})
    gap = max(abs(np.searchsorted(xs["a"], p, "right") / 40 - np.searchsorted(xs["b"], p, "right") / 40) for p in points_)
    assert metrics.ks_similarity(df, "run", "x").head().similarity == pytest.approx(1 - gap)
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    rank = lambda v: np.argsort(np.argsort([(a, i) for i, a in enumerate(v)], axis=0)[:, 0])
    rank = lambda v: {i: k for k, i in enumerate(sorted(range(len(v)), key=lambda i: (v[i], i)))}
    rx, ry = ([rank(v)[i] for i in range(len(v))] for v in (x, y))
    assert metrics.ordinal_spearman(df, "x", "y", "id").head()[0] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    r = df.agg(metrics.damped_pearson(F.col("x"), F.col("y")).alias("r"), metrics.accuracy(F.col("label"), F.col("x"), 3.0).alias("a"), metrics.lower_median(F.col("x")).alias("m")).head()
    cx, cy = x - x.mean(), y - y.mean()
    assert r.r == pytest.approx((cx * cy).sum() / (np.sqrt((cx**2).sum() * (cy**2).sum()) + 1e-8))
    assert r.a == pytest.approx(np.mean([(v[2] >= 3.0) == (v[4] == 1) for v in rows])) and r.m == sorted(x)[39]


def test_readers_take_odd_files(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return f"file://{tmp_path}/{name}"

    assert [(r.id, r.seq) for r in text.read_fasta(spark, put("a.fa", ">a b c\nac\ngt\n\n>x|y| |\nNN\n>empty\n")).collect()] == [("a", "ACGT"), ("y", "NN"), ("empty", "")]
    assert text.read_marked(spark, put("m.fa", ">a|b|c\nACGT\n")).head().id is None
    rows = text.read_wide(spark, put("w.csv", "g1,g2,g1\n1.5,x,3\n"))
    assert {(r.gene, r.value) for r in rows.collect()} == {("g1", 1.5), ("g2", None)}
    assert {(r.gene, r.value) for r in text.read_wide(spark, put("w2.csv", "g1,g2,g1\n1.5,x,3\n"), keep="last").collect()} == {("g1", 3.0), ("g2", None)}
    with pytest.raises(Exception, match="empty interval"):
        text.read_bed(spark, put("b.bed", "c\t5\t5\n")).collect()
    with pytest.raises(ValueError, match="lacks"):
        text.read_homologies(spark, put("h.tsv", "a\tb\n1\t2\n"))
    with pytest.raises(ValueError, match="columns"):
        text.read_edges(spark, put("e.tsv", "a\tb\n1\t2\n"))


def test_strict_joins_fail(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    seqs, values = spark.createDataFrame([(1, "A")], "id long, seq string"), spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, v double")
    assert assembly.assemble(ids, seqs, values, "id").count() == 1
    with pytest.raises(Exception, match="incomplete id 2"):
        assembly.assemble(ids, seqs, values, "id", strict=True).collect()
    with pytest.raises(ValueError, match="without a match"):
        assembly.checked_left(seqs, values, ["id"])
    with pytest.raises(ValueError, match="fewer"):
        assembly.join_unique(seqs, values, "id", 5)
    assert checks.key_faults(ids, "id").count() == 0
    assert [r.n for r in expression.histogram(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").collect()] == [4]
    assert [r.longest for r in profiles.longest_run(spark.createDataFrame([(1, 1, None), (1, 2, 1.0), (1, 3, 1.0), (1, 5, 1.0)], "g long, p long, v double"), "g", "p", F.col("v") > 0).collect()] == [2]
    assert audit.fold_sizes is not None
