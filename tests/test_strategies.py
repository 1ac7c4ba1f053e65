"""Placement, chosen members, communities, strategies and graph files against plain versions."""

from __future__ import annotations

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel import catalog
from tessel.operators import placement, refine, splits, strategies
from tessel.operators.components import connected_components
from tessel.operators.graphs import contingency_clusters, kmer_sets
from tessel.sources import graph

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def genome(spark, seed=3):
    rng = random.Random(seed)
    contigs = [(f"G{i % 2}", f"c{i}", "".join(rng.choice("ACGTN") for _ in range(rng.choice((60, 200, 400))))) for i in range(6)]
    genes, gaps = [], []
    for g, c, s in contigs:
        taken, at = [], 1
        while at < len(s):
            size = rng.randint(1, 25)
            if at + size - 1 > len(s):
                break
            taken.append((at, at + size - 1))
            genes.append((g, c, f"x{len(genes)}", at, at + size - 1))
            at += size + rng.randint(0, 60)
        cursor = 1
        for a, b in [*taken, (len(s) + 1, len(s) + 1)]:
            if cursor < a:
                gaps.append((g, c, cursor, a - 1))
            cursor = b + 1
    make = spark.createDataFrame
    return contigs, genes, gaps, make(contigs, "genome string, chrom string, seq string"), make(genes, "genome string, chrom string, gene string, start long, end long"), make(gaps, "genome string, chrom string, start long, end long")


def taken_from(free, start, end):
    out = []
    for a, b in free:
        out += [(a, b)] if end < a or start > b else [(x, y) for x, y in ((a, start - 1), (end + 1, b)) if x <= y]
    return out


def matched(contigs, genes, gaps, seed, tolerance=0.03):
    """One window at a time, letter by letter."""
    out, placed = {}, collections.Counter()
    share = lambda s: sum(x in "GC" for x in s) / max(sum(x in "ACGT" for x in s), 1)
    for g, c, s in sorted(contigs):
        free = sorted((a, b) for x, y, a, b in gaps if (x, y) == (g, c))
        for _, name, a, b in sorted(((a - b - 1, n, a, b) for x, y, n, a, b in genes if (x, y) == (g, c)), key=lambda r: r[:2]):
            n, aim, best = b - a + 1, share(s[a - 1 : b]), None
            for low, high in free:
                if high - low + 1 < n:
                    continue
                first = low + (seed * 31 + placed[g] * 17 + fnv(name) % 10007) % (high - low + 2 - n)
                starts = list(range(first, high - n + 2, max(1, int(n * 0.25), seed % 97)))
                for at in starts if low in starts else [low, *starts]:
                    off = abs(share(s[at - 1 : at - 1 + n]) - aim)
                    if off <= tolerance or best is None or off < best[0]:
                        best = (off, at)
                    if off <= tolerance:
                        break
                if best and best[0] <= tolerance:
                    break
            if best:
                placed[g] += 1
                out[name] = (g, c, f"NC_{g}_{c}_{placed[g]:06d}", best[1], best[1] + n - 1)
                free = taken_from(free, best[1], best[1] + n - 1)
    return out


@pytest.mark.parametrize("seed", [5, 42, 200])
def test_matched_windows_equal_a_plain_version(spark, seed):
    contigs, genes, gaps, c, g, f = genome(spark, seed)
    want = matched(contigs, genes, gaps, seed)
    got = placement.match_windows(g, f, c, seed=seed).collect()
    assert len(got) == len(want) > 20 and {r.gene: (r.genome, r.chrom, r.id, r.start, r.end) for r in got} == want


def test_random_windows_lie_free_and_apart(spark):
    contigs, genes, gaps, _, g, f = genome(spark)
    got = placement.random_placement(g, f, "gene", 7, most=9).collect()
    length = {n: min(b - a + 1, 9) for _, _, n, a, b in genes}
    free = collections.defaultdict(list)
    for x, y, a, b in gaps:
        free[x, y].append((a, b))
    assert got and all(r.end - r.start + 1 == length[r.id] and r.name == f"NC_{r.genome}_{r.id}" for r in got)
    for r in got:  # each lies in what the others leave
        others = free[r.genome, r.chrom]
        for s in got:
            if s.id != r.id and (s.genome, s.chrom) == (r.genome, r.chrom):
                others = taken_from(others, s.start, s.end)
        assert any(a <= r.start and r.end <= b for a, b in others)
    # what was left out fits nowhere
    for x, y, n, _, _ in genes:
        if n not in {r.id for r in got}:
            others = free[x, y]
            for s in got:
                if (s.genome, s.chrom) == (x, y) and s.id < n:
                    others = taken_from(others, s.start, s.end)
            assert all(b - a + 1 < length[n] for a, b in others)
    again = placement.random_placement(g.repartition(5), f.repartition(3), "gene", 7, most=9).collect()
    assert sorted(again) == sorted(got) and sorted(placement.random_placement(g, f, "gene", 8, most=9).collect()) != sorted(got)
    assert placement.random_placement(g, f.limit(0), "gene").count() == 0 == placement.random_placement(g.limit(0), f, "gene").count()


def test_gene_windows(spark):
    contigs, genes, _, c, g, _ = genome(spark)
    named = g.withColumns({"name": F.concat(F.lit("n"), "gene"), "strand": F.lit("+")})
    values = spark.createDataFrame([("nx1", 4.0), ("x2", 5.0), ("x1", 9.0)], "key string, tpm double")
    got = placement.gene_windows(named, c, values, 3, 11).collect()
    seqs = {(g, c): s for g, c, s in contigs}
    own = {r.id: r for r in got if r.kind == "gene"}
    assert len(own) == len(genes) and (own["x1"].tpm, own["x2"].tpm, own["x3"].tpm) == (4.0, 5.0, 0.0)
    assert all(r.seq == seqs[r.genome, r.chrom][r.start - 1 : r.end] for r in got)
    assert all((own[n].start, own[n].end) == (max(1, a - 3), min(len(seqs[g, c]), b + 3)) for g, c, n, a, b in genes)
    other = [r for r in got if r.kind == "non_coding"]
    assert other and all(o.end < r.start or r.end < o.start for o in other for r in got if r is not o and (r.genome, r.chrom) == (o.genome, o.chrom))


def chosen(nodes, edges, least_nodes, least_edges):
    """The pass over orthogroups, one node at a time."""
    sp, marked = {n: s for n, s, _ in nodes}, {n: m for n, _, m in nodes}
    edges = {(min(u, v), max(u, v), r) for u, v, r in edges if u != v and u in sp and v in sp}

    def parts(kinds):
        label = {n: n for n in sp}
        for _ in sp:
            before = dict(label)
            for u, v, r in edges:
                if r in kinds:
                    label[u] = label[v] = min(label[u], label[v])
            if label == before:
                return label
        return label

    comp, og = parts(("ortholog", "paralog")), parts(("ortholog",))
    para = collections.defaultdict(set)
    for u, v, r in edges:
        if r == "paralog":
            para[u].add(v)
            para[v].add(u)
    out = set()
    for c in set(comp.values()):
        members = [n for n in sp if comp[n] == c]
        if len(members) < least_nodes or sum(r == "paralog" and comp[u] == c for u, _, r in edges) < least_edges:
            continue
        groups = collections.defaultdict(list)
        for n in members:
            groups[og[n]].append(n)
        masked = set()
        for k in sorted(groups, key=lambda k: (-sum(11_000 + len(para[n]) for n in groups[k]), k)):
            if groups[k][0] in masked:
                continue
            for s in {sp[n] for n in groups[k]}:
                n = min((n for n in groups[k] if sp[n] == s), key=lambda n: (-len(para[n]), n))
                if marked[n]:
                    out.add((c, n, "ortholog"))
            masked |= set(groups[k])
            while near := [v for n in groups[k] for v in para[n] if v not in masked]:
                d = min(near, key=lambda n: (-len(para[n]), n))
                if marked[d]:
                    out.add((c, d, "paralog"))
                masked |= set(groups[og[d]])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chosen_members_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    nodes = [(i, rng.choice("abc"), "m" if rng.random() < 0.8 else rng.choice(("", None))) for i in range(160)]
    block = lambda: rng.randrange(4) * 40
    edges = [(b + rng.randrange(40), b + rng.randrange(42), rng.choice(("ortholog", "paralog", "paralog"))) for b in (block() for _ in range(150))]
    want = chosen(nodes, edges, 4, 2)
    members, summary = refine.extract_clusters(spark.createDataFrame(nodes, "node long, species string, marked string"), spark.createDataFrame(edges, "u long, v long, relation string"), 4, 2)
    assert {(r.component, r.node, r.role) for r in members.collect()} == want and {"ortholog", "paralog"} == {r for *_, r in want}
    for r in summary.collect():
        mine = [x for x in want if x[0] == r.component]
        assert (r.n_written_orthologs, r.n_written_paralogs) == tuple(sum(x[2] == k for x in mine) for k in ("ortholog", "paralog"))
        assert sum(int(x.split(":")[1]) for x in r.nodes_per_species.split(";")) == r.n_nodes


def test_chosen_members_of_nothing(spark):
    nodes, edges = spark.createDataFrame([], "node long, species string, marked string"), spark.createDataFrame([], "u long, v long, relation string")
    members, summary = refine.extract_clusters(nodes, edges)
    assert members.count() == summary.count() == 0


def modularity(label, u, v, w, resolution=1.0):
    total, degree, inside = w.sum(), collections.Counter(), 0.0
    for a, b, x in zip(u, v, w, strict=True):
        degree[label[a]] += x
        degree[label[b]] += x
        inside += x * (label[a] == label[b])
    return inside / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values())


def test_louvain():
    cliques = [(i, j, 1.0) for c in range(4) for i in range(c * 6, c * 6 + 6) for j in range(i + 1, c * 6 + 6)]
    u, v, w = map(np.array, zip(*cliques, *[(c * 6, (c * 6 + 6) % 24, 0.5) for c in range(4)], strict=True))
    label = refine.louvain(24, u, v, w)
    assert len(set(zip(label, np.arange(24) // 6, strict=True))) == 4 == len(set(label))
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 60, (2, 300))
    keep = u != v
    u, v, w = u[keep], v[keep], rng.random(keep.sum())
    label = refine.louvain(60, u, v, w)
    got = modularity(label, u, v, w)
    assert got > 0.1
    for i in range(60):  # no single move gains: a local optimum, as the method promises for the last level's nodes or better
        for c in set(label):
            moved = label.copy()
            moved[i] = c
            assert modularity(moved, u, v, w) <= got + 0.02
    assert list(refine.louvain(3, np.array([], int), np.array([], int), np.array([]))) == [0, 1, 2]


def test_large_clusters_are_divided(spark):
    pairs = [(c * 10 + i, c * 10 + j, 3) for c in range(3) for i in range(10) for j in range(i + 1, 10)] + [(0, 10, 1), (10, 20, 1)]
    clusters = spark.createDataFrame([(i, 0) for i in range(31)] + [(i, 100) for i in range(100, 104)] + [(i, 200) for i in range(200, 220)], "region long, cluster long")
    edges = spark.createDataFrame([*pairs, (100, 101, 5)], "u long, v long, n long")
    got = {r.region: r.cluster for r in refine.refine_large(clusters, edges, 12).collect()}
    assert len(got) == 55
    assert all(got[i] == i // 10 * 10 for i in range(30)) and got[30] == 30  # 30 has no edge
    assert {got[i] for i in range(100, 104)} == {100} and {got[i] for i in range(200, 220)} == {200}


def ids(spark, n=60):
    return spark.createDataFrame([(i, f"G{i % 3}", f"chr{i % 5}") for i in range(n)], "ID long, genome string, chr string")


def test_every_strategy_places_every_row(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    seqs = spark.createDataFrame([(i, base[i % 6][i % 7 :]) for i in range(60)], "ID long, seq string")
    make = spark.createDataFrame
    tables = {
        "sequences": seqs, "groups": make([(i, i % 12) for i in range(60)], "ID long, group long"), "hits": make([(i, i + 6) for i in range(54)], "u long, v long"),
        "clusters": make([(i % 9, i) for i in range(50)], "representative long, member long"), "genes": make([(i, i % 9, i % 4) for i in range(40)], "ID long, orthogroup long, degree long"),
        "scores": make([(i, i / 60, 0.5, 1 - i / 60) for i in range(60)], "ID long, train double, val double, test double"),
    }
    folds = make([(i, " Zero-shot_validation" if i % 10 == 0 else str(i % 10)) for i in range(60)], "ID long, fold string")
    options = {"kmer": {"k": 2, "method": "kmeans", "clusters": 6}, "gc": {"method": "kmeans", "clusters": 6}, "pangenome": {"k": 8}}
    whole = {"gc", "kmer", "pangenome", "blastp", "mmseqs", "loco"}
    assert set(strategies.STRATEGIES) == {"random", "gc", "kmer", "hashfrag", "pangenome", "blastp", "mmseqs", "paralogs_only", "loco", "scores", "vgae", "gcn"}
    for name in sorted(strategies.STRATEGIES):
        got = {r.ID: (r.train_test, r.fold) for r in strategies.split(name, ids(spark), folds=folds, tables=tables, **options.get(name, {})).collect()}
        assert len(got) == 60, name
        assert all((got[i][0] == "zsv") == (i % 10 == 0) for i in range(60)), name
        rest = {i: x for i, x in got.items() if x[0] != "zsv"}
        assert {x[0] for x in rest.values()} == {"train", "val", "test"}, name
        if name in whole:
            roles = collections.defaultdict(set)
            for role, fold in rest.values():
                roles[fold].add(role)
            assert all(len(x) == 1 for x in roles.values()), name
        if name in ("random", "scores", "vgae", "gcn"):
            assert all(fold == str(i % 10) for i, (_, fold) in rest.items()), name


def test_strategies_refuse_and_can_be_added(spark):
    with pytest.raises(ValueError, match="no strategy"):
        strategies.split("guess", ids(spark))
    with pytest.raises(ValueError, match="needs the table 'hits'"):
        strategies.split("blastp", ids(spark))

    @strategies.strategy("odd")
    def _(q):
        return q.ids.select("ID", F.when(F.col("ID") % 2 == 1, "train").otherwise("test").alias("train_test"), F.lit("0").alias("fold"))

    try:
        assert {r.train_test for r in strategies.split("odd", ids(spark)).where("ID % 2 = 1").collect()} == {"train"}
    finally:
        del strategies.STRATEGIES["odd"]


def test_own_ratios_of_a_strategy(spark):
    clusters = spark.createDataFrame([(i, i) for i in range(100)], "representative long, member long")
    n = collections.Counter(r.train_test for r in strategies.split("mmseqs", ids(spark, 100), tables={"clusters": clusters}).collect())
    assert n == {"train": 60, "test": 20, "val": 20}
    n = collections.Counter(r.train_test for r in strategies.split("mmseqs", ids(spark, 100), tables={"clusters": clusters}, ratios=splits.Ratios(8, 1, 1)).collect())
    assert n == {"train": 80, "test": 10, "val": 10}


def test_graph_files_and_stages(spark, tmp_path):
    nodes, edges = spark.range(4).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1, 2.0)], "u long, v long, w double")
    graph.write_graph(f"file://{tmp_path}/g", nodes, edges, {"k": 5})
    n, e, meta = graph.read_graph(spark, f"file://{tmp_path}/g")
    assert (n.count(), e.collect(), meta) == (4, edges.collect(), {"k": 5, "n_nodes": 4, "n_edges": 1})
    made = []

    def make():
        made.append(1)
        return nodes

    path = f"file://{tmp_path}/stage"
    assert graph.once(spark, path, make).count() == graph.once(spark, path, make).count() == 4 and len(made) == 1
    os.remove(tmp_path / "stage" / "_SUCCESS")  # as if killed before the end
    assert graph.once(spark, path, make).count() == 4 and len(made) == 2


def test_a_folder_as_a_stream(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    out = graph.follow(spark, f"file://{tmp_path}/in", "id long")

    def run():
        out.select("id").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    assert run() == list(range(5))
    spark.range(5, 8).write.mode("append").parquet(f"file://{tmp_path}/in")
    assert run() == list(range(8))  # what was read before is not read again


def test_tensor_files_refuse_other_forms(spark, tmp_path):
    import json
    import struct

    header = json.dumps({"m": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "h": {"dtype": "F16", "shape": [2, 2], "data_offsets": [16, 24]}, "__metadata__": {"a": "b"}}).encode()
    (tmp_path / "t").write_bytes(struct.pack("<Q", len(header)) + header + struct.pack("<4f", 1, 2, 3, 4) + bytes(8))
    path = f"file://{tmp_path}/t"
    assert [(r.tensor, r.row, r.vec) for r in graph.read_tensors(spark, path).orderBy("row").collect()] == [("m", 0, [1.0, 2.0]), ("m", 1, [3.0, 4.0])]
    with pytest.raises(Exception, match="not a matrix"):
        graph.read_tensors(spark, path, "h").collect()
    with pytest.raises(Exception, match="no tensor"):
        graph.read_tensors(spark, path, "z").collect()


@needs_tables
def test_size_normalisation(spark):
    rows = catalog.QUERIES["m09_size_normalised"](spark, DATA).collect()
    x = np.array([[1.0, math.log(r.n), r.gap] for r in rows])
    y = np.array([r.y for r in rows])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([r.expected for r in rows], fit, rtol=1e-6) and np.allclose([r.z for r in rows], (y - fit) / np.std(y - fit, ddof=1), atol=1e-6)


@needs_tables
def test_projection_keeps_distances(spark):
    from tessel.operators import features

    rows = spark.createDataFrame([(i, f"f{j}", float((i * 7 + j * 3) % 11)) for i in range(12) for j in range(40)], "id long, feature string, value double")
    got = collections.defaultdict(dict)
    for r in features.projected(rows, "id", "feature", "value", 2000, 1).collect():
        got[r.id][r.dim] = r.value
    a = np.array([[got[i][d] for d in range(2000)] for i in range(12)])
    b = np.array([[float((i * 7 + j * 3) % 11) for j in range(40)] for i in range(12)])
    near = lambda m: ((m[:, None] - m[None]) ** 2).sum(-1)[np.triu_indices(12, 1)]
    rough = near(b) > 0
    assert np.all(np.abs(near(a)[rough] / near(b)[rough] - 1) < 0.25)


def test_louvain_of_shared_members_equals_that_of_all_edges():
    merged = 0
    for seed in range(12):
        rng = np.random.default_rng(seed)
        base = [sorted(set((rng.integers(0, 6, 5) + 6 * (i % 3)).tolist()) | ({99} if i % 4 == 0 else set())) for i in range(9)]
        of = rng.permutation(np.append(np.arange(9), rng.integers(0, 9, 50)))
        pairs = [(i, j, float(len(set(base[of[i]]) & set(base[of[j]])))) for i in range(len(of)) for j in range(i + 1, len(of))]
        u, v, w = map(np.array, zip(*[p for p in pairs if p[2]], strict=True))
        for resolution in (1.0, 2.5, 6.0):
            want = refine.louvain(len(of), u, v, w, resolution, seed)
            got = refine.louvain_shared(of, base, resolution, seed)
            assert got.tolist() == want.tolist(), (seed, resolution)
            merged += 1 < len(set(want.tolist())) < len(of)
    assert merged > 10


def test_many_regions_alike_are_refined(spark):
    """20 000 regions of few kinds: 2 * 10**8 pairs, of which none has to be made."""
    sets = spark.range(20_000).selectExpr("id as region", "explode(array(concat('a', id % 5), concat('b', id % 7), 'all')) as kmer")
    clusters = spark.range(20_000).selectExpr("id as region", "0L as cluster")
    got = {r.region: r.cluster for r in refine.refine_shared(clusters, sets, 10).collect()}
    assert len(got) == 20_000 and len(set(got.values())) == 20_000


def test_tables_of_regions_are_not_broadcast(spark, tmp_path):
    """Files of regions pack to a few bytes a row; what Spark thinks small by them would fill the driver."""
    spark.range(3000).selectExpr("id as region", "concat(repeat('ACGT', 4), id % 7) as seq").write.parquet(str(tmp_path / "seqs"))
    seqs = spark.read.parquet(str(tmp_path / "seqs"))
    found = contingency_clusters(seqs, "region", "seq", 8)
    sets = kmer_sets(seqs, "region", "seq", 8)
    for df in (found, refine.refine_shared(found, sets, 10), connected_components(seqs.selectExpr("region as u", "region % 7 as v"))):
        assert df.count() == 3000
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
