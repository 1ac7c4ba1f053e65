"""Queries over whole tables against brute force, where SQL would be too slow or older queries read less."""

from __future__ import annotations

import collections
import os
import random

import pytest

from tessel import catalog
from tessel.operators.components import connected_components

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def least_nodes(edges):
    """The least node of each node's component, by union-find."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(500, 500)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = least_nodes(edges)
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert len(set(want.values())) > 10


@needs_tables
def test_graph_of_all_lineitems(spark):
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()
    edges = {(2 * r.l_orderkey, 2 * r.l_suppkey + 1) for r in lines}
    want = least_nodes(edges)
    sizes = sorted(collections.Counter(want.values()).values(), reverse=True)
    got = catalog.QUERIES["g01_components_whole"](spark, DATA).collect()
    assert len(got) == len(want) == len({r.l_orderkey for r in lines}) + len({r.l_suppkey for r in lines})
    assert {r.node: r.component for r in got} == want
    (r,) = catalog.QUERIES["g08_graph_statistics_whole"](spark, DATA).collect()
    assert (r.n_edges, r.n_nodes, r.n_components, r.largest, r.median_size, r.n_singletons) == (len(edges), len(want), len(sizes), sizes[0], sizes[len(sizes) // 2], sizes.count(1))


@needs_tables
def test_sizes_of_all_groups(spark):
    n = {r.l_orderkey: r["count"] + 4 for r in spark.read.parquet(f"{DATA}/lineitem.parquet").groupBy("l_orderkey").count().collect()}
    got = {r.l_orderkey: (r.n_train, r.n_test, r.n_val) for r in catalog.QUERIES["l01_sizes_by_ratio_whole"](spark, DATA).collect()}
    assert max(n.values()) > 11 and got.keys() == n.keys()
    for key, sizes in got.items():
        rest = sorted(range(3), key=lambda r: (-(n[key] * (3, 1, 1)[r] % 5), r))
        whole = [n[key] * w // 5 for w in (3, 1, 1)]
        for r in rest[: n[key] - sum(whole)]:
            whole[r] += 1
        assert sizes == tuple(whole)


def test_first_in_the_file_wins(spark, tmp_path):
    """Rows of one part, order and line: the first one stays, in whatever file or task the others are."""
    rows = [(7, k % 50, 1000 + k, 3) for k in range(4000)]
    for part in range(2):
        mine = spark.createDataFrame(rows[part * 2000 : part * 2000 + 2000], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1)
        mine.write.parquet(str(tmp_path / f"t{part}"))
        (found,) = (tmp_path / f"t{part}").glob("*.parquet")
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        found.rename(tmp_path / "lineitem.parquet" / f"{part}.parquet")
    got = {r.l_partkey: r.l_suppkey for r in catalog.QUERIES["w06_first_wins"](spark, str(tmp_path)).collect()}
    assert got == {k: 1000 + k for k in range(50)}
