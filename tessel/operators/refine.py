"""Clusters of homologous genes with chosen members, and division of large components by modularity."""

from __future__ import annotations

import collections
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Stored, exchanged
from .components import connected_components
from .graphs import both_ends

#: Most edges of one component that modularity is computed from; the heaviest stay.
MOST_EDGES = 2_000_000


def _groups(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the component of each, named by its least node; nodes without an edge are their own."""
    found = connected_components(edges).select("node", F.col("component").alias("__c"))
    return nodes.join(found, "node", "left").withColumn(name, F.coalesce("__c", "node")).drop("__c")


def _leaders(store: Stored, groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups that a pass in falling score (then name) would reach uncovered, where each reached one covers its neighbours.

    A round takes all groups without an open neighbour before them, which the pass would reach uncovered as well, and covers
    their neighbours, so the result is that of the pass without its order being walked.
    """
    left, out, k = groups.select("grp", "score"), None, 0
    while left.head(1):
        a = left.select(F.col("grp").alias("a"), F.col("score").alias("sa"))
        b = left.select(F.col("grp").alias("b"), F.col("score").alias("sb"))
        behind = links.join(a, "a").join(b, "b").where("sb > sa or (sb = sa and b < a)").select(F.col("a").alias("grp")).distinct()
        found = store.put(left.join(behind, "grp", "left_anti"), f"leaders{k}")
        out = found if out is None else out.unionByName(found)
        covered = links.join(found.select(F.col("grp").alias("a")), "a").select(F.col("b").alias("grp")).unionByName(found.select("grp")).distinct()
        left = store.put(left.join(covered, "grp", "left_anti"), f"left{k}")
        k += 1
    return groups.limit(0).select("grp", "score") if out is None else out


def extract_clusters(nodes: DataFrame, edges: DataFrame, least_nodes: int = 11, least_paralog_edges: int = 6) -> tuple[DataFrame, DataFrame]:
    """Members (component, node, role) that stand for each component, and a summary row per component that has any.

    ``nodes`` are node, species, marked (blank or null: it has no sequence); ``edges`` are u, v, relation.  Orthogroups of a
    component are gone through by falling score, 10 000 per member and 1000 and its paralog degree for each.  One that is not
    covered gives a member per species, that of the greatest paralog degree, and covers each orthogroup with a paralog of
    its own members; of a covered one, the paralog of the greatest degree is a member.  Ties go to the least name.  Chosen
    nodes without a sequence cover what they cover but are not returned.
    """
    store = Stored(nodes.sparkSession, "extract")
    edges = store.put(both_ends(edges.select("u", "v", "relation").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "relation").distinct(), nodes, "node"), "edges")
    para = edges.where("relation = 'paralog'").select("u", "v")
    both = para.unionByName(para.select(F.col("v").alias("u"), F.col("u").alias("v")))
    named = _groups(_groups(nodes.select("node", "species", "marked"), edges, "component"), edges.where("relation = 'ortholog'"), "grp")
    degree = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    named = store.put(named.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))), "named")

    at = named.select(F.col("node").alias("u"), "component")
    linked = edges.join(at, "u").groupBy("component").agg(F.count_if(F.col("relation") == "ortholog").alias("n_ortholog_edges"), F.count_if(F.col("relation") == "paralog").alias("n_paralog_edges"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n_nodes"), F.count_distinct("grp").alias("n_orthogroups")).join(linked, "component", "left")
    sizes = sizes.fillna(0, ["n_ortholog_edges", "n_paralog_edges"]).where((F.col("n_nodes") >= least_nodes) & (F.col("n_paralog_edges") >= least_paralog_edges))
    used = named.join(sizes.select("component"), "component", "left_semi")

    groups = store.put(used.groupBy("grp").agg(F.sum(F.col("degree") + 11_000).alias("score")), "groups")
    # (a, b, node): node of group b has a paralog in group a
    touch = both.join(used.select(F.col("node").alias("u"), F.col("grp").alias("a")), "u").join(used.select(F.col("node").alias("v"), F.col("grp").alias("b"), "degree", "component", "marked"), "v").where("a <> b")
    touch = store.put(touch.select("a", "b", F.col("v").alias("node"), "degree", "component", "marked").distinct(), "touch")
    leaders = store.put(_leaders(store, groups, touch.select("a", "b").distinct()), "leaders")

    own = used.join(leaders.select("grp"), "grp", "left_semi")
    best = Window.partitionBy("grp", "species").orderBy(F.desc("degree"), "node")
    first = own.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("component", "node", "marked", F.lit("ortholog").alias("role"))
    by = touch.join(leaders.select(F.col("grp").alias("a"), "score"), "a").withColumn("__by", F.struct(-F.col("score"), "a"))
    by = by.join(by.groupBy(F.col("b").alias("__b")).agg(F.min("__by").alias("__first")), (F.col("b") == F.col("__b")) & (F.col("__by") == F.col("__first")))
    second = by.groupBy("b").agg(F.min(F.struct(-F.col("degree"), F.col("node"), F.col("component"), F.col("marked"))).alias("x")).select("x.component", "x.node", "x.marked", F.lit("paralog").alias("role"))
    members = store.put(first.unionByName(second).where("trim(marked) <> ''").drop("marked"), "members")

    written = members.groupBy("component").agg(F.count_if(F.col("role") == "ortholog").alias("n_written_orthologs"), F.count_if(F.col("role") == "paralog").alias("n_written_paralogs"))
    per = used.groupBy("component", "species").agg(F.count("*").alias("n")).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("species", "n"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["species"], x["n"].cast("string"))), ";")
    return members, sizes.join(written, "component").join(per, "component").withColumn("nodes_per_species", text).drop("s")


def louvain(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Communities of nodes 0 to n - 1 by greedy modularity: nodes move to the neighbouring community of the greatest gain
    until none moves, then communities become nodes, until nothing merges."""
    total, label, rng = 2.0 * float(np.sum(w)), np.arange(n), np.random.default_rng(seed)
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, x in zip(u.tolist(), v.tolist(), w.tolist(), strict=True):
        links[a][b] = links[a].get(b, 0.0) + x
        links[b][a] = links[b].get(a, 0.0) + x
    degree = np.array([sum(d.values()) for d in links])
    while total > 0:
        mine, weight, moved = list(range(len(links))), degree.copy(), False
        change = True
        while change:
            change = False
            for i in rng.permutation(len(links)).tolist():
                near: dict[int, float] = {}
                for j, x in links[i].items():
                    if j != i:
                        near[mine[j]] = near.get(mine[j], 0.0) + x
                weight[mine[i]] -= degree[i]
                here = mine[i]
                best, gain = here, near.get(here, 0.0) - resolution * degree[i] * weight[here] / total
                for c in sorted(near):
                    g = near[c] - resolution * degree[i] * weight[c] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != here:
                    mine[i], change, moved = best, True, True
        if not moved:
            return label
        place = np.unique(mine, return_inverse=True)[1]
        label = place[label]
        merged: list[dict[int, float]] = [{} for _ in range(int(place.max()) + 1)]
        for i, d in enumerate(links):
            into = merged[place[i]]
            for j, x in d.items():
                into[int(place[j])] = into.get(int(place[j]), 0.0) + x
        degree = np.bincount(place, degree)
        links = merged
    return label


def refine_large(clusters: DataFrame, edges: DataFrame, most: int, weight: str = "n", seed: int = 42, resolution: float | None = None) -> DataFrame:
    """``clusters`` (region, cluster) with clusters of more than ``most`` regions divided into communities.

    ``edges`` are u, v and a weight.  The resolution is the cluster's size over ``most``, doubled once where that finds one
    community only.  A community is named by its least region.  Clusters without an edge stay whole; a cluster's
    ``MOST_EDGES`` heaviest edges count, which bounds what its task holds.
    """
    kind = clusters.schema["region"].dataType.simpleString()
    large = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > most), "cluster")
    ends = large.select(F.col("region").alias("u"), "cluster", "size").join(edges.select("u", "v", F.col(weight).cast("double").alias("w")).where("u <> v"), "u")
    inside = ends.join(large.select(F.col("region").alias("v"), F.col("cluster").alias("__other")), "v").where(F.col("cluster") == F.col("__other")).drop("__other")
    heavy = inside.withColumn("__n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("w"), "u", "v"))).where(F.col("__n") <= MOST_EDGES).drop("__n")

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        names, ends_ = np.unique(rows[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        pair = ends_.reshape(-1, 2)
        scale = resolution or max(1.0, rows["size"].iloc[0] / most)
        label = louvain(len(names), pair[:, 0], pair[:, 1], rows["w"].to_numpy(), scale, seed)
        if label.max() == 0:
            label = louvain(len(names), pair[:, 0], pair[:, 1], rows["w"].to_numpy(), 2 * scale, seed)
        least = pd.Series(names).groupby(label).transform("min") if label.max() else pd.Series([rows["cluster"].iloc[0]] * len(names))
        return pd.DataFrame({"region": names, "__part": least, "__whole": rows["cluster"].iloc[0]})

    return _divided(clusters, heavy.groupBy("cluster").applyInPandas(divide, f"region {kind}, __part {kind}, __whole {clusters.schema['cluster'].dataType.simpleString()}"))


class _Shared:
    """Weights between nodes that are alike by class: how many k-mers two classes share.  Rows are made when asked for."""

    def __init__(self, sets: list[list], most_kept: int = 5_000_000) -> None:
        self.sets, self.most, self.kept, self.rows = sets, most_kept, 0, {}
        self.having: dict = {}
        for i, s in enumerate(sets):
            for x in s:
                self.having.setdefault(x, []).append(i)

    def row(self, i: int) -> dict[int, int]:
        """Weight to a node of each class that shares a k-mer; for the own class, to another node of it."""
        if i not in self.rows:
            found: dict[int, int] = {}
            for x in self.sets[i]:
                for j in self.having[x]:
                    found[j] = found.get(j, 0) + 1
            if self.kept + len(found) > self.most:
                return found
            self.rows[i], self.kept = found, self.kept + len(found)
        return self.rows[i]


def louvain_shared(of: np.ndarray, sets: list[list], resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """``louvain`` of the nodes whose classes are ``of``, where an edge's weight is how many members two nodes' sets share.

    The edges are never made.  Communities made up alike have the same gain, so one of each kind, the least, is weighed;
    what is decided is what ``louvain`` decides on all edges.
    """
    shared, rng = _Shared(sets), np.random.default_rng(seed)
    many = np.bincount(of, minlength=len(sets))
    each = [float(sum(x * int(many[j]) for j, x in shared.row(i).items()) - len(s)) for i, s in enumerate(sets)]
    label, total = np.arange(len(of)), float(sum(d * int(n) for d, n in zip(each, many, strict=True)))
    parts: list[tuple] = [((i, 1),) for i in of.tolist()]  # what each node is made of: classes and how many of each
    while total > 0:
        links: dict[tuple, dict[int, int]] = {}
        weigh = {p: sum(each[i] * n for i, n in p) for p in dict.fromkeys(parts)}
        mine, moved = list(range(len(parts))), False
        kind: list[tuple] = list(parts)  # of each community; () for an empty one
        ids: dict[tuple, list[int]] = {}  # heaps of communities by kind; some have changed since
        live: dict[tuple, int] = {}
        on: dict[int, set[tuple]] = {}
        weight: dict[tuple, float] = {(): 0.0}

        def turn(c: int, new: tuple) -> None:
            old = kind[c]
            if old:
                live[old] -= 1
                if not live[old]:
                    for i, _ in old:
                        on[i].discard(old)
            kind[c] = new
            if new:
                if not live.get(new):
                    for i, _ in new:
                        on.setdefault(i, set()).add(new)
                    weight[new] = sum(each[i] * n for i, n in new)
                live[new] = live.get(new, 0) + 1
                heapq.heappush(ids.setdefault(new, []), c)

        first, kind = kind, [()] * len(kind)
        for c, k in enumerate(first):
            turn(c, k)
        change, state, stays = True, 0, {}
        while change:
            change = False
            for i in rng.permutation(len(parts)).tolist():
                here, part = mine[i], parts[i]
                if stays.get((part, kind[here])) == state and kind[here] == part:
                    continue  # one alike, alone as well, stayed and nothing has moved since
                if part not in links:
                    row: dict[int, int] = {}
                    for j, n in part:
                        for k, x in shared.row(j).items():
                            row[k] = row.get(k, 0) + x * n
                    links[part] = row
                row, was = links[part], kind[here]
                left = dict(was)
                for j, n in part:
                    left[j] -= n
                rest = tuple((j, n) for j, n in left.items() if n)
                near: dict[tuple, float] = {}
                for k, x in row.items():
                    for s in on.get(k, ()):
                        near[s] = near.get(s, 0.0) + x * next(n for j, n in s if j == k)
                options = []
                for s, x in near.items():
                    heap = ids[s]
                    while kind[heap[0]] != s:
                        heapq.heappop(heap)
                    at = heap[0]
                    if at == here:  # the next of the same kind
                        heapq.heappop(heap)
                        while heap and kind[heap[0]] != s:
                            heapq.heappop(heap)
                        at = heap[0] if heap else -1
                        heapq.heappush(heap, here)
                        if at == here:
                            at = -1
                    if at >= 0:
                        options.append((at, x - resolution * weigh[part] * weight[s] / total))
                inside = sum(row.get(j, 0) * n for j, n in rest)
                best, gain = here, inside - resolution * weigh[part] * sum(each[j] * n for j, n in rest) / total
                for c, g in sorted(options):
                    if g > gain + 1e-12:
                        best, gain = c, g
                if best == here:
                    stays[part, was] = state
                    continue
                turn(here, rest)
                more = dict(kind[best])
                for j, n in part:
                    more[j] = more.get(j, 0) + n
                turn(best, tuple(sorted(more.items())))
                mine[i], change, moved, state = best, True, True, state + 1
        if not moved:
            return label
        place = np.unique(mine, return_inverse=True)[1]
        label = place[label]
        parts = [kind[c] for c in np.unique(mine).tolist()]
    return label


def refine_shared(clusters: DataFrame, sets: DataFrame, most: int, seed: int = 42, resolution: float | None = None) -> DataFrame:
    """``refine_large`` by how many k-mers two regions share; ``sets`` (region, kmer), distinct, are given in place of edges.

    All pairs of regions count: regions with the same k-mers are one class, and a task holds a cluster's classes and regions.
    """
    kind = clusters.schema["region"].dataType.simpleString()
    clusters = Stored(clusters.sparkSession, "clusters").put(clusters, "given")  # read three times
    large = clusters.join(exchanged(clusters.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > most)), "cluster")
    lists = sets.join(exchanged(large), "region").groupBy("cluster", "size", "region").agg(F.array_sort(F.collect_list("kmer")).alias("ks"))
    alike = lists.groupBy("cluster", "size", "ks").agg(F.collect_list("region").alias("regions"))

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        seen = collections.Counter()
        for ks, r in zip(rows["ks"], rows["regions"], strict=True):
            seen.update(dict.fromkeys(ks, len(r)))
        rows = rows[[any(seen[k] > 1 for k in ks) for ks in rows["ks"]]]  # regions that share a k-mer with another
        if not len(rows):
            return pd.DataFrame({"region": [], "__part": [], "__whole": []})
        names = np.concatenate([np.asarray(r) for r in rows["regions"]])
        order = np.argsort(names, kind="stable")
        names, of = names[order], np.repeat(np.arange(len(rows)), [len(r) for r in rows["regions"]])[order]
        sets_, scale = [list(k) for k in rows["ks"]], resolution or max(1.0, rows["size"].iloc[0] / most)
        label = louvain_shared(of, sets_, scale, seed)
        if label.max() == 0:
            label = louvain_shared(of, sets_, 2 * scale, seed)
        least = pd.Series(names).groupby(label).transform("min") if label.max() else pd.Series([rows["cluster"].iloc[0]] * len(names))
        return pd.DataFrame({"region": names, "__part": least, "__whole": rows["cluster"].iloc[0]})

    return _divided(clusters, alike.groupBy("cluster").applyInPandas(divide, f"region {kind}, __part {kind}, __whole {clusters.schema['cluster'].dataType.simpleString()}"))


def _divided(clusters: DataFrame, parts: DataFrame) -> DataFrame:
    """``clusters`` with the parts found; regions that no part names are communities of their own where the cluster was divided."""
    parts = Stored(clusters.sparkSession, "communities").put(parts, "parts")
    divided = parts.where("__part <> __whole").select(F.col("__whole").alias("cluster")).distinct().withColumn("__divided", F.lit(True))
    out = clusters.join(exchanged(parts.drop("__whole")), "region", "left").join(exchanged(divided), "cluster", "left")
    return out.select("region", F.coalesce("__part", F.when(F.col("__divided"), F.col("region")), "cluster").alias("cluster"))
