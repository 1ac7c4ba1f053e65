"""Graphs of regions that share k-mers, and of homologous genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import kmers
from ..storage import exchanged
from .components import connected_components


def undirected(edges: DataFrame, u: str, v: str) -> DataFrame:
    """Distinct edges (u, v) with u < v."""
    return edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()


def degrees(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    return edges.select(F.explode(F.array(u, v)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def statistics(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row: n_edges, n_nodes, n_components, largest, median_size (the upper middle of the falling list), n_singletons."""
    sizes = connected_components(edges, u, v).groupBy("component").agg(F.count("*").alias("n"))
    # sizes repeat, so the middle one is found among distinct sizes
    per = sizes.groupBy("n").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.orderBy(F.desc("n")))
    total = per.agg(F.sum("k").alias("n_components"), F.sum(F.col("n") * F.col("k")).alias("n_nodes"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("k"))), F.lit(0)).alias("n_singletons"))
    middle = per.withColumn("upto", upto).crossJoin(F.broadcast(total)).where("upto >= n_components div 2 + 1").agg(F.max("n").alias("median_size"))
    count = edges.agg(F.count("*").alias("n_edges"))
    return total.crossJoin(middle).crossJoin(count).select("n_edges", "n_nodes", "n_components", "largest", "median_size", "n_singletons")


def normalised_weights(edges: DataFrame, weight: str) -> DataFrame:
    """``edges`` with log1p of the weight over its greatest."""
    top = edges.agg(F.max(F.log1p(weight)).alias("__top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("weight", F.log1p(weight) / F.col("__top")).drop("__top")


def kmer_sets(rows: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(region, kmer), distinct."""
    return rows.select(F.col(key).alias("region"), F.explode(F.array_distinct(kmers(F.col(seq), k))).alias("kmer"))


def document_frequency(incidence: DataFrame, least: int = 1) -> DataFrame:
    """(kmer, df): in how many regions a k-mer is, from ``least`` on."""
    return incidence.groupBy("kmer").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def cooccurrence(incidence: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): in how many regions two k-mers a < b both are, from ``least`` on.

    All pairs of a region's k-mers are made, as the definition asks; k-mers of one region alone are dropped before.
    """
    common = incidence.join(document_frequency(incidence, least).select("kmer"), "kmer")
    lists = common.groupBy("region").agg(F.array_sort(F.collect_list("kmer")).alias("ks"))
    pairs = lists.select(F.explode(F.expr("flatten(transform(ks, (a, i) -> transform(slice(ks, i + 2, size(ks)), b -> struct(a as a, b as b))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def contingency_clusters(rows: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(region, cluster): regions that share a k-mer are one cluster, named by its least region."""
    sets = kmer_sets(rows, key, seq, k)
    owner = sets.groupBy("kmer").agg(F.min("region").alias("owner"), F.max("region").alias("last")).where("owner < last")
    edges = sets.join(exchanged(owner), "kmer").where("region <> owner").select(F.col("owner").alias("u"), F.col("region").alias("v")).distinct()
    found = connected_components(edges)
    return rows.select(F.col(key).alias("region")).join(exchanged(found), F.col("region") == F.col("node"), "left").select("region", F.coalesce("component", "region").alias("cluster"))


def majority_vote(rows: DataFrame, key: str, vote: str) -> DataFrame:
    """(key, vote, n): each key's most frequent vote, the least of equals."""
    counts = rows.groupBy(key, vote).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("__top"))
    return counts.join(top, key).where(F.col("n") == F.col("__top")).groupBy(key).agg(F.min(vote).alias("vote"), F.first("n").alias("n"))


def majority_clusters(rows: DataFrame, key: str, seq: str, k: int, min_df: int = 2, min_pairs: int = 2) -> DataFrame:
    """(region, cluster): k-mers that often occur together are components; a region goes to the component of most of its k-mers.

    Regions without such a k-mer are clusters of their own.  Clusters are numbered by their least region.
    """
    sets = kmer_sets(rows, key, seq, k)
    kept = sets.join(exchanged(document_frequency(sets, min_df).select("kmer")), "kmer")
    parts = connected_components(cooccurrence(kept, min_pairs), "a", "b")
    votes = kept.join(exchanged(parts), F.col("kmer") == F.col("node"), "left").select("region", F.coalesce("component", "kmer").alias("component"))
    won = majority_vote(votes, "region", "component").select("region", F.col("vote").alias("__vote"))
    named = won.join(won.groupBy("__vote").agg(F.min("region").alias("__least")), "__vote").select("region", "__least")
    return rows.select(F.col(key).alias("region")).join(exchanged(named), "region", "left").select("region", F.coalesce("__least", "region").alias("cluster"))


def homology_labels(regions: DataFrame, key: str, edges: DataFrame, relation: str = "relation", u: str = "gene1", v: str = "gene2") -> DataFrame:
    """(key, orthogroup, paragroup): components over ortholog edges and over paralog edges; null for regions in none."""
    out = regions.select(key)
    for name, kind in (("orthogroup", "ortholog"), ("paragroup", "paralog")):
        found = connected_components(edges.where(F.col(relation) == kind), u, v).select(F.col("node").alias(f"__{name}"), F.col("component").alias(name))
        out = out.join(found, F.col(key) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out


def homology_edges(rows: DataFrame, genomes: list[str], high_confidence: bool = False) -> DataFrame:
    """Distinct undirected edges (gene1, genome1, gene2, genome2, relation) from homology rows.

    Both genomes must be in the panel; orthologs are across genomes, paralogs within one; no self loops.
    """
    from ..functions.names import relation

    used = rows.where(F.col("genome1").isin(*genomes) & F.col("genome2").isin(*genomes)).withColumn("relation", relation(F.col("homology_type"))).where("relation is not null and gene1 <> gene2")
    if high_confidence:
        used = used.where(F.col("is_high_confidence").cast("int") == 1)
    used = used.where(((F.col("relation") == "ortholog") & (F.col("genome1") != F.col("genome2"))) | ((F.col("relation") == "paralog") & (F.col("genome1") == F.col("genome2"))))
    a, b = F.struct(F.col("genome1").alias("g"), F.col("gene1").alias("n")), F.struct(F.col("genome2").alias("g"), F.col("gene2").alias("n"))
    ends = used.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "relation").distinct()
    return ends.select(F.col("a.n").alias("gene1"), F.col("a.g").alias("genome1"), F.col("b.n").alias("gene2"), F.col("b.g").alias("genome2"), "relation")


def both_ends(edges: DataFrame, known: DataFrame, key: str, u: str = "u", v: str = "v") -> DataFrame:
    """Edges whose two ends are both known."""
    k = known.select(F.col(key).alias("__k")).distinct()
    return edges.join(k, F.col(u) == F.col("__k"), "left_semi").join(k, F.col(v) == F.col("__k"), "left_semi")


def capped_edges(edges: DataFrame, weight: str, most: int, u: str = "u", v: str = "v") -> DataFrame:
    """The ``most`` edges of greatest weight, ties by their ends."""
    return edges.orderBy(F.desc(weight), u, v).limit(most)
