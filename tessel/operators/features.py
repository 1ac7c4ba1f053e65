"""Features of sequences: k-mer tables, composition, projections, structural features of graph nodes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import order_key
from ..functions.sequences import aaa_percent, gc_percent, kmers


def kmer_counts(rows: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, kmer, n) of the k-mers that occur."""
    return rows.select(key, F.explode(kmers(F.col(seq), k)).alias("kmer")).groupBy(key, "kmer").agg(F.count("*").alias("n"))


def kmer_features(rows: DataFrame, key: str, seq: str, ks: list[int], log: bool = False) -> DataFrame:
    """(key, feature, value): relative frequencies per k, log1p if asked for; features are ``kmer_X``, ``k<k>_X`` for several k."""
    out = None
    for k in ks:
        counts = kmer_counts(rows, key, seq, k)
        share = F.col("n") / F.sum("n").over(Window.partitionBy(key))
        part = counts.select(key, F.concat(F.lit(f"k{k}_" if len(ks) > 1 else "kmer_"), "kmer").alias("feature"), (F.log1p(share) if log else share).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def composition_features(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, feature, value) of GC_pct and AAA_pct."""
    pair = F.array(F.struct(F.lit("GC_pct").alias("feature"), gc_percent(F.col(seq)).alias("value")), F.struct(F.lit("AAA_pct").alias("feature"), aaa_percent(F.col(seq)).alias("value")))
    return rows.select(key, F.inline(pair))


def dense_kmers(rows: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, vec): relative frequencies of all 4**k k-mers in the order of their letters; zeros without any."""
    every = ["".join(p) for p in product("ACGT", repeat=k)]
    counts = kmer_counts(rows, key, seq, k).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("__m"), F.sum("n").alias("__t"))
    joined = rows.select(key).join(counts, key, "left")
    value = F.transform(F.array(*map(F.lit, every)), lambda x: F.coalesce(F.get(F.transform(F.array(F.col("__m")[x]), lambda v: v / F.col("__t")), F.lit(0)), F.lit(0.0)))
    return joined.select(key, value.alias("vec"))


def projected(features: DataFrame, key: str, feature: str, value: str, dims: int, seed: int = 0) -> DataFrame:
    """(key, dim, value): a random projection with signs from a hash of (feature, dim), scaled by sqrt(dims).

    Signs need no matrix to be drawn or sent; distances are kept as by Gaussian rows.
    """
    sign = lambda d: F.when(F.pmod(F.xxhash64(F.col(feature), d, F.lit(seed)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = [F.sum(F.col(value) * sign(F.lit(d)) / dims**0.5).alias(f"d{d}") for d in range(dims)]
    wide = features.groupBy(key).agg(*sums)
    return wide.select(key, F.posexplode(F.array(*[f"d{d}" for d in range(dims)])).alias("dim", "value"))


def standardised(features: DataFrame, feature: str, value: str, least: float = 1e-12) -> DataFrame:
    """``features`` with ``z``: per feature minus mean, by the population deviation; a deviation below ``least`` is 1."""
    stats = features.groupBy(F.col(feature).alias("__f")).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = features.join(stats, F.col(feature) == F.col("__f"))
    return joined.withColumn("z", (F.col(value) - F.col("__m")) / F.when(F.col("__s") < least, 1.0).otherwise(F.col("__s"))).drop("__f", "__m", "__s")


def prefix_counts(seq: Column, letters: str) -> Column:
    """For each place, how many letters up to it are in ``letters``; a range's count is a difference."""
    marks = F.transform(F.split(seq, ""), lambda c: F.when(F.lit(letters).contains(c) & (c != ""), 1).otherwise(0))
    done = F.aggregate(marks, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), lambda a, m: F.struct((a["n"] + m).alias("n"), F.concat(a["out"], F.array(a["n"] + m)).alias("out")), lambda a: a["out"])
    return done


def first_motif(aligned: Column, motif: str) -> Column:
    """The alignment column (from 1) at which the first motif of the ungapped sequence begins; null if there is none."""
    at = F.instr(F.translate(aligned, "-", ""), motif)
    columns = F.filter(F.transform(F.split(aligned, ""), lambda c, i: F.when((c != "-") & (c != ""), i + 1)), lambda i: i.isNotNull())
    return F.when(at > 0, F.get(columns, at - 1)).cast("long")


def absolute_differences(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(id_a, id_b, dist) for all pairs id_a < id_b of a small table."""
    a, b = (rows.select(F.col(key).alias(f"id_{s}"), F.col(value).alias(f"__{s}")) for s in ("a", "b"))
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", F.abs(F.col("__a") - F.col("__b")).alias("dist"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the reproducible random order."""
    return rows.orderBy(order_key(F.col(key), seed), key).limit(n)


def structural_features(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, degree, log_degree, triangles, clustering, component_size) of an undirected simple graph.

    Triangles are counted from each node's neighbours of greater (degree, id): no node has more of these than the square
    root of twice the number of edges, whatever its degree.
    """
    from .components import connected_components

    e = edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a <> b").distinct()
    ends = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("degree"))
    da, db = (degree.select(F.col("node").alias(s), F.col("degree").alias(f"d{s}")) for s in ("a", "b"))
    ranked = e.join(da, "a").join(db, "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    out = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"))
    wedge = out.alias("p").join(out.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = wedge.join(e, (F.col("y") == e["a"]) & (F.col("z") == e["b"])).select(F.explode(F.array("x", "y", "z")).alias("node"))
    triangles = closed.groupBy("node").agg(F.count("*").alias("triangles"))
    comp = connected_components(e, "a", "b")
    sizes = comp.groupBy("component").agg(F.count("*").alias("component_size"))
    d = F.col("degree")
    joined = degree.join(triangles, "node", "left").join(comp.join(sizes, "component"), "node")
    return joined.select("node", "degree", F.log1p(d).alias("log_degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(d > 1, 2 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("clustering"), "component_size")
