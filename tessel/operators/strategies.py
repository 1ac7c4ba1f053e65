"""Splits by name of strategy: held-out rows apart, rows to folds, folds to roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fold_label
from ..storage import Stored, exchanged
from . import splits as L
from .clusters import cluster, subdivide
from .components import connected_components
from .features import composition_features, dense_kmers, standardised
from .graphs import contingency_clusters, kmer_sets, majority_clusters
from .refine import refine_shared

#: Shares of strategies that have their own.
OWN_RATIOS = {"mmseqs": L.Ratios(train=60, test=20, val=20)}


@dataclass(frozen=True)
class Request:
    """What a strategy is given.  ``ids`` have the key and no held-out row; ``tables`` are the strategy's own."""

    ids: DataFrame
    key: str
    seed: int
    ratios: L.Ratios | None
    tables: dict[str, DataFrame]
    options: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"the strategy needs the table {name!r}")
        return self.tables[name]

    def sequences(self) -> DataFrame:
        return self.table("sequences").join(exchanged(self.ids.select(self.key)), self.key, "left_semi")


Features = Callable[[Request], DataFrame]
Strategy = Callable[[Request], DataFrame]
#: Makers of (key, vec) from a request, by name; others can be added.
FEATURES: dict[str, Features] = {}
#: Makers of (key, train_test, fold) from a request, by name; others can be added.
STRATEGIES: dict[str, Strategy] = {}


def features(name: str):
    def keep(f: Features) -> Features:
        FEATURES[name] = f
        return f

    return keep


def strategy(name: str):
    def keep(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return keep


def _z_vectors(long: DataFrame, key: str) -> DataFrame:
    z = standardised(long, "feature", "value").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("feature", "z"))).alias("__z"))
    return z.select(key, F.transform("__z", lambda x: x["z"]).alias("vec"))


@features("gc")
def _(q: Request) -> DataFrame:
    return _z_vectors(composition_features(q.sequences(), q.key, "seq"), q.key)


@features("kmer")
def _(q: Request) -> DataFrame:
    dense = dense_kmers(q.sequences(), q.key, "seq", q.options.get("k", 5))
    return dense.withColumn("vec", F.transform("vec", F.log1p)) if q.options.get("log") else dense


def by_size(q: Request, folds: DataFrame) -> DataFrame:
    """(key, train_test, fold): whole folds, the largest first, to the roles that need them most; ``folds`` are (key, fold)."""
    sizes = folds.groupBy("fold").agg(F.count("*").alias("size"))
    return folds.join(exchanged(L.greedy_roles(sizes, "fold", "size", q.ratios).select("fold", "train_test")), "fold").select(q.key, "train_test", "fold")


def _by_features(q: Request, name: str) -> DataFrame:
    vectors = Stored(q.ids.sparkSession, "features").put(FEATURES[name](q), name)  # every pass of the clustering reads them
    folds = cluster(vectors, q.key, "vec", q.options.get("method", "auto"), q.options.get("clusters"), q.seed).withColumnRenamed("cluster", "fold")
    if q.options.get("most"):
        folds = subdivide(vectors.join(folds, q.key), q.key, "vec", "fold", q.options["most"], q.seed)
    return by_size(q, folds.select(q.key, F.col("fold").cast("string").alias("fold")))


@strategy("random")
def _(q: Request) -> DataFrame:
    strata = q.options.get("strata")
    out = L.stratified_split(q.ids, q.key, strata, q.seed, q.ratios) if strata else L.random_split(q.ids, q.key, q.seed, q.ratios)
    return out.select(q.key, "train_test", F.lit(None).cast("string").alias("fold"))


@strategy("gc")
def _(q: Request) -> DataFrame:
    return _by_features(q, "gc")


@strategy("kmer")
def _(q: Request) -> DataFrame:
    return _by_features(q, "kmer")


@strategy("hashfrag")
def _(q: Request) -> DataFrame:
    own = q.ids.select(q.key).join(q.table("groups").select(q.key, "group"), q.key)
    return L.orthogonal_split(own, q.key, "group", q.options.get("p_test", 0.1), q.options.get("val_share", 0.1), q.seed).select(q.key, "train_test", F.col("group").cast("string").alias("fold"))


@strategy("pangenome")
def _(q: Request) -> DataFrame:
    seqs, k = q.sequences(), q.options.get("k", 31)
    make = majority_clusters if q.options.get("method", "hash_majority") == "hash_majority" else contingency_clusters
    found = make(seqs, q.key, "seq", k)
    if q.options.get("most"):
        found = refine_shared(found, kmer_sets(seqs, q.key, "seq", k), q.options["most"], q.seed)
    return by_size(q, found.select(F.col("region").alias(q.key), F.col("cluster").cast("string").alias("fold")))


@strategy("blastp")
def _(q: Request) -> DataFrame:
    """Components of the hits (u, v) between rows; rows without a hit are folds of their own."""
    known = q.ids.select(F.col(q.key).alias("__k"))
    hits = q.table("hits")
    for end in ("u", "v"):
        hits = hits.join(known, F.col(end) == F.col("__k"), "left_semi")
    found = q.ids.select(q.key).join(connected_components(hits), F.col(q.key) == F.col("node"), "left")
    return by_size(q, found.select(q.key, F.coalesce("component", q.key).cast("string").alias("fold")))


@strategy("mmseqs")
def _(q: Request) -> DataFrame:
    """Clusters (representative, member) of another program; rows in none are folds of their own."""
    table = q.table("clusters").groupBy(F.col("member").alias("__m")).agg(F.min("representative").alias("__r"))
    found = q.ids.select(q.key).join(table, F.col(q.key) == F.col("__m"), "left")
    return by_size(q, found.select(q.key, F.coalesce("__r", q.key).cast("string").alias("fold")))


@strategy("paralogs_only")
def _(q: Request) -> DataFrame:
    genes = q.ids.select(q.key).join(q.table("genes").select(q.key, "orthogroup", "degree"), q.key, "left").fillna(0, ["degree"])
    return L.paralogs_only_split(genes, q.key, "orthogroup", "degree", q.seed).select(q.key, "train_test", F.col("orthogroup").cast("string").alias("fold"))


@strategy("loco")
def _(q: Request) -> DataFrame:
    genome, chrom = q.options.get("genome", "genome"), q.options.get("chrom", "chr")
    folds = L.chromosome_split(q.ids, genome, chrom, q.seed, q.ratios).select("fold", "train_test")
    return q.ids.select(q.key, F.concat_ws("|", genome, chrom).alias("fold")).join(folds, "fold").select(q.key, "train_test", "fold")


@strategy("scores")
def _(q: Request) -> DataFrame:
    """Quotas filled by a model's scores (key, train, val, test); "vgae" and "gcn" are the same with their models' scores."""
    scores = q.table("scores").join(q.ids.select(q.key), q.key, "left_semi").select(q.key, "train", "val", "test")
    return L.quota_assign(scores, q.key, q.ratios).select(q.key, "train_test", F.lit(None).cast("string").alias("fold"))


STRATEGIES |= {"vgae": STRATEGIES["scores"], "gcn": STRATEGIES["scores"]}


def split(name: str, ids: DataFrame, key: str = "ID", folds: DataFrame | None = None, seed: int = 42, ratios: L.Ratios | None = None, tables: dict[str, DataFrame] | None = None, **options) -> DataFrame:
    """(key, train_test, fold) of every row that the strategy can place.

    Rows whose fold in ``folds`` (key, fold) is a spelling of zero-shot validation are "zsv" and never reach the strategy.
    A strategy without folds of its own keeps those given.
    """
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(sorted(STRATEGIES))}")
    labels = None
    if folds is not None:
        labels = folds.select(F.col(key).alias("__key"), fold_label(F.col("fold")).alias("__fold")).dropDuplicates(["__key"])
        held = labels.where("__fold = 'zsv'")
        rest = ids.join(held, F.col(key) == F.col("__key"), "left_anti")
    else:
        rest = ids
    out = STRATEGIES[name](Request(rest, key, seed, ratios or OWN_RATIOS.get(name), tables or {}, options))
    if labels is None:
        return out
    placed = out.join(labels, F.col(key) == F.col("__key"), "left").select(key, "train_test", F.coalesce("fold", "__fold").alias("fold"))
    return placed.unionByName(ids.select(key).join(held, F.col(key) == F.col("__key")).select(key, F.lit("zsv").alias("train_test"), F.col("__fold").alias("fold")))
