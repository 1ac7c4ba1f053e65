"""Alignments as columns: consensus, relative positions, runs, profiles and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Stored

BASES = ("A", "C", "G", "T")


def column_consensus(df: DataFrame, cluster: str, seq: str) -> DataFrame:
    """(cluster, position, n_seqs, n_letters, rate): the commonest base's share of all sequences, gaps included.

    Fewer than two sequences, or a column without a base, have no rate (null).  Letters are counted per column before
    anything is exchanged.
    """
    letters = df.select(cluster, F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("at", "letter")).where("letter <> ''")
    counts = letters.groupBy(cluster, (F.col("at") + 1).alias("position")).agg(F.count("*").alias("n_seqs"), *(F.count_if(F.col("letter") == b).alias(b) for b in BASES))
    n = sum((F.col(b) for b in BASES), F.lit(0))
    rate = F.when((F.col("n_seqs") >= 2) & (n > 0), F.greatest(*BASES) / F.col("n_seqs"))
    return counts.select(cluster, "position", "n_seqs", n.alias("n_letters"), rate.alias("rate"))


def relative_position(df: DataFrame, cluster: str, position: str, bins: int) -> DataFrame:
    """``df`` with ``relative`` (0 to 1 by the cluster's last position) and ``bin``."""
    last = df.groupBy(cluster).agg(F.max(position).alias("__last"))
    rel = (F.col(position) - 1) / F.greatest(F.col("__last") - 1, F.lit(1))
    out = df.join(last, cluster).withColumn("relative", rel).drop("__last")
    return out.withColumn("bin", F.least(F.floor(F.col("relative") * bins), F.lit(bins - 1)).cast("int"))


def longest_run(df: DataFrame, group: str, position: str, holds: Column) -> DataFrame:
    """(group, longest): the most consecutive positions at which the condition holds; null breaks a run."""
    kept = df.withColumn("__ok", F.coalesce(holds, F.lit(False)))
    island = F.col(position) - F.row_number().over(Window.partitionBy(group).orderBy(position))
    runs = kept.where("__ok").withColumn("__i", island).groupBy(group, "__i").agg(F.count("*").alias("__n")).groupBy(group).agg(F.max("__n").alias("longest"))
    return kept.select(group).distinct().join(runs, group, "left").select(group, F.coalesce("longest", F.lit(0)).alias("longest"))


def bin_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, q25, q75 and n of finite values."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).groupBy(*keys).agg(F.avg(v).alias("mean"), q.alias("q"), F.count("*").alias("n"))
    return out.select(*keys, "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "n")


def profile_matrix(df: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """A row per ``row`` and a column per name; gaps get the column's median, columns of nothing are 0."""
    pivoted = df.groupBy(row).pivot(column, names).agg(F.avg(value))
    cols = [str(n) for n in names]
    middle = pivoted.agg(*(F.median(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)))
    filled = pivoted.join(F.broadcast(middle))  # one row
    return filled.select(row, *(F.coalesce(F.col(f"`{c}`"), F.col(f"m{i}"), F.lit(0.0)).alias(c) for i, c in enumerate(cols)))


def paired_delta(df: DataFrame, pair: str, scope: str, key: str, value: str, a: str, b: str) -> DataFrame:
    """(key, mean, n, sd) of ``a`` minus ``b`` over the pairs that have both."""
    both = df.groupBy(pair, key).agg(F.avg(F.when(F.col(scope) == a, F.col(value))).alias("__a"), F.avg(F.when(F.col(scope) == b, F.col(value))).alias("__b"))
    d = F.col("__a") - F.col("__b")
    return both.where("__a is not null and __b is not null").groupBy(key).agg(F.avg(d).alias("mean"), F.count("*").alias("n"), F.stddev_samp(d).alias("sd"))


def scaled_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values from 0 to 1 within their group; equal values are 0.5."""
    w = Window.partitionBy(group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.5))


def group_correlation(df: DataFrame, group: str, x: str, y: str, least: int = 10) -> DataFrame:
    """(group, n, r): null for fewer than ``least`` pairs and for constant values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = both.groupBy(group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return out.select(group, "n", F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("r")).alias("r"))


def sequential_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers 1 to n in the given order.  Rows are range-partitioned and stored; each part is numbered from the sizes of those before it."""
    store = Stored(df.sparkSession, "ids")
    parted = store.put(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parted")
    local = parted.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = parted.groupBy("__part").agg(F.count("*").alias("__size"))
    # one row per task
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__n")).drop("__part", "__n", "__before")
