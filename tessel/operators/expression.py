"""Expression counts, histograms, summaries by group, and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_to_tpm(counts: DataFrame, lengths: DataFrame, gene: str, count: str, length: str, sample: list[str] | None = None) -> DataFrame:
    """Counts per kilobase as shares of a million per sample; genes without a positive length are left out, a sample of nothing is all zeros."""
    keys = sample or []
    rates = counts.join(lengths.where(F.col(length) > 0), gene).withColumn("__rate", F.col(count) / (F.col(length) / 1000.0))
    if keys:
        total = F.sum("__rate").over(Window.partitionBy(*keys))
        rows = rates.withColumn("__total", total)
    else:
        rows = rates.join(F.broadcast(rates.agg(F.sum("__rate").alias("__total"))))  # one row
    return rows.select(*keys, gene, F.when(F.col("__total") > 0, F.col("__rate") / F.col("__total") * 1e6).otherwise(0.0).alias("tpm"))


def mean_over_samples(df: DataFrame, gene: str, sample: str, value: str, how: str = "intersection") -> DataFrame:
    """Per gene the mean over samples: of genes that all samples have, or of any, in which case a sample without the gene adds 0."""
    n = df.agg(F.count_distinct(sample).alias("__n"))
    sums = df.groupBy(gene).agg(F.sum(value).alias("__sum"), F.count_distinct(sample).alias("__have"))
    rows = sums.join(F.broadcast(n))  # one row
    if how == "intersection":
        rows = rows.where("__have = __n")
    return rows.select(gene, (F.col("__sum") / F.col("__n")).alias(value))


def renormalise(df: DataFrame, value: str, groups: list[str], to: float = 1e6) -> DataFrame:
    """Values of a group as shares of ``to``; a group without a positive sum stays as it is."""
    total = F.sum(value).over(Window.partitionBy(*groups))
    return df.withColumn(value, F.when(total > 0, F.col(value) / total * to).otherwise(F.col(value)))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, low, n) of bins of one width between the least and the greatest value, the last one closed; equal values are one bin."""
    ends = df.where(F.col(value).isNotNull()).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(ends))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0).cast("int")
    return rows.groupBy(place.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), "n")


def seed_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, median, sd (sample), ci95 (1.96 standard errors) and n of the values that are numbers."""
    v = F.when(~F.isnan(value), F.col(value))
    s = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"), F.count(v).alias("n"))
    return s.withColumn("ci95", 1.96 * F.col("sd") / F.sqrt("n"))


def fold_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean and standard error of the mean over folds; one fold has none (0)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("sem"), F.count(value).alias("n"))


def cardinality(df: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n, kind): "identity" if the only member is the group itself or there is none, "single", "multi"."""
    n = df.groupBy(group).agg(F.count_distinct(member).alias("n"), F.min(member).alias("__m"))
    kind = F.when(F.col("n") == 0, "identity").when((F.col("n") == 1) & (F.col("__m") == F.col(group)), "identity").when(F.col("n") == 1, "single").otherwise("multi")
    return n.select(group, "n", kind.alias("kind"))


def expand_counts(df: DataFrame, column: str) -> DataFrame:
    """A row per ``name:count`` of a list with semicolons: all columns but this one, species, n."""
    parts = F.explode(F.filter(F.split(column, ";"), lambda x: x.contains(":")))
    rows = df.withColumn("__p", parts)
    return rows.select(*(c for c in df.columns if c != column), F.trim(F.substring_index("__p", ":", 1)).alias("species"), F.substring_index("__p", ":", -1).cast("long").alias("n"))


def path_groups(df: DataFrame, group: Column, path: str, order: str) -> DataFrame:
    """(assembly, paths, n): an assembly's sample paths in their order."""
    return df.groupBy(group.alias("assembly")).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, path))), lambda p: p[path]).alias("paths"), F.count("*").alias("n"))


def wide(df: DataFrame, row: str, column: str, value: str, names: list, least: int = 0) -> DataFrame:
    """Means by row and column name, a column for each of ``names``; rows with fewer than ``least`` of them are left out."""
    out = df.groupBy(row).pivot(column, names).agg(F.avg(value))
    have = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in map(str, names)), F.lit(0))
    return out.where(have >= least)


def long(df: DataFrame, row: str, names: list[str], column: str, value: str) -> DataFrame:
    """The reverse of ``wide``; nulls are left out."""
    return df.unpivot(row, names, column, value).where(F.col(value).isNotNull())


def tercile_round_robin(df: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """``n`` rows, taken in turn from the small, middle and large third (cut at 33 and 66 percent), larger ones first."""
    cuts = df.agg(F.percentile(size, F.array(F.lit(0.33), F.lit(0.66))).alias("c"))
    binned = df.join(F.broadcast(cuts)).withColumn("bin", F.when(F.col(size) <= F.col("c")[0], 0).when(F.col(size) <= F.col("c")[1], 1).otherwise(2))
    # of each third only the first n can be taken
    ranked = binned.withColumn("turn", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc(size), key))).where(F.col("turn") <= n)
    return ranked.orderBy("turn", "bin").limit(n).select(key, size, "bin", "turn")
