"""Checks of tables: columns, keys, id sets, ranges.  Each returns the offending rows, or counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that the table lacks."""
    return [c for c in required if c not in df.columns]


def key_faults(df: DataFrame, key: str) -> DataFrame:
    """(key, n, fault): blank keys and keys that stand more than once, white space aside."""
    k = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    counted = df.groupBy(k.alias("key")).agg(F.count("*").alias("n"))
    return counted.select("key", "n", F.when(F.col("key") == "", "blank").when(F.col("n") > 1, "repeated").alias("fault")).where("fault is not null")


def id_differences(sources: dict[str, DataFrame], id_col: str) -> DataFrame:
    """(id, and for each source whether it has the id) of the ids that not all sources have."""
    rows = None
    for name, df in sources.items():
        part = df.select(F.col(id_col).cast("string").alias("id"), F.lit(name).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    has = rows.groupBy("id").agg(*(F.max(F.col("source") == n).alias(n) for n in sources))
    return has.where(~F.expr(" and ".join(f"`{n}`" for n in sources)))


def unknown_ids(df: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """Distinct ids that ``known`` lacks."""
    return df.select(id_col).distinct().join(known.select(id_col), id_col, "left_anti")


def pick_ids(ids: DataFrame, id_col: str, genome_col: str, genomes: list[str] | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Ids of some genomes, at most ``most`` by seeded hash order, then by length and name."""
    out = ids if genomes is None else ids.where(F.col(genome_col).isin(genomes))
    if most is not None:
        out = out.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(most)
    return out.orderBy(F.length(F.col(id_col).cast("string")), id_col)


def well_aligned(df: DataFrame, filled: str, total: str, least: float) -> DataFrame:
    """Rows of which at least a share of the sequences has a letter."""
    return df.where(F.col(filled) / F.greatest(F.col(total), F.lit(1)) >= least)


def finite(x: Column) -> Column:
    """The value if it is a finite number, else null."""
    v = x.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def check_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n_rows, n_failed, ok) of conditions that each row should meet; null fails."""
    failed = df.agg(F.count("*").alias("__n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col("__n").alias("n_rows"), F.col(k).alias("n_failed")) for k in checks)))
    return failed.select(rows.alias("r")).select("r.*", (F.col("r.n_failed") == 0).alias("ok"))


def homology_features(names: DataFrame, feature: str) -> DataFrame:
    """Distinct feature names that speak of orthologs or paralogs, and so would leak them."""
    low = F.lower(F.col(feature))
    return names.where(low.contains("ortholog") | low.contains("paralog") | low.contains("homolog")).select(feature).distinct()
