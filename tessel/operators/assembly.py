"""Joins that assemble tables: remapping of keys, tiers of keys, aliases, symbols, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remap(keys: DataFrame, key: str, table: DataFrame, old: str, new: str, order: str) -> DataFrame:
    """(key, new, place) for all rows of ``table`` with the key, numbered in the table's order."""
    found = keys.select(F.col(key).alias("__key")).join(table.select(F.col(old).alias("__key"), F.col(new).alias("__new"), F.col(order).alias("__order")), "__key")
    place = F.row_number().over(Window.partitionBy("__key").orderBy("__order"))
    return found.select(F.col("__key").alias(key), F.col("__new").alias(new), place.alias("place"))


def two_tier(targets: DataFrame, table: DataFrame, id_col: str, first: str, second: str, key: str, value: str) -> DataFrame:
    """(id, value, tier): by ``first``, and where that has no hit by ``second``; of several the least key."""
    values = targets.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    one = table.select(id_col, F.col(first).alias("__key")).join(values, "__key").withColumn("tier", F.lit(1))
    rest = table.join(one.select(id_col), id_col, "left_anti")
    two = rest.select(id_col, F.col(second).alias("__key")).join(values, "__key").withColumn("tier", F.lit(2))
    least = one.unionByName(two).groupBy(id_col).agg(F.min(F.struct("tier", "__key", "__value")).alias("m"))
    return least.select(id_col, F.col("m.__value").alias(value), F.col("m.tier").alias("tier"))


def assemble(split: DataFrame, sequences: DataFrame, targets: DataFrame, id_col: str, strict: bool = False) -> DataFrame:
    """Rows of the split with sequence and target; without one a row is left out, or with ``strict`` the query fails."""
    if not strict:
        return split.join(sequences, id_col).join(targets, id_col)
    whole = split.join(sequences.withColumn("__s", F.lit(True)), id_col, "left").join(targets.withColumn("__t", F.lit(True)), id_col, "left")
    checked = F.when(F.col("__s").isNull() | F.col("__t").isNull(), F.raise_error(F.concat(F.lit("incomplete id "), F.col(id_col).cast("string")))).otherwise(F.col(id_col))
    return whole.withColumn(id_col, checked.cast(split.schema[id_col].dataType)).drop("__s", "__t")


def last_known(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the last value of each column that is not blank, in the table's order."""
    known = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.groupBy(key).agg(*(F.max_by(F.col(c), F.when(known(c), F.col(order))).alias(c) for c in columns))


def group_roles(split: DataFrame, groups: DataFrame, id_col: str, group: str, role: str) -> DataFrame:
    """(group, role, n): members of a group by role; rows of role "other" are left out."""
    return split.where(F.col(role) != "other").join(groups, id_col).groupBy(group, role).agg(F.count("*").alias("n"))


def hop(rows: DataFrame, on: str, table: DataFrame, old: str, new: str, order: str) -> DataFrame:
    """``rows`` with the first value of ``new`` that the table has for ``on``; others are left out."""
    first = table.groupBy(F.col(old).alias(on)).agg(F.min_by(F.col(new), F.col(order)).alias(new))
    return rows.join(first, on)


def without_version(x: Column) -> Column:
    """An accession without what follows its first dot."""
    return F.substring_index(x, ".", 1)


def resolve_aliases(values: DataFrame, spellings: Column, value: str, aliases: DataFrame, alias: str, gene: str) -> DataFrame:
    """(gene, value): of a row's spellings, in their order, the first that names one gene; of several rows the greatest value."""
    clear = aliases.groupBy(alias).agg(F.min(gene).alias(gene), F.count_distinct(gene).alias("__n")).where("__n = 1").drop("__n")
    tried = values.withColumn("__row", F.monotonically_increasing_id()).select("__row", F.col(value).alias(value), F.posexplode(spellings).alias("__at", alias))
    hit = tried.join(clear, alias).groupBy("__row").agg(F.min_by(F.struct(gene, value), "__at").alias("h"))
    return hit.groupBy(F.col(f"h.{gene}").alias(gene)).agg(F.max(f"h.{value}").alias(value))


def join_unique(a: DataFrame, b: DataFrame, symbol: str, least: int = 0) -> DataFrame:
    """Rows of both whose symbol stands once on either side; fails on the driver with fewer than ``least`` of them."""
    once = lambda df: df.withColumn("__n", F.count("*").over(Window.partitionBy(symbol))).where("__n = 1").drop("__n")
    out = once(a).join(once(b), symbol)
    if least and out.count() < least:
        raise ValueError(f"fewer than {least} symbols in common")
    return out


def checked_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``a`` left join ``b``; the query fails on a row of ``b`` that no row of ``a`` matches."""
    lost = b.join(a.select(*keys).distinct(), keys, "left_anti").limit(1)
    if not lost.isEmpty():
        raise ValueError(f"rows without a match, such as {lost.head()}")
    return a.join(b, keys, "left")


def family_links(edges: DataFrame, u: str, v: str, families: DataFrame, node: str, family: str) -> DataFrame:
    """(family_1, family_2, n): edges between different families, each pair in one order."""
    f = families.select(F.col(node).alias("__n"), F.col(family).alias("__f"))
    both = edges.join(f.select(F.col("__n").alias(u), F.col("__f").alias("fu")), u).join(f.select(F.col("__n").alias(v), F.col("__f").alias("fv")), v).where("fu <> fv")
    return both.groupBy(F.least("fu", "fv").alias("family_1"), F.greatest("fu", "fv").alias("family_2")).agg(F.count("*").alias("n"))
