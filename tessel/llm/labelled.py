"""Labelled rows for training: a fold test on doc_id and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sample(labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` training labels (id, label): those whose id has the least hashes.  Of repeated ids the least label counts."""
    rows = labels.select(F.col(id_col).cast("long").alias("__label_id"), F.col(label).cast("int").alias("__label"))
    rows = rows.where("__label_id is not null and __label in (0, 1)").where(fold("__label_id", folds) != held_out)
    rows = rows.groupBy("__label_id").agg(F.min("__label").alias("__label"))
    return rows.orderBy(F.xxhash64("__label_id"), "__label_id").limit(most)


def sampled_documents(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, text, h) of the sampled labels' rows; the sample is bounded, so it is sent to the documents.

    An id may have several rows: ``first_rows`` bounds these.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("__label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__label_id").withColumn("h", F.xxhash64("text"))


def first_rows(rows: DataFrame, most: int) -> list:
    """At most ``most`` of the sampled rows, those whose id and then text have the least hashes, in an order of content."""
    got = rows.orderBy(F.xxhash64("__label_id"), "__label_id", "h").limit(most).collect()
    return sorted(got, key=lambda r: (r.h, r["__label"], r["__label_id"]))
