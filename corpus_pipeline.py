"""The corpus pipeline: quality classifier, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes all that the stage before it kept.  All but the last return the columns of ``documents``.

Defined cases of all stages: null and empty texts are scored like others, have no lines, are copies of each other, are
clean and are packed as the end id alone; rows with a null doc_id lose no lines and are nobody's copy; rows of one doc_id
stay or go each on its own in quality, lines and benchmark and stay together in near; ties go to the least doc_id; very
long texts are read whole; an empty table stays empty; columns go through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.decontaminate import decontaminate
from tessel.llm.line_dedup import LONG_LINE, cut_lines
from tessel.llm.near_dedup import drop_near_duplicates
from tessel.llm.packing import pack
from tessel.llm.quality import score, train
from tessel.storage import Stored

ACCEPT = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    forest = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, forest).where(F.col("score") >= ACCEPT).select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines and long single lines; those of which nothing is left go."""
    found = cut_lines(docs, min_words=LONG_LINE).where("gone = 0 or gone < lines")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    old = {c: F.col("doc").getField(c) for c in docs.columns}
    return found.select(*(F.when(F.col("gone") > 0, changed[c]).otherwise(old[c]).alias(c) if c in changed else old[c].alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no test item contaminates."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]

#: The classifier, near dedup and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written as Parquet and read again."""
    store = Stored(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), name)
        if i:
            store.drop(STAGES[i - 1][0])
    return docs
