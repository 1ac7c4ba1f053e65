"""The shared folder: where lineage is cut with written tables that all executors can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a local session without that setting gets a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessel-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def exchanged(df: DataFrame) -> DataFrame:
    """``df`` for a join that exchanges both sides.

    Spark broadcasts what it thinks small by the size of files, which are compressed and may hold a few bytes a row, and the
    driver then holds all of it unpacked.  Tables with a row per row of the input are joined so.
    """
    return df.hint("merge")


class Stored:
    """Tables written for one run of one operator; the JVM removes their folder when it ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tessel-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Free a table that no later step reads."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)
