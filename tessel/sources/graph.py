"""Graphs as tables, matrices of tensor files, stages that are not done twice, and directories read as a stream."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, meta: dict) -> None:
    """Nodes, edges and one row of settings and counts; the settings are written last and mark a whole graph."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = nodes.sparkSession
    counts = {f"n_{t}": spark.read.parquet(f"{path}/{t}").count() for t in ("nodes", "edges")}
    spark.createDataFrame([(json.dumps(meta | counts, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Nodes, edges and settings of ``write_graph``."""
    meta = json.loads(spark.read.text(f"{path}/meta").head()[0])
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta


def read_tensors(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(path, tensor, row, vec) of all two-dimensional 32-bit float matrices in tensor files, or of the one named.

    A file is 8 bytes of header size, a JSON header and the numbers, all little-endian; it is one value of a scan, so it must
    be under 2 GB.  With a name, another type or shape is an error, as is a file without it.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                (size,) = struct.unpack_from("<Q", content)
                header = json.loads(content[8 : 8 + size])
                if name is not None and name not in header:
                    raise ValueError(f"{file} has no tensor {name!r}")
                for tensor in sorted(header) if name is None else [name]:
                    about = header[tensor]
                    if tensor == "__metadata__" or (name is None and (about["dtype"] != "F32" or len(about["shape"]) != 2)):
                        continue
                    if about["dtype"] != "F32" or len(about["shape"]) != 2:
                        raise ValueError(f"{tensor!r} of {file} is {about['dtype']} {about['shape']}, not a matrix of F32")
                    start, end = about["data_offsets"]
                    matrix = np.frombuffer(content, "<f4", (end - start) // 4, 8 + size + start).reshape(about["shape"])
                    for at in range(0, len(matrix), 1024):
                        part = matrix[at : at + 1024]
                        yield pd.DataFrame({"path": file, "tensor": tensor, "row": np.arange(at, at + len(part)), "vec": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, tensor string, row long, vec array<float>")


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; it is made and written first unless an earlier run has finished it.

    Only a finished write leaves ``_SUCCESS``, so a stage that was killed is done again and later ones are not.
    """
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def follow(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream of rows, with the file that each came from."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("file", F.input_file_name())
