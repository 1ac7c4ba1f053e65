"""Token files: documents' ids, each compressed on its own with a shared zstandard dictionary.

A file is a sequence of blocks.  A block is, little-endian:

    magic ``TSLB`` | version u32 | SHA-256 of the dictionary (32 bytes) | documents u64
    index: for each document, doc_id i64, ids u64, end of its frame u64 (counted from the first frame)
    frames: for each document one zstandard frame of its ids as u32

Documents ascend by doc_id within a block and over the blocks of a table.  One document is read by a search of the index
and one frame.  Blocks are rows of a Parquet table beside the dictionary's table, so they go through Spark's own writers:
any store that Spark can reach holds them, and a lost task writes its blocks again.

Defined cases: null and empty texts have the end id alone; texts that spell a special token have its id, as in the
library; rows of one doc_id are ordered by a hash of their texts and then by the texts, and so may lie in several blocks,
however many there are; equal rows are all written; a null doc_id comes before all others and is kept as null (index
value -2**63); a very long text is one frame; extra columns are ignored; an empty table makes an empty token table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import Stored
from .textscan import text_slices
from .tokens import default_path, encoder

MAGIC, VERSION = b"TSLB", 1
HEAD = struct.Struct("<4sI32sQ")
NO_ID = -(1 << 63)


def write_block(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, dictionary: zstandard.ZstdCompressionDict, level: int = 3) -> bytes:
    tool = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_dict_id=False)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).data
    frames = [tool.compress(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    index = np.empty((len(frames), 3), "<i8")
    index[:, 0], index[:, 1] = doc_ids, np.diff(offsets)
    index[:, 2] = np.cumsum([len(f) for f in frames])
    return b"".join([HEAD.pack(MAGIC, VERSION, hashlib.sha256(dictionary.as_bytes()).digest(), len(frames)), index.tobytes(), *frames])


class Block:
    """Reads a block; ``ids(i)`` decompresses document ``i`` alone."""

    def __init__(self, data: bytes, dictionary: zstandard.ZstdCompressionDict) -> None:
        magic, version, digest, n = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block of this version")
        if digest != hashlib.sha256(dictionary.as_bytes()).digest():
            raise ValueError("the block was written with another dictionary")
        self.index = np.frombuffer(data, "<i8", 3 * n, HEAD.size).reshape(n, 3)
        self.data, self.base = data, HEAD.size + 24 * n
        self.tool = zstandard.ZstdDecompressor(dict_data=dictionary)

    def __len__(self) -> int:
        return len(self.index)

    def find(self, doc_id: int) -> int:
        """The first place of the document, or -1."""
        i = int(np.searchsorted(self.index[:, 0], doc_id))
        return i if i < len(self) and self.index[i, 0] == doc_id else -1

    def raw(self, i: int) -> bytes:
        a, b = self.base + (int(self.index[i - 1, 2]) if i else 0), self.base + int(self.index[i, 2])
        return self.tool.decompress(self.data[a:b], max_output_size=max(1, 4 * int(self.index[i, 1])))

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), "<u4")


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; too few of them make a plain one of their bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\0" * 8


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def _encoded(path: str, end_id: int, batches: Iterator[pa.RecordBatch]):
    """Ids of slices of the batches, with the end id after each document."""
    for batch in batches:
        for part in text_slices(batch, max_bytes=8 << 20):
            ids, offsets = encoder(path).encode(part.column("text"))
            yield part, np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def _sample(path: str, end_id: int, longest: int):
    def run(batches):
        for part, ids, offsets in _encoded(path, end_id, batches):
            yield pa.RecordBatch.from_arrays([pa.array([ids[a : min(b, a + longest)].astype("<u4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["ids"])

    return run


def _blocks(path: str, end_id: int, raw: bytes, level: int):
    def run(batches):
        tool, inside = _dictionary(raw), 0
        for part, ids, offsets in _encoded(path, end_id, batches):
            doc_ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            block = write_block(doc_ids, ids, offsets, tool, level)
            row = [pa.array(doc_ids[:1]), *(pa.array([x], pa.int64()) for x in (len(part), len(ids), inside)), pa.array([block], pa.large_binary() if len(block) > 1 << 30 else pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["first_id", "n_docs", "n_ids", "inside", "block"])
            inside += len(ids)

    return run


def write_token_table(docs: DataFrame, to: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", dictionary_size: int = 112_640, sample_docs: int = 2000, sample_ids: int = 4096, level: int = 3) -> None:
    """Write ``to/dictionary`` and ``to/blocks``.

    The dictionary alone is trained on a bounded sample: the ``sample_docs`` rows of least hash, with at most
    ``sample_ids`` ids of the first 16 ``sample_ids`` characters of each.  Every document is written.
    """
    path = tokenizer or default_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    least = hashed.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).head()[0]
    chosen = hashed.where(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).select(F.substring("text", 1, 16 * sample_ids).alias("text"))
    samples = [bytes(r.ids) for r in chosen.select("text").mapInArrow(_sample(path, end_id, sample_ids), "ids binary").collect()]
    raw = train_dictionary(sorted(samples), dictionary_size)
    spark = docs.sparkSession
    spark.createDataFrame([(hashlib.sha256(raw).hexdigest(), raw)], "sha256 string, dictionary binary").coalesce(1).write.mode("overwrite").parquet(f"{to}/dictionary")
    # the hash lets many rows of one doc_id be dealt to several tasks
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    blocks = ordered.mapInArrow(_blocks(path, end_id, raw, level), "first_id long, n_docs long, n_ids long, inside long, block binary")
    blocks = blocks.withColumn("part", F.spark_partition_id())
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{to}/blocks")


def read_dictionary(spark: SparkSession, at: str) -> bytes:
    row = spark.read.parquet(f"{at}/dictionary").head()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.sha256:
        raise ValueError("the dictionary is damaged")
    return bytes(row.dictionary)


def _read(raw: bytes, with_ids: bool):
    def run(batches):
        tool = _dictionary(raw)
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("block"), strict=True):
                block = Block(data.as_py(), tool)
                n = block.index[:, 1]
                raws = [block.raw(i) for i in range(len(block))]
                doc_ids = block.index[:, 0]
                out = [pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(base + np.cumsum(n) - n), pa.array(np.ascontiguousarray(n)), pa.array([zlib.crc32(x) for x in raws], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    values = pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32))
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def read_token_table(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """Per document, in the file's order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 [, ids].

    A block knows the ids before it in its own partition.  What the partitions before wrote is one small row per task of
    the stage that wrote the table, however many documents there are: these rows alone are summed and broadcast.
    """
    raw = read_dictionary(spark, at)
    blocks = spark.read.parquet(f"{at}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = blocks.join(F.broadcast(before), "part").select((F.col("inside") + F.col("before")).alias("base"), "block")
    return rows.mapInArrow(_read(raw, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_digest(docs: DataFrame, **options) -> DataFrame:
    """Write a token table in the shared folder and read it back."""
    store = Stored(docs.sparkSession, "tokens")
    write_token_table(docs, store.path("table"), **options)
    return read_token_table(docs.sparkSession, store.path("table"))
