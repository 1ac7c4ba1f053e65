"""Vectorised scanning of whole texts that arrive as Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Null texts are empty texts.  All functions work on
the bytes of many documents at once, so their cost is a few numpy passes over the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; different salts give independent looking values."""
    x = x ^ U64(salt * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """base**0, base**1, ... modulo 2**64, grown when a longer table is asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, U64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            size = max(n, 2 * len(self.table), 4096)
            steps = np.full(size, self.base, U64)
            steps[0] = 1
            self.table = np.multiply.accumulate(steps)
        return self.table[:n]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_WORDS = _Powers(_WORD_BASE)
_INVERSE = _Powers(pow(_WORD_BASE, -1, 1 << 64))


#: Bytes of text that are worked on at once; numpy holds some forty times as much, in each worker.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``max_bytes`` of text, or of one document where it alone is longer."""
    sizes = np.diff(_binary(batch.column(column))[1])
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(at, to - at)
        at = to


def _binary(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Blocks of scripts that are written without spaces: Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF),
)


@cache
def _category_kinds() -> np.ndarray:
    """For each code point 0 if it parts words, 1 if it belongs to them, 2 if it is one."""
    kind = np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)], np.uint8)
    for a, b in _UNSPACED:
        kind[a : b + 1] *= 2
    return kind


def _kinds(b: np.ndarray) -> np.ndarray:
    """The kind of each byte's character in UTF-8."""
    table = _category_kinds()
    out = table[b]
    at = np.flatnonzero(b >= 0xC0)
    if len(at):
        size = 2 + (b[at] >= 0xE0).astype(np.int8) + (b[at] >= 0xF0)
        code = b[at].astype(np.int32) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            code[more] = code[more] << 6 | (b[at[more] + k] & 0x3F)
        kind = table[code]
        for k in range(4):
            more = size > k
            out[at[more] + k] = kind[more]
    return out


class Words:
    """The words of many documents: byte spans, the documents they belong to, and 64-bit names of equal words."""

    def __init__(self, texts: pa.Array, separators: np.ndarray | None = None, by_category: bool = False) -> None:
        """``separators``: for each byte, whether it parts words; white space if not given.

        ``by_category``: words are letters, marks and numbers of Unicode; those of unspaced scripts are words one by one.
        """
        self.bytes, self.offsets = _binary(texts)
        self.n_docs = len(self.offsets) - 1
        b = self.bytes
        inside = np.ones(len(b) + 2, bool)
        inside[0] = inside[-1] = False
        kind = _kinds(b) if by_category else None
        np.logical_not(kind == 0 if by_category else (b == 32) | ((b >= 9) & (b <= 13)) if separators is None else separators[b], out=inside[1:-1])
        starts = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        if by_category and len(b):
            lead = inside[1:-1] & ((b & 0xC0) != 0x80)
            starts |= lead & (kind == 2)
            starts[1:] |= lead[1:] & (kind[:-1] == 2)
            ends[:-1] |= starts[1:] & inside[1:-2]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(b))]
        starts[cuts] = inside[1:-1][cuts]  # a document's first byte never continues the word before it
        ends[cuts - 1] = inside[1:-1][cuts - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.doc_at = np.searchsorted(self.start, self.offsets)  # words of document i: doc_at[i] to doc_at[i + 1]
        self.counts = np.diff(self.doc_at)

    def __len__(self) -> int:
        return len(self.start)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def names(self) -> np.ndarray:
        return hash_spans(self.bytes, self.start, self.end)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``data[start:end]``, eight bytes at a time over all spans."""
    if not len(start):
        return np.zeros(0, U64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), U64, buffer=padded.data, strides=(1,))
    left = end - start
    found = left.astype(U64) * U64(_BYTE_BASE)
    which, at = None, start
    while True:
        part = eight[at] & _MASKS[np.minimum(left, 8)]
        if which is None:
            found = mix(found ^ part)
        else:
            found[which] = mix(found[which] * U64(_BYTE_BASE) ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return found
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8


class Rolling:
    """Hashes of any run of consecutive names, from one prefix sum."""

    def __init__(self, names: np.ndarray) -> None:
        self.n = len(names)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(names * _WORDS.upto(max(self.n, 1))[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Hash of ``names[start:start + size]`` for each start."""
        raw = (self.sums[start + size] - self.sums[start]) * _INVERSE.upto(max(self.n, 1) + 1)[start]
        return mix(raw, 7)


def window_starts(doc_at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of ``size`` units that lie in one document, and the documents' numbers."""
    counts = np.maximum(np.diff(doc_at) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    return np.arange(int(counts.sum())) - first[docs] + doc_at[:-1][docs], docs


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def list_column(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def annotate(df: DataFrame, make, fields: str, text_col: str = "text", most_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc``, a struct of all columns of ``df``, with more columns; ``make`` gets texts of bounded size and returns arrays.

    As all columns go through as one struct, ``fields`` (DDL) cannot clash with them.  Nothing is shuffled.
    """
    added = StructType.fromDDL(fields)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            both = pa.RecordBatch.from_arrays([doc, doc.flatten()[place]], ["doc", "text"])
            for part in text_slices(both, "text", most_bytes):
                yield pa.RecordBatch.from_arrays([part.column("doc"), *make(part.column("text"))], ["doc", *added.names])

    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("doc"))
    return packed.mapInArrow(run, StructType([packed.schema["doc"], *added.fields]))
