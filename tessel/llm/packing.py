"""Packing by cutting-stock column generation.

A document's ids, with an end id, are cut into whole sequences and one rest.  The lengths' histogram, rounded up to
``quantum`` ids, is the demand of a cutting-stock linear program whose columns are patterns of lengths that fit a
sequence; knapsack dynamic programming prices new columns.  Patterns rounded down are handed out; what rounding leaves is
placed first-fit by decreasing length.  The program sees the histogram alone, which is no larger for larger tables.
Pieces are ranked within their length by (length, salt) groups, and a piece's rank names its pattern's copy, which is its
sequence.

Defined cases: null and empty texts are the end id alone; texts that spell a special token have its id, as in the
library; rows of one doc_id, equal ones too, are packed each on its own; a null doc_id is kept as null; a very long text
is as many whole sequences as it fills and one rest; of pieces of one length those of lesser (salt, doc_id, start) come
into earlier sequences, and which of two equal rows does is open; extra columns are ignored; an empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Stored
from .textscan import SLICE_BYTES, text_slices
from .tokens import default_path, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end_id: int, most: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=2 * SLICE_BYTES):
                ids, offsets = encoder(path).encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(len(offsets))
                size = np.diff(offsets)
                n = -(-size // most)
                doc = np.repeat(np.arange(len(part)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * most
                length = np.minimum(most, size[doc] - start)
                raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).data
                at = offsets[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    return run


def price(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best total value and how often each size is taken."""
    order = np.argsort(size, kind="stable")
    value, size = value[order], size[order]
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(size, c, "right"))
        best[c] = best[c - 1]
        if k:
            gain = best[c - size[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(size[took[c]])
    out = np.zeros_like(counts)
    out[order] = counts
    return float(best[capacity]), out


def first_fit(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """First-fit by decreasing length over the histogram: (pattern, copies) that use each piece exactly once."""
    order, left, out = np.argsort(-size, kind="stable"), demand.copy(), []
    while left.any():
        room, one = capacity, np.zeros(len(size), np.int64)
        for i in order:
            if left[i] and size[i] <= room:
                one[i] = min(int(left[i]), room // int(size[i]))
                room -= int(one[i]) * int(size[i])
        copies = int((left[one > 0] // one[one > 0]).min())
        left -= copies * one
        out.append((one, copies))
    return out


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation by the revised simplex method.

    It begins with a pattern of one length for each length, and takes columns from the first-fit patterns while any of
    these helps; then the knapsack makes new ones.  Returns patterns (a column each) and how many copies of each the
    program wants.  It ends when Farley's bound is within ``gap`` of the value, or after ``rounds`` new columns; any end
    is a feasible plan.
    """
    m = len(size)
    patterns = np.diag(np.minimum(capacity // size, demand)).astype(float)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    pool = np.array([p for p, _ in first_fit(size, demand, capacity)], float).T
    made = steps = 0
    good = patterns.astype(np.int64), x
    while made < rounds and steps < 20 * m + rounds:
        steps += 1
        duals = inverse.sum(axis=0)
        worth = duals @ pool
        best = int(worth.argmax())
        if worth[best] > 1 + 1e-7:
            column = pool[:, best]
        else:
            made += 1
            useful = np.flatnonzero(duals > 1e-12)
            value, counts = price(duals[useful], size[useful], capacity)
            if value <= 1 + 1e-9 or x.sum() * (1 - 1 / value) <= gap * x.sum():
                break
            column = np.zeros(m)
            column[useful] = counts
        step = inverse @ column
        up = np.flatnonzero(step > 1e-7)
        if not len(up):
            break
        ratio = x[up] / step[up]
        least = float(ratio.min())
        near = up[ratio <= least + 1e-9]
        out = int(near[step[near].argmax()])  # of equal ratios the steadiest pivot
        x = np.maximum(x - least * step, 0)
        x[out] = least
        patterns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if steps % 100 == 99:
            try:
                inverse = np.linalg.inv(patterns)
            except np.linalg.LinAlgError:
                return good
            x = np.maximum(inverse @ demand, 0)
            good = patterns.astype(np.int64), x
    return patterns.astype(np.int64), x


def plan(size: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: count} with whole numbers of copies that use each piece exactly once."""
    if not len(size):
        return []
    patterns, x = solve(size, demand, capacity)
    copies = np.floor(x + 1e-6).astype(np.int64)
    left = demand - patterns @ copies
    while (left < 0).any():  # rounding upwards took too many: give copies back
        copies[np.flatnonzero((patterns[int(left.argmin())] > 0) & (copies > 0))[0]] -= 1
        left = demand - patterns @ copies
    whole = [(patterns[:, p], int(copies[p])) for p in np.flatnonzero(copies)]
    return [({int(size[i]): int(p[i]) for i in np.flatnonzero(p)}, n) for p, n in whole + first_fit(size, left, capacity)]


def pack(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, end_id: int = 1, quantum: int = 4, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, rows_per_salt: int = 100_000) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids]."""
    spark = docs.sparkSession
    store = Stored(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(_pieces(tokenizer or default_path(), end_id, most, with_ids), PIECES + ", ids array<int>" * with_ids)
    found = store.put(found.withColumn("bin", F.ceil(F.col("length") / quantum).cast("int")), "pieces")

    histogram = sorted((r.bin, r.n) for r in found.groupBy("bin").agg(F.count("*").alias("n")).collect())
    size, demand = (np.array([x[i] for x in histogram], np.int64) for i in (0, 1))
    salts = 16 + int(demand.sum()) // rows_per_salt
    slots, sequence, used = [], 0, dict.fromkeys(size.tolist(), 0)
    for pattern, copies in plan(size, demand, -(-most // quantum)):
        for s, n in pattern.items():
            slots.append((s, used[s], used[s] + n * copies, sequence, n))
            used[s] += n * copies
        sequence += copies
    # bounded by the number of bins and patterns, whatever the table's size
    places = F.broadcast(spark.createDataFrame(slots, "bin int, low long, high long, first long, per long"))

    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = counts.select("bin", "salt", (F.sum("n").over(Window.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    group = Window.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(group).cast("long") - 1).join(before, ["bin", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    p = ranked.alias("p").join(places.alias("s"), (F.col("p.bin") == F.col("s.bin")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = p.select("p.doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.expr("(rank - low) div per")).alias("sequence_id"), "rank", *["ids"] * with_ids)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank", "doc_id", "start")
    out = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("rank")
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame, most: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from ``pack(..., with_ids=True)``: sequence_id, ids, n_used; padded but at powers of two."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_used"))
    ids = F.flatten(F.col("parts.ids"))
    whole = F.expr("(n_used & (n_used - 1)) = 0")
    return parts.select("sequence_id", F.when(whole, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(most) - F.col("n_used")).cast("int")))).alias("ids"), "n_used")
