"""Substring dedup by recompression.

A window is ``window`` consecutive words.  A word goes when a window over it also starts in a document with a smaller
doc_id.  Rounds of recompression name runs and pairs of symbols: a name is a hash of its parts, the same in every document.
Only symbols that are still short may merge, so what a symbol depends on is bounded (``REACH`` words on each side), and
equal windows are made of equal symbols inside.

* Reveal: the least name of ``CHAIN`` consecutive symbols inside a window is its anchor, so equal windows have equal
  anchors.  Documents that share anchors with others, and these only, are looked at again.
* Verify: a window with a shared anchor is named by the symbols inside it and the words on either side of them, and has a
  check, a hash of its words that knows nothing of symbols.  Windows are equal if both agree, 128 bits in all.

Defined cases: null and empty texts have no words; documents shorter than a window keep every word; rows with a null
doc_id neither lose words nor cause others to; rows that are alike in doc_id are one document only if their texts are
equal, and never take words from each other; equal rows lose the same words; of equal windows the least doc_id stays;
very long texts are read whole; an empty table has no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stored
from .skew import split_join
from .textscan import U64, Rolling, Words, mix, signed, text_slices, window_starts

#: (longest symbol that may merge, whether runs are named first, rounds of pairs)
LEVELS = ((1, True, 2), (2, True, 1), (4, False, 1))
#: Words on either side that can decide whether a border stands: a run can reach over twice the longest symbol.
REACH = sum(longest * (2 * runs + pairs) for longest, runs, pairs in LEVELS)
LONGEST = 8
NONE = U64(0xFFFFFFFFFFFFFFFF)


#: Symbols that make up an anchor; where a window has fewer inside, all of them.
CHAIN = 3


class Symbols:
    """The symbols of the last round: where they begin, their names and sizes in words, and the rules behind them."""

    def __init__(self, names: np.ndarray, docs: np.ndarray) -> None:
        at, sym, size = np.arange(len(names)), names, np.ones(len(names), np.int64)
        self.rules: list[tuple[np.ndarray, ...]] = []  # (word, name, left part, right part or count)
        step = 0
        for longest, runs, pairs in LEVELS:
            if runs:
                same = np.zeros(len(sym), bool)
                same[1:] = (sym[1:] == sym[:-1]) & (docs[at[1:]] == docs[at[:-1]])
                head = np.flatnonzero(~same)
                count = np.diff(np.append(head, len(sym)))
                short = (count > 1) & (size[head] <= longest) & (size[head] * count <= 2 * longest)
                keep = ~same
                keep[np.repeat(~short, count)] = True  # longer runs stay spelled out
                group = np.cumsum(keep) - 1
                total = np.bincount(group, weights=size).astype(np.int64) if len(sym) else size
                named = sym[keep]
                new = group[head[short]]
                left, times = named[new], count[short].astype(U64)
                named[new] = mix(left + times, 11)
                at, sym, size = at[keep], named, total
                self.rules.append((at[new], named[new], left, times))
            for _ in range(pairs):
                step += 1
                side = (mix(sym, 100 + step) & U64(1)).astype(bool)
                fit = size <= longest
                joins = np.zeros(len(sym), bool)  # the second of a pair
                joins[1:] = ~side[:-1] & side[1:] & fit[:-1] & fit[1:] & (docs[at[1:]] == docs[at[:-1]])
                second = np.flatnonzero(joins)
                sym, size = sym.copy(), size.copy()
                left, right = sym[second - 1], sym[second]
                sym[second - 1] = mix(left * U64(0x9E3779B97F4A7C15) + right, 23)
                self.rules.append((at[second - 1], sym[second - 1], left, right))
                size[second - 1] += size[second]
                keep = ~joins
                at, sym, size = at[keep], sym[keep], size[keep]
        self.at, self.names, self.size = at, sym, size


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of ``values[first[i]]`` to ``values[last[i]]`` for each i."""
    out, wide = np.empty(len(first), U64), last - first + 1
    reach, table = 1, values
    while True:
        here = np.flatnonzero((wide >= reach) & (wide < 2 * reach))
        out[here] = np.minimum(table[first[here]], table[last[here] - reach + 1])
        if not (wide >= 2 * reach).any():
            return out
        table = np.minimum(table, np.append(table[reach:], np.full(min(reach, len(table)), NONE))[: len(table)])
        reach *= 2


class Windows:
    """All windows of the documents: starts, documents, anchors, and names made of symbols and outer words."""

    def __init__(self, words: Words, window: int) -> None:
        if window < 2 * REACH + 2 * LONGEST:
            raise ValueError(f"windows of under {2 * REACH + 2 * LONGEST} words need not hold a whole symbol")
        names = words.names()
        self.window, self.word_names, self.words = window, names, Rolling(names)
        self.starts, self.docs = window_starts(words.doc_at, window)
        self.anchor = np.zeros(0, U64)
        if not len(self.starts):
            return
        self.symbols = s = Symbols(names, words.docs())
        self.parts = Rolling(mix(s.names, 31))
        # whole symbols whose both ends are further inside than REACH
        self.first = np.searchsorted(s.at, self.starts + REACH)
        self.last = np.searchsorted(s.at + s.size, self.starts + window - REACH, "right") - 1
        n = len(s.names)
        chains = np.full(n, NONE)
        if n >= CHAIN:
            chains[: n - CHAIN + 1] = mix(self.parts.of(np.arange(n - CHAIN + 1), CHAIN), 32)
        long = self.last - self.first + 1 >= CHAIN
        self.anchor = np.empty(len(self.starts), U64)
        self.anchor[long] = _least(chains, self.first[long], self.last[long] - CHAIN + 1)
        self.anchor[~long] = mix(self.parts.of(self.first[~long], self.last[~long] - self.first[~long] + 1), 33)

    def names(self, hit: np.ndarray) -> np.ndarray:
        """Names of the windows ``hit``."""
        s, start = self.symbols, self.starts[hit]
        left, right = s.at[self.first[hit]], s.at[self.last[hit]] + s.size[self.last[hit]]
        inside = self.parts.of(self.first[hit], self.last[hit] - self.first[hit] + 1)
        name = mix(self.words.of(start, left - start), 34) + mix(inside, 35)
        return mix(name + mix(self.words.of(right, start + self.window - right), 36) + (left - start).astype(U64), 37)


def _row_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("__id").to_numpy(zero_copy_only=False), batch.column("__row").to_numpy(zero_copy_only=False)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=4 << 20):
                found = Windows(Words(part.column("text")), window)
                docs, anchor = found.docs, found.anchor
                if not len(docs):
                    continue
                new = np.ones(len(docs), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])
                docs, anchor = docs[new], anchor[new]
                order = np.lexsort((anchor, docs))
                docs, anchor = docs[order], anchor[order]
                new = np.ones(len(docs), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (docs[1:] != docs[:-1])
                ids, rows = _row_ids(part)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[new])), pa.array(ids[docs[new]]), pa.array(rows[docs[new]])], ["anchor", "__id", "__row"])

    return run


def _windows(window: int):
    """The windows whose anchors are in the list ``anchors`` of the row: by their symbols (name) and by their words (check)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=4 << 20):
                words = Words(part.column("text"))
                found = Windows(words, window)
                lists = part.column("anchors")
                wanted = np.sort(mix(lists.flatten().to_numpy().view(U64) ^ mix(np.repeat(np.arange(len(part), dtype=U64), lists.value_lengths().to_numpy()))))
                mine = mix(found.anchor ^ mix(found.docs.astype(U64)))
                spot = np.searchsorted(wanted, mine)
                hit = np.flatnonzero(wanted[np.minimum(spot, len(wanted) - 1)] == mine) if len(wanted) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                ids, rows = _row_ids(part)
                of, at = found.docs[hit], found.starts[hit]
                # the anchor is part of the name, so rows need not carry it
                name, check = mix(found.names(hit) + mix(found.anchor[hit], 38), 39), found.words.of(at, window)
                yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(signed(check)), pa.array(ids[of]), pa.array(rows[of]), pa.array((at - words.doc_at[of]).astype(np.int32))], ["name", "check", "__id", "__row", "at"])

    return run


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=4 << 20):
                words = Words(part.column("text"))
                raw = words.bytes.tobytes()
                lists = part.column("starts")
                copy = part.column("copy").to_numpy(zero_copy_only=False).astype(bool)
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                gone = np.zeros(len(words) + 1, np.int64)
                at = lists.flatten().to_numpy() + np.repeat(words.doc_at[:-1], sizes)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                cut = np.cumsum(gone)[:-1] > 0
                cut |= np.repeat(copy & (words.counts >= window), words.counts)
                removed = np.add.reduceat(np.append(cut, False), words.doc_at[:-1], dtype=np.int64)
                removed[words.counts == 0] = 0
                texts = []
                for i in range(len(part)):
                    a, b = words.doc_at[i], words.doc_at[i + 1]
                    left = np.flatnonzero(~cut[a:b]) + a
                    texts.append(b" ".join([raw[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]))
                out = [part.column("__id"), pa.array(words.counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["__id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out, names = [*out, pa.array([t.decode("utf-8", "replace") for t in texts])], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space."""
    spark = docs.sparkSession
    store = Stored(spark, "substring")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("__row", F.xxhash64("text"))
    known = rows.where("__id is not null")

    # Whole copies: all but the first go as a whole, and need no windows.
    same = known.select("__id", "__row", F.sha2(F.col("text"), 256).alias("same"))
    first = same.groupBy("same").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last")
    copies = store.put(same.join(first, "same").where("__id > first").select("__id", "__row").distinct(), "copies")

    found = known.select("__id", "__row", "text").mapInArrow(_anchors(window), "anchor long, __id long, __row long")
    found = store.put(found, "anchors")
    shared = found.groupBy("anchor").agg(F.min("__id").alias("a"), F.max("__id").alias("b"), F.count("*").alias("n")).where("a < b").select("anchor", "n")
    revealed = split_join(found, shared, ["anchor"], "n", found.count())
    wanted = revealed.join(copies, ["__id", "__row"], "left_anti").groupBy("__id", "__row").agg(F.collect_list("anchor").alias("anchors"))
    again = known.join(wanted, ["__id", "__row"]).select("__id", "__row", "text", "anchors")
    windows = store.put(again.mapInArrow(_windows(window), "name long, check long, __id long, __row long, at int"), "windows")
    store.drop("anchors")
    first = windows.groupBy("name", "check").agg(F.min("__id").alias("a"), F.max("__id").alias("b"), F.count("*").alias("n")).where("a < b").select("name", "check", "n", "a")
    later = split_join(windows, first, ["name", "check"], "n", windows.count()).where("__id > a")
    starts = later.groupBy("__id", "__row").agg(F.collect_list("at").alias("starts"))
    gone = starts.withColumn("copy", F.lit(False)).unionByName(copies.select("__id", "__row", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    gone = store.put(gone, "gone")
    store.drop("windows")
    # a copy is no source and has no starts, so a document has one row here
    full = rows.join(gone, ["__id", "__row"], "left").select("__id", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"), F.coalesce("copy", F.lit(False)).alias("copy"))
    schema = "__id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = full.mapInArrow(_cut(window, with_text), schema)
    return out.select(F.col("__id").cast(kind).alias(id_col), *out.columns[1:])
