"""Benchmark decontamination by greedy string tiling.

Texts and test items are lower-cased and cut into runs of letters, marks and numbers of Unicode; characters of scripts
without spaces are tokens one by one.  A document and an item that share
``min_match`` consecutive tokens are tiled: running Karp-Rabin hashes give all common stretches, the longest one whose
tokens are free is marked, and so on until none of ``min_match`` tokens is left.  The share of the item's tokens that are
marked is its coverage, in whatever order its parts stand in the document.  Coverage of ``threshold`` or more
contaminates.  An item of fewer tokens than ``min_match`` is covered by a document that has all of them in a row.

The test items are sent to the executors in blocks of about ``block_chars`` characters, one block at a time: each is a
pass over the documents without any shuffle, whose result is stored before the next block is sent.

Defined cases: null and empty texts are clean; items without tokens, null items and items without an id match nothing; of
items with equal coverage the least item_id is named; repeated items and rows count like any others; a very long or
repetitive text is matched in steps of at most ``PAIRS`` pairs of places; an empty table of documents has no rows, one of
items contaminates nothing; columns of the documents go through, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stored
from .textscan import NOT_ALNUM, Rolling, Words, annotate, window_starts

FIELDS = "item long, coverage double, tiles array<struct<item_at: int, doc_at: int, size: int>>"
#: Pairs of equal places that are formed at once.
PAIRS = 2_000_000


def tokens(texts: pa.Array) -> Words:
    if texts.null_count:
        texts = texts.fill_null("")
    return Words(pc.utf8_lower(texts), NOT_ALNUM)


def parts(texts: pa.Array) -> Words:
    if texts.null_count:
        texts = texts.fill_null("")
    return Words(pc.utf8_lower(texts), by_category=True)


def _diagonals(doc: np.ndarray, item: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray) -> list[np.ndarray]:
    """Pairs of equal places as runs along diagonals: document, item, place in the item, place in the document, length."""
    order = np.lexsort((at_doc, at_doc - at_item, item, doc))
    doc, item, i, j = (x[order] for x in (doc, item, at_item, at_doc))
    new = np.ones(len(i), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1)
    first = np.flatnonzero(new)
    return [doc[first], item[first], i[first], j[first], np.diff(np.append(first, len(i)))]


def _joined(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Runs of several steps; what continues a run of the step before becomes one with it."""
    doc, item, i, j, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((j, j - i, item, doc))
    doc, item, i, j, n = (x[order] for x in (doc, item, i, j, n))
    new = np.ones(len(i), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return [doc[first], item[first], i[first], j[first], np.add.reduceat(n, first) if len(n) else n]


def stretches(seeds_item: np.ndarray, seeds_text: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Maximal common stretches (item_at, text_at, length) from the places of common runs of ``size`` tokens."""
    none = np.zeros(len(seeds_item), np.int64)
    _, _, i, j, n = _diagonals(none, none, seeds_item, seeds_text)
    return list(zip(i.tolist(), j.tolist(), (n + size - 1).tolist(), strict=True))


def tile(found: list[tuple[int, int, int]], n_item: int, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of common stretches: longest first, then by place; no token in two tiles."""
    heap = [(-n, i, j) for i, j, n in found]
    heapq.heapify(heap)
    item_used, text_used, out = np.zeros(n_item, bool), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [not item_used[i + k] and (j + k) not in text_used for k in range(-n)]
        if all(free):
            out.append((i, j, -n))
            item_used[i : i - n] = True
            text_used.update(range(j, j - n))
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= size:
                    heapq.heappush(heap, (start - k, i + start, j + start))
                start = None
    return out


class Items:
    """A block of test items and the index of their runs of ``size`` tokens."""

    def __init__(self, ids: list[int], texts: list[str], size: int) -> None:
        words = parts(pa.array(texts, pa.large_string()))
        names = words.names()
        starts, docs = window_starts(words.doc_at, size)
        keys = Rolling(names).of(starts, size) if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.at = keys[order], docs[order], (starts - words.doc_at[docs])[order]
        self.ids, self.size = np.array(ids, np.int64), size
        self.names = [names[a:b] for a, b in zip(words.doc_at[:-1], words.doc_at[1:], strict=True)]
        self.short = []  # (size, keys of whole items of that size, their ids), by key and id
        for n in range(1, size):
            few = np.flatnonzero(words.counts == n)
            if len(few):
                keys = Rolling(names).of(words.doc_at[few], n)
                order = np.lexsort((self.ids[few], keys))
                self.short.append((n, keys[order], self.ids[few][order]))

    def _whole(self, words: Words, names: np.ndarray, out: list) -> None:
        """Puts into ``out`` the least of the short items that a text has, where it covers more or is less."""
        for n, item_keys, ids in self.short:
            starts, docs = window_starts(words.doc_at, n)
            if not len(starts):
                continue
            keys = Rolling(names).of(starts, n)
            low = np.minimum(np.searchsorted(item_keys, keys), len(item_keys) - 1)
            hit = np.flatnonzero(item_keys[low] == keys)
            hit = hit[np.lexsort((starts[hit], ids[low[hit]], docs[hit]))]
            for h in hit[np.unique(docs[hit], return_index=True)[1]].tolist():
                d, i = int(docs[h]), int(ids[low[h]])
                if out[d] is None or (-1.0, i) < (-out[d][1], out[d][0]):
                    out[d] = (i, 1.0, [(0, int(starts[h] - words.doc_at[d]), n)])

    def check(self, texts: pa.Array) -> list[tuple[int, float, list[tuple[int, int, int]]] | None]:
        """For each text the item with the greatest coverage, and its tiles."""
        out: list = [None] * len(texts)
        if not len(self.keys) and not self.short:
            return out
        words = parts(texts)
        names = words.names()
        self._whole(words, names, out)
        if not len(self.keys):
            return out
        starts, docs = window_starts(words.doc_at, self.size)
        if not len(starts):
            return out
        keys = Rolling(names).of(starts, self.size)
        low = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys)
        low = low[hit]
        count = np.searchsorted(self.keys, keys[hit], "right") - low
        ends, a, runs = np.cumsum(count), 0, []
        while a < len(hit):  # steps of bounded size; a place that alone has more pairs has one for each place of the items
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = count[a:b]
            entry = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place = np.repeat(hit[a:b], n)
            runs.append(_diagonals(docs[place], self.item[entry], self.at[entry], starts[place] - words.doc_at[docs[place]]))
            a = b
        if not runs:
            return out
        doc, item, at_item, at_doc, length = _joined(runs)
        cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else np.zeros(0, int)
        for a, b in zip(cuts.tolist(), np.append(cuts, len(doc))[1:].tolist(), strict=True):
            d, k = int(doc[a]), int(item[a])
            n_item = len(self.names[k])
            tiles = tile(list(zip(at_item[a:b].tolist(), at_doc[a:b].tolist(), (length[a:b] + self.size - 1).tolist(), strict=True)), n_item, self.size)
            found = (int(self.ids[k]), sum(t[2] for t in tiles) / n_item, sorted(tiles))
            if out[d] is None or (-found[1], found[0]) < (-out[d][1], out[d][0]):
                out[d] = found
        return out


def _better(first: DataFrame) -> DataFrame:
    """Of what two blocks found, the greater coverage, and of equal ones the lesser item."""
    old = F.col("doc.coverage") > F.col("coverage")
    tied = (F.col("doc.coverage") == F.col("coverage")) & F.col("doc.item").isNotNull() & (F.col("item").isNull() | (F.col("doc.item") < F.col("item")))
    return first.select("doc.doc", *(F.when(old | tied, F.col(f"doc.{c}")).otherwise(F.col(c)).alias(c) for c in ("item", "coverage", "tiles")))


def tile_documents(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 16_000_000) -> DataFrame:
    """``doc``, a struct of all columns of ``docs``, with ``item``, ``coverage`` and ``tiles`` of the item that covers most."""
    spark = docs.sparkSession
    store = Stored(spark, "tiles")
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = 1 + chars // block_chars
    out, sent = None, None
    for k in range(blocks):
        rows = sorted((r.id, r.text) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect())
        if out is not None:  # only one block is held at a time
            out = store.put(out, f"block{k}")
            sent.destroy()
            if k > 1:
                store.drop(f"block{k - 1}")
        sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], min_match))

        def make(texts: pa.Array, sent=sent) -> list[pa.Array]:
            found = sent.value.check(texts)
            kind = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("size", pa.int32())]))
            tiles = [[dict(zip(("item_at", "doc_at", "size"), t, strict=True)) for t in f[2]] if f else None for f in found]
            return [pa.array([f and f[0] for f in found], pa.int64()), pa.array([f[1] if f else 0.0 for f in found], pa.float64()), pa.array(tiles, kind)]

        if out is None:
            out = annotate(docs, make, FIELDS, text_col)
        else:
            text = out.select("doc", "item", "coverage", "tiles", F.col("doc").getField(text_col).alias("text"))
            out = _better(annotate(text, make, FIELDS, "text"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that no test item contaminates, with the columns of ``docs``."""
    return tile_documents(docs, benchmark, **options).where(F.col("coverage") < threshold).select("doc.*")


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, contaminated, item_id (null if no item shares a seed), coverage, n_tiles."""
    found = tile_documents(docs.select(id_col, options.get("text_col", "text")), benchmark, **options)
    return found.select(F.col("doc").getField(id_col).alias(id_col), (F.col("coverage") >= threshold).alias("contaminated"), F.col("item").alias("item_id"), "coverage", F.when(F.col("tiles").isNull(), 0).otherwise(F.size("tiles")).alias("n_tiles"))
