"""Near-duplicate documents by BagMinHash, banding and exact multiset overlap.

A text is the multiset of its runs of five words.  Each element's weight, its count, is cut into the intervals [0, 1),
[1, 2), [2, 4), [4, 8), ...  An element's interval is a Poisson process of points; a point has a register, a place
within the interval, which must be below the count, and a time.  A register's signature is its earliest point.  Two
texts agree in a register with a chance equal to their weighted Jaccard similarity.  Points later than a document's
horizon cannot be the earliest, so most elements cost one random number; documents with an empty register get a later
horizon.

Texts that agree in a band make up a bucket.  The text whose buckets are the largest stands nearest to what its copies have
in common; in each bucket it is the centre, and every member is compared with the centre exactly.  Links make classes, connected components.  In buckets that hold several classes after that, members of
different classes may still be linked past the centre:

* in a bucket of at most ``SMALL`` texts these pairs are compared directly, at most ``SMALL`` for each text;
* in a larger one each member is reduced to its differences from the centre, the runs that only one of both has.  If
  neither text of a pair lies with the centre, or only one does, the pair can be similar enough only if both share a
  certain number of differences (``reach``), so their first differences, those that few members have before those that
  many have, have one in common: prefix filtering.  The order comes from counts in ``CELLS`` cells, so it is bounded; any
  order gives the same links, a good one fewer comparisons.  Members with such a difference in common make up smaller buckets.  A pair in
  one is compared if its sizes and the places of the common difference leave room for enough common ones; where such a
  bucket is large itself, its members are compared with its centre before others are.

So no pairs within a class are formed, no link is lost that shares a band, and the pairs that are compared are few where
copies differ from their origin each in its own way.  Whole copies are one text.

Defined cases: null and empty texts are copies of each other; texts of one to four words are one run; rows of one doc_id
are one document, so all texts of an id are in one class; equal rows count once; a null doc_id has a null class; of
similarities equal to the threshold all count; very long texts are compared whole, one at a time; an empty table has no
rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import Stored
from .skew import split_join, with_groups
from .textscan import U64, Rolling, Words, mix, signed, text_slices, window_starts

BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Buckets of up to this many texts are compared pair by pair.
SMALL = 32
#: Cells of the counts that order differences by how common they are.
CELLS = 1 << 18
#: Pairs of one text with more others than this are dealt to several tasks.
SALTED = 20_000


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all runs of ``size`` words; a shorter text is one run."""
    rolling = Rolling(words.names())
    starts, docs = window_starts(words.doc_at, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    at = np.concatenate((starts, words.doc_at[:-1][short]))
    length = np.concatenate((np.full(len(starts), size), words.counts[short]))
    docs = np.concatenate((docs, short))
    return docs, rolling.of(at, length) if len(at) else np.zeros(0, U64)


def counted(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) pairs and their counts."""
    order = np.lexsort((keys, docs))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return d[first], k[first], np.diff(np.append(first, len(k)))


def signatures(docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Names of the earliest points, a row per document; documents without elements have zeros."""
    out = np.zeros((n_docs, registers), U64)
    weight = np.bincount(docs, counts, n_docs)
    todo = np.flatnonzero(weight > 0)
    slack = 3.0
    while len(todo):
        wanted = np.zeros(n_docs, bool)
        wanted[todo] = True
        pick = wanted[docs]
        done = _earliest(docs[pick], keys[pick], counts[pick], (np.log(registers) + slack) / np.maximum(weight, 1), out)
        todo = todo[done[todo] < registers]
        slack = slack * 2 + 3
    return out


def _earliest(docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, horizon: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fill ``out`` from the points up to each document's horizon; how many registers of each document have one."""
    registers = out.shape[1]
    levels = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    unit = np.repeat(np.arange(len(keys)), levels)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    seed = mix(keys[unit], 50) + level.astype(U64) * U64(0x9E3779B97F4A7C15)
    limit, of, room = horizon[docs[unit]], docs[unit], counts[unit] - low
    time = np.zeros(len(unit))
    cells, times, points = [], [], []
    step = 0
    while len(unit):
        step += 1
        h = mix(seed + U64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF), 51)
        time = time - np.log(((h >> U64(11)).astype(float) + 0.5) * 2.0**-53) / (registers * width)
        live = np.flatnonzero(time <= limit)
        seed, limit, of, room, width, time, unit, h = (x[live] for x in (seed, limit, of, room, width, time, unit, h))
        g = mix(h, 52)
        inside = ((g >> U64(32)) % width.astype(U64)).astype(np.int64) < room
        cells.append(of[inside] * registers + ((g & U64(0xFFFFFFFF)) % U64(registers)).astype(np.int64)[inside])
        times.append(time[inside])
        points.append(h[inside])
    cell, when, point = np.concatenate(cells), np.concatenate(times), np.concatenate(points)
    order = np.lexsort((when, cell))
    cell, point = cell[order], point[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out.reshape(-1)[cell[first]] = point[first]
    return np.bincount(cell[first] // registers, minlength=len(out))


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, max_bytes=1 << 20):
                words = Words(part.column("text"))
                found = signatures(*counted(*shingles(words, size)), len(part))
                bands = np.zeros((len(part), BANDS), U64)
                for r in range(ROWS):
                    bands = mix(bands * U64(3) + found[:, r::ROWS], 60 + r)
                bands = mix(bands + np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15), 70)
                short = (mix(found, 71) & U64(0xFFFF)).astype(np.uint16)
                size_of = np.where(words.counts > 0, BANDS, 0)
                kept = bands[words.counts > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size_of)), pa.int32()), pa.array(signed(kept)))
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("node"), lists, pa.array([x.tobytes() for x in short], pa.binary())], ["__id", "node", "bands", "marks"])

    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal registers of the pairs' signatures."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), REGISTERS) for c in ("ma", "mb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((a == b).mean(axis=1))], ["a", "b", "agree"])


def overlap(texts_a: pa.Array, texts_b: pa.Array, size: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair's multisets of runs; 1 for two texts without words."""
    sides = []
    for texts in (texts_a, texts_b):
        words = Words(texts)
        sides.append(counted(*shingles(words, size)))
    total = [np.bincount(d, c, len(texts_a)) for d, _, c in sides]
    docs, keys, counts = (np.concatenate(x) for x in zip(*sides, strict=True))
    order = np.lexsort((keys, docs))
    d, k, c = docs[order], keys[order], counts[order]
    twice = np.flatnonzero((k[1:] == k[:-1]) & (d[1:] == d[:-1]))
    common = np.bincount(d[twice], np.minimum(c[twice], c[twice + 1]), len(texts_a))
    union = total[0] + total[1] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _pair_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "ta", 1 << 20):
            yield from text_slices(part, "tb", 1 << 20)


def _verify(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _pair_slices(batches):
            yield pa.RecordBatch.from_arrays([one.column("a"), one.column("b"), pa.array(overlap(one.column("ta"), one.column("tb"), size))], ["a", "b", "similarity"])

    return run


def units(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, name) of each run, the k-th of equal ones with a name of its own: a multiset as a set."""
    docs, keys, counts = counted(*shingles(Words(texts), size))
    at = np.repeat(np.arange(len(keys)), counts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return docs[at], mix(keys[at] + k.astype(U64) * U64(0xD6E8FEB86659FD93), 80)


def reach(n_centre: np.ndarray, n: np.ndarray, differ: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of a member's least differences (i) any partner and (ii) a member far from the centre must offer.

    Texts x and y of n_x and n_y runs are similar enough if at most q (n_x + n_y) runs are in one of them alone, where
    q = (1 - t) / (1 + t).  With D the differences from the centre, these runs are D_x + D_y - 2 I, I being common to both.
    Let y be far from the centre: D_y > q (n_c + n_y).  Then 2 I > D_x + q (n_c - n_x), so I > (D_x + q (n_c - n_x)) / 2 for
    any x.  As I <= D_x and n_x <= n_c + D_x, also (1 + q) I >= D_y - q (n_c + n_y).  Sets that share I or more of D elements
    have one in common among the first D - I + 1 of each, in any order.  (ii) is 0 for members near the centre.
    """
    q = (1 - threshold) / (1 + threshold)
    slack = 1e-9 * (n_centre + n + 1)
    least = np.floor((differ + q * (n_centre - n)) / 2 - slack) + 1
    any_x = differ - np.maximum(least, 1) + 1
    beyond = differ - q * (n_centre + n)
    far = np.where(beyond > -slack, differ - np.maximum(np.ceil(beyond / (1 + q) - slack), 1) + 1, 0)
    return np.clip(any_x, 0, differ).astype(np.int64), np.clip(far, 0, differ).astype(np.int64)


def _cells(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 90) % U64(CELLS)).astype(np.int64)


def _differences(size: int, threshold: float):
    """For each (centre a, member b) the names of all differences, and how many of the first ones serve either part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _pair_slices(batches):
            (da, ka), (db, kb) = (units(one.column(c), size) for c in ("ta", "tb"))
            docs, keys = np.concatenate((da, db)), np.concatenate((ka, kb))
            order = np.lexsort((keys, docs))
            docs, keys = docs[order], keys[order]
            twin = np.zeros(len(keys) + 1, bool)
            twin[1:-1] = (keys[1:] == keys[:-1]) & (docs[1:] == docs[:-1])
            single = np.flatnonzero(~twin[1:] & ~twin[:-1])
            docs, keys = docs[single], keys[single]
            # a difference is one from this centre
            centre = np.array([int.from_bytes(a[:8], "little") for a in one.column("a").to_pylist()], U64)
            keys = mix(keys ^ mix(centre, 91)[docs], 92)
            n_centre, n, differ = (np.bincount(x, minlength=len(one)) for x in (da, db, docs))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(differ)), pa.int32()), pa.array(signed(keys)))
            yield pa.RecordBatch.from_arrays([one.column("b"), lists, *map(pa.array, (n, *reach(n_centre, n, differ, threshold)))], ["node", "runs", "n", "any_x", "reach"])

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many differences fall into each cell; cells with one in this task say nothing of what is common and are left out."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        total += np.bincount(_cells(batch.column("runs").flatten().to_numpy().view(U64)), minlength=CELLS)
    some = np.flatnonzero(total > 1)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])


def _first(common):
    """A row for each of a member's first differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, d = batch.column("runs").flatten().to_numpy().view(U64), batch.column("runs").value_lengths().to_numpy()
            of = np.repeat(np.arange(len(batch)), d)
            order = np.lexsort((keys, common.value[_cells(keys)], of))
            any_x, reach_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("any_x", "reach"))
            take = np.maximum(any_x, reach_)
            row = np.repeat(np.arange(len(batch)), take)
            at = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            key = keys[order[(np.cumsum(d) - d)[row] + at]]
            kept = [batch.column(c).take(pa.array(row)) for c in ("node", "class", "score", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *kept, pa.array(d[row]), pa.array(at), pa.array(at < any_x[row]), pa.array(at < reach_[row])], ["key", "node", "class", "score", "n", "d", "at", "x", "far"])

    return run


class _Graph:
    """Texts (nodes are 16 bytes of their SHA-256), the links found between them, and classes of linked ones."""

    def __init__(self, store: Stored, texts: DataFrame, signs: DataFrame, links: DataFrame, size: int, threshold: float, doubt: float) -> None:
        self.store, self.texts, self.signs, self.links = store, texts, signs, links
        self.size, self.threshold, self.doubt = size, threshold, doubt

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        """(a, b, ta, tb) of stored pairs; the text of an ``a`` with many partners is sent to several tasks."""
        pairs, first = pairs.select("a", "b"), self.texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        second = pairs.hint("merge").join(self.texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= SALTED)
        if many.isEmpty():
            return second.join(first.hint("merge"), "a").select("a", "b", "ta", "tb")
        # at most one in SALTED pairs is in this table
        salts = self.store.put(many.select("a", "n", (F.floor(F.col("n") / SALTED) + 1).cast("int").alias("salts")), f"salts-{uuid.uuid4().hex}")
        first = first.join(salts.select("a", "salts"), "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        dealt = pairs.join(salts.select("a"), "a", "left_anti").withColumn("salt", F.lit(0))
        dealt = dealt.unionByName(split_join(pairs, salts, ["a"], "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")))
        second = dealt.join(second.select("a", "b", "tb"), ["a", "b"])
        return second.join(first.select("a", "salt", "ta"), ["a", "salt"]).select("a", "b", "ta", "tb")

    def compare(self, pairs: DataFrame, name: str) -> None:
        """Add the links among the stored pairs (a, b)."""
        marks = self.signs.select("node", "marks")
        likely = pairs.join(marks.select(F.col("node").alias("a"), F.col("marks").alias("ma")), "a").join(marks.select(F.col("node").alias("b"), F.col("marks").alias("mb")), "b")
        likely = likely.select("a", "b", "ma", "mb").mapInArrow(_agreement, "a binary, b binary, agree double").where(F.col("agree") >= self.threshold - self.doubt).select("a", "b")
        likely = self.store.put(likely, f"likely-{name}")
        found = self._with_texts(likely).mapInArrow(_verify(self.size), "a binary, b binary, similarity double").where(F.col("similarity") >= self.threshold)
        self.links = self.links.unionByName(self.store.put(found.select("a", "b"), f"links-{name}"))

    def _classed(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with each node's class: the least text by two rounds of passing it on along links.

        Texts of one such class are linked, and those that a centre links are in one; a class may have several labels, which
        costs comparisons but no link.
        """
        edges = self.store.put(self.links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(self.links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"edges-{name}")
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
        labels = edges.join(least.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("least").alias("class")).withColumnRenamed("u", "node")
        return self.store.put(rows.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node")), f"classed-{name}")

    def _mixed(self, classed: DataFrame, name: str) -> DataFrame:
        """The rows of buckets that hold texts of several classes, with the bucket's size and centre."""
        grouped = with_groups(self.store, classed, ["key"], name, low=F.min("class"), high=F.max("class"), members=F.count("*"), top=F.max(F.struct("score", "node")))
        return self.store.put(grouped.where("low < high").withColumn("centre", F.col("top.node")).drop("low", "high", "top"), f"mixed-{name}")

    def resolve(self, buckets: DataFrame) -> None:
        """Find the links within stored buckets (key, node, score); a bucket's centre has the greatest score."""
        stars = with_groups(self.store, buckets, ["key"], "stars", top=F.max(F.struct("score", "node"))).select(F.col("top.node").alias("a"), F.col("node").alias("b"))
        self.compare(self.store.put(stars.where("a <> b").distinct(), "stars"), "stars")

        mixed = self._mixed(self._classed(buckets, "buckets"), "buckets").where("node <> centre")
        p, q = (mixed.where(F.col("members") <= SMALL).select("key", F.col("node").alias(x), F.col("class").alias(f"c{x}")) for x in ("a", "b"))
        across = p.join(q, "key").where("a < b and ca <> cb").select("a", "b")
        large = self.store.put(mixed.where(F.col("members") > SMALL).select(F.col("centre").alias("a"), F.col("node").alias("b"), "class", "score").distinct(), "large")
        if large.isEmpty():
            self.compare(self.store.put(across.distinct(), "across"), "across")
            return
        parts = self._mixed(self.store.put(self._parts(large), "parts"), "parts")
        few, many = parts.where(F.col("members") <= SMALL), parts.where(F.col("members") > SMALL)
        centres = many.where("node = centre").select("key", *(F.col(c).alias(f"{c}_y") for c in _PART))
        first = self._qualified(many.where("node <> centre").select("key", *_PART).join(centres, "key"))
        pairs = across.unionByName(self._pairs(few)).unionByName(first)
        self.compare(self.store.put(pairs.distinct(), "across"), "across")

        many = many.drop("class", "members", "centre")
        if many.isEmpty():
            return
        many = self._mixed(self._classed(many, "rest"), "rest").where("node <> centre")
        self.compare(self.store.put(self._pairs(many).distinct(), "rest"), "rest")

    def _parts(self, large: DataFrame) -> DataFrame:
        """Members (b) of large buckets by their first differences from the centre (a): key, score and ``_PART``."""
        differ = self._with_texts(large).mapInArrow(_differences(self.size, self.threshold), "node binary, runs array<long>, n long, any_x long, reach long")
        differ = self.store.put(differ, "differ")
        counts = differ.select("runs").mapInArrow(_common, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        common = np.zeros(CELLS, np.int64)
        common[counts["cell"].to_numpy()] = counts["n"].to_numpy()
        sent = self.store.spark.sparkContext.broadcast(common)
        known = differ.join(large.select(F.col("b").alias("node"), "class", "score").distinct(), "node")
        return known.mapInArrow(_first(sent), "key long, node binary, class binary, score long, n long, d int, at long, x boolean, far boolean")

    def _pairs(self, parts: DataFrame) -> DataFrame:
        """Pairs (a, b) of texts of different classes in a bucket of differences that can be similar enough."""
        mine = parts.select("key", *_PART)
        return self._qualified(mine.join(mine.select("key", *(F.col(c).alias(f"{c}_y") for c in _PART)), "key").where("node < node_y"))

    def _qualified(self, pairs: DataFrame) -> DataFrame:
        """Those in which one is far, classes differ, and as many differences may be common as must be.

        At the first difference in order that both have, no more than what follows in either can be common.
        """
        q = (1 - self.threshold) / (1 + self.threshold)
        enough = F.least(F.col("d") - F.col("at"), F.col("d_y") - F.col("at_y")) >= (F.col("d") + F.col("d_y") - q * (F.col("n") + F.col("n_y"))) / 2 - 1e-6
        pairs = pairs.where(enough & (F.col("class") != F.col("class_y"))).where("x and far_y or far and x_y")
        return pairs.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b"))


#: What a part says of a text: its class, runs, differences, the place of this difference, and which sides it can take.
_PART = ("node", "class", "n", "d", "at", "x", "far")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, doubt: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), is_first.

    With 20 bands of 4 registers a pair at similarity 0.8 shares a band with a chance of 0.99997, one at 0.9 with more
    than 0.9999999.  ``doubt`` is four and a half standard deviations of a signature's estimate at 0.8.
    """
    spark = docs.sparkSession
    store = Stored(spark, "near")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = rows.where("__id is not null").withColumn("node", F.substring(F.unhex(F.sha2(F.col("text"), 256)), 1, 16))
    signs = store.put(known.select("__id", "node", "text").mapInArrow(_sign(size), "__id long, node binary, bands array<long>, marks binary"), "signs")
    total = signs.count()
    owners = store.put(signs.groupBy("node").agg(F.min("__id").alias("__id"), F.count("*").alias("n"), F.any_value("bands").alias("bands"), F.any_value("marks").alias("marks")), "owners")

    # texts of one id are in one class
    nodes = signs.select("__id", "node").distinct()
    several = nodes.groupBy("__id").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    several = store.put(several, "several")
    siblings = split_join(signs.select("__id", "node"), several.select("__id", "low", "n"), ["__id"], "n", total).where("node <> low")
    links = store.put(siblings.select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), "siblings")

    # buckets of two texts or more
    banded = owners.select("node", F.explode("bands").alias("key"))
    many = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("n").alias("weight"))
    buckets = store.put(split_join(banded, store.put(many, "many"), ["key"], "n", BANDS * total), "buckets")
    scores = store.put(buckets.groupBy("node").agg(F.sum("weight").alias("score")), "scores")
    marks = store.put(owners.join(scores, "node").select("node", "__id", "marks"), "marks")
    # the needed texts grow with the table, so the join is the same at every size
    texts = store.put(known.join(marks.select("__id", "node").hint("merge"), ["__id", "node"]).select("node", "text").dropDuplicates(["node"]), "texts")

    graph = _Graph(store, texts, marks, links, size, threshold, doubt)
    graph.resolve(store.put(buckets.join(scores, "node").select("key", "node", "score"), "scored"))
    classes = connected_components(graph.links, "a", "b").select("node", F.col("component").alias("class"))

    # the least id of each class; a text without links is its own class
    held = store.put(owners.select("node", "__id", "n").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "held")
    least = held.groupBy("class").agg(F.min("__id").alias("class_id"), F.count("*").alias("texts"))
    classed = store.put(split_join(held, least, ["class"], "texts", total).select("node", "class_id", "n"), "classed")
    found = split_join(signs.select("__id", "node"), classed, ["node"], "n", total).select("__id", "class_id")
    out = found.unionByName(rows.where("__id is null").select("__id", F.lit(None).cast("long").alias("class_id")))
    return out.select(F.col("__id").cast(kind).alias(id_col), F.col("class_id").cast(kind).alias("class_id"), F.coalesce(F.col("class_id") == F.col("__id"), F.lit(True)).alias("is_first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all columns; of rows of one doc_id all stay, and so do rows without an id."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("not is_first").select(F.col(id_col).cast("long").alias("__id")).distinct()
    # the documents go through as one struct, so their columns' names cannot clash with those used here
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(id_col).cast("long").alias("__id"))
    return keyed.join(found, "__id", "left_anti").select("__doc.*")
