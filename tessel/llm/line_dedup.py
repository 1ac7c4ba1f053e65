"""Line dedup by winnowing over line hashes.

A line is what stands between line feeds and has a word; white space does not count when lines are compared.  Of every
``min_run`` consecutive lines the one of least hash (of equal ones the last) is selected: the window's fingerprint.  Equal
runs of ``min_run`` lines select the same line, so any repeated run shares a fingerprint for sure, and lines that no
window selects are left out.  Positions are joined on the fingerprint, a line's hash.  Where one line stands at several
places, the match is extended both ways, to the windows around it that selected it; a run that begins at a later place
than its first occurrence, and does not overlap it, goes.  Runs that touch make up the longer repeated stretches.  With
``min_words`` a single line of that many words is a window of its own, whatever stands around it.  Places are ordered by
doc_id, then by the text's hash, then by line.  All is judged on the input.

Defined cases: null and empty texts have no lines and stay as they are; rows with a null doc_id stay as they are and
are no first occurrence; rows that are alike in doc_id and text are one document; lines without words stay; of equal
places nothing is later, so the first occurrence always stays; very long texts are read whole; an empty table has no
rows; columns of the documents go through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Stored
from .skew import split_join
from .textscan import U64, Rolling, Words, mix, signed, text_slices, window_starts


#: Words from which a single repeated line goes; as many as the repeated runs of words that the quality rules count.
LONG_LINE = 8


class Lines:
    """Lines with words, of many documents: their byte spans and hashes."""

    def __init__(self, texts: pa.Array) -> None:
        words = Words(texts)
        self.words = words
        feeds = np.append(0, np.cumsum(words.bytes == 10))
        n = len(words)
        new = np.ones(n, bool)
        if n:
            line = feeds[words.start]
            new[1:] = line[1:] != line[:-1]
            new[words.doc_at[:-1][words.counts > 0]] = True
        first = np.flatnonzero(new)
        self.n_words = size = np.diff(np.append(first, n))
        self.at = words.start[first]
        self.names = Rolling(words.names()).of(first, size) if n else np.zeros(0, U64)
        self.doc_at = np.searchsorted(first, words.doc_at)

    def windows(self, size: int, min_words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of ``size`` lines, and long single lines: start, size, document, name and the line selected."""
        starts, docs = window_starts(self.doc_at, size)
        order = mix(self.names, 3)
        best = starts.copy()
        for k in range(1, size):
            best = np.where(order[starts + k] <= order[best], starts + k, best) if len(starts) else best
        sizes = np.full(len(starts), size, np.int32)
        if min_words is not None and size > 1:
            long = np.flatnonzero(self.n_words >= min_words)
            of = np.searchsorted(self.doc_at, long, "right") - 1
            starts, docs, best, sizes = (np.concatenate(x) for x in ((starts, long), (docs, of), (best, long), (sizes, np.ones(len(long), np.int32))))
        names = Rolling(self.names).of(starts, sizes) if len(starts) else np.zeros(0, U64)
        return starts, sizes, docs, names, best


def _prints(size: int, min_words: int | None):
    """A row per selected line, with the windows that selected it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                lines = Lines(part.column("text"))
                starts, sizes, docs, names, best = lines.windows(size, min_words)
                order = np.argsort(best, kind="stable")
                starts, sizes, docs, names, best = (x[order] for x in (starts, sizes, docs, names, best))
                first = np.flatnonzero(np.append(True, best[1:] != best[:-1])) if len(best) else np.zeros(0, np.int64)
                cuts = pa.array(np.append(first, len(best)), pa.int32())
                at = (starts - lines.doc_at[docs]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (at, sizes, signed(names))]
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False)[docs[first]] for c in ("__id", "__row"))
                place = (best[first] - lines.doc_at[docs[first]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(lines.names[best[first]])), pa.array(ids), pa.array(rows), pa.array(place), *lists], ["mark", "__id", "__row", "line", "at", "size", "name"])

    return run


def _cut(size: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                lines = Lines(part.column("__text"))
                raw, offsets = lines.words.bytes.tobytes(), lines.words.offsets
                n_lines = np.diff(lines.doc_at)
                removed, texts = np.zeros(len(part), np.int64), part.column("__text").to_pylist()
                for i, (starts, ones) in enumerate(zip(part.column("__starts").to_pylist(), part.column("__ones").to_pylist(), strict=True)):
                    if not starts and not ones:
                        continue
                    at = lines.at[lines.doc_at[i] : lines.doc_at[i + 1]].tolist()
                    gone = {s + k for s in starts for k in range(size)} | set(ones)
                    removed[i] = len(gone)
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    doomed = {raw.rfind(b"\n", begin, at[k]) + 1 or begin for k in gone}
                    kept, a = [], begin
                    while a <= end:
                        b = raw.find(b"\n", a, end)
                        b = end if b < 0 else b
                        if a not in doomed:
                            kept.append(raw[a:b])
                        a = b + 1
                    texts[i] = b"\n".join(kept).decode("utf-8", "replace")
                kind = part.schema.field("__text").type
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, kind), pa.array(n_lines.astype(np.int64)), pa.array(removed)], [*columns, "__kept", "__lines", "__gone"])

    return run


def cut_lines(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """``doc``, a struct of all columns of ``docs``, with ``kept`` (the text without repeated lines), ``lines`` and ``gone``.

    A run is ``min_run`` lines, or, if ``min_words`` is given, one line of at least that many words.
    """
    store = Stored(docs.sparkSession, "lines")
    # the documents go through as one struct, so their columns' names cannot clash with those used here
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("__row"))
    text = F.col("__doc").getField(text_col)
    found = keyed.where(F.col("__id").isNotNull() & text.isNotNull()).select("__id", "__row", text.alias("text"))
    schema = "mark long, __id long, __row long, line int, at array<int>, size array<int>, name array<long>"
    prints = store.put(found.mapInArrow(_prints(min_run, min_words), schema), "prints")
    place = F.struct("__id", "__row", "line")
    shared = prints.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a < b").select("mark", "n")
    matched = split_join(prints, shared, ["mark"], "n", prints.count())
    # extension to the windows on either side of the matched line
    runs = matched.select("mark", "__id", "__row", F.explode(F.arrays_zip("at", "size", "name")).alias("w")).select("mark", "__id", "__row", "w.at", "w.size", "w.name")
    runs = store.put(runs, "runs")
    store.drop("prints")
    place = F.struct("__id", "__row", "at")
    many = runs.groupBy("mark", "name", "size").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n")).where("a < b").select("mark", "name", "size", "n", "a")
    later = split_join(runs, many, ["mark", "name", "size"], "n", runs.count()).where("(__id, __row, at) > (a.__id, a.__row, a.at) and not (__id = a.__id and __row = a.__row and at < a.at + size)")
    whole = F.col("size") == min_run
    gone = store.put(later.groupBy("__id", "__row").agg(F.collect_set(F.when(whole, F.col("at"))).alias("__starts"), F.collect_set(F.when(~whole, F.col("at"))).alias("__ones")), "gone")
    store.drop("runs")
    # the cut documents grow with the table, so the join is the same at every size; a text is exchanged once
    joined = keyed.join(gone.hint("merge"), ["__id", "__row"], "left").select("__doc", text.alias("__text"), "__starts", "__ones")
    cut = joined.mapInArrow(_cut(min_run, ["__doc"]), StructType([joined.schema["__doc"], *StructType.fromDDL("__kept string, __lines long, __gone long").fields]))
    return cut.toDF("doc", "kept", "lines", "gone")


def line_dedup(docs: DataFrame, min_run: int = 2, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the kept text."""
    found = cut_lines(docs.select(id_col, text_col), min_run, id_col, text_col, min_words)
    return found.select(F.col("doc").getField(id_col).alias(id_col), F.col("lines").alias("n_lines"), F.col("gone").alias("n_removed"), F.col("kept").alias("kept_text"))
