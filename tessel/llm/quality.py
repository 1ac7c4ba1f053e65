"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of many documents are numpy passes over their bytes and words.  Trees are complete and of one depth, so
the whole model is three arrays and a document goes down all trees at once by index arithmetic.

The model alone is fitted on a bounded sample, at most ``sample_rows`` labelled rows; every document is scored on its
whole text.

Defined cases: null and empty texts have statistics like any others (all zero) and get the model's score for these;
labels other than 0 and 1 are left out; without any label every score is 0.5, with labels of one kind only it is that
kind's smoothed share; equal texts have equal scores, so repeated rows and ties need no rule; of an id with several rows
those of least text hash are learnt from; very long texts are read whole; an empty table has no rows; columns of the
documents go through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import first_rows, fold, sample, sampled_documents
from .textscan import U64, Rolling, Words, annotate, window_starts

STATISTICS = (
    "log_words", "word_bytes", "upper", "digits", "signs", "symbols", "exclamations", "feeds_per_word", "distinct_words",
    "same_as_before", "commonest_word", "repeated_lines", "repeated_4_words", "lone_signs", "full_stops", "capitalised",
    "words_per_line", "short_words", "long_words", "beyond_ascii", "longest_word",
)


def _table(test) -> np.ndarray:
    return np.array([b < 128 and test(chr(b)) for b in range(256)])


_UPPER, _LOWER, _DIGIT = _table(str.isupper), _table(str.islower), _table(str.isdigit)
_SIGN = _table(lambda c: 32 < ord(c) < 127 and not c.isalnum())
_SYMBOL = _table(lambda c: c in "#*$%&|<>")


def _runs(keys: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each document, and how often its commonest occurs."""
    order = np.lexsort((keys, docs)) if len(keys) else np.zeros(0, np.int64)
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, d[first], np.diff(np.append(first, len(k))))
    return np.bincount(d[first], minlength=n_docs), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    words = Words(texts)
    b, off, n_docs = words.bytes, words.offsets, words.n_docs
    docs, names, size = words.docs(), words.names(), words.end - words.start

    def per_byte(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[off])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[words.doc_at])

    n_bytes, n = np.maximum(np.diff(off), 1), np.maximum(words.counts, 1)
    first, last = b[words.start], b[words.end - 1]
    second = b[np.minimum(words.start + 1, max(len(b) - 1, 0))] if len(b) else first
    feeds = per_byte(b == 10)
    before = np.zeros(len(names), bool)
    before[1:] = (names[1:] == names[:-1]) & (docs[1:] == docs[:-1])
    distinct, most = _runs(names, docs, n_docs)

    line = np.append(0, np.cumsum(b == 10))[words.start]
    new = np.ones(len(names), bool)
    new[1:] = (line[1:] != line[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    rolling = Rolling(names)
    lines = rolling.of(at, np.diff(np.append(at, len(names)))) if len(names) else np.zeros(0, U64)
    n_lines = np.bincount(docs[at], minlength=n_docs)
    distinct_lines, _ = _runs(lines, docs[at], n_docs)
    starts, of = window_starts(words.doc_at, 4)
    grams = rolling.of(starts, 4) if len(starts) else np.zeros(0, U64)
    distinct_grams, _ = _runs(grams, of, n_docs)
    n_grams = np.bincount(of, minlength=n_docs)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, docs, size)

    return np.stack([
        np.log1p(words.counts), per_word(size) / n, per_byte(_UPPER[b]) / n_bytes, per_byte(_DIGIT[b]) / n_bytes,
        per_byte(_SIGN[b]) / n_bytes, per_byte(_SYMBOL[b]) / n_bytes, per_byte(b == 33) / n_bytes, feeds / n, distinct / n,
        per_word(before) / n, most / n, 1 - distinct_lines / np.maximum(n_lines, 1), 1 - distinct_grams / np.maximum(n_grams, 1),
        per_word((size == 1) & _SIGN[first]) / n, per_word(last == 46) / n, per_word(_UPPER[first] & _LOWER[second] & (size > 1)) / n,
        words.counts / np.maximum(n_lines, 1), per_word(size <= 3) / n, per_word(size >= 12) / n, per_byte(b >= 128) / n_bytes, np.log1p(longest),
    ], axis=1)


@dataclass
class Forest:
    """Complete trees of one depth, as arrays: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node, tree = np.zeros((len(x), trees), np.int64), np.arange(trees)
        for _ in range((inner + 1).bit_length() - 1):
            f, t = self.feature[tree, node], self.threshold[tree, node]
            node = 2 * node + 1 + (np.take_along_axis(x, f, axis=1) > t)
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss with gradient histograms of quantile bins."""
    inner = 2**depth - 1
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return empty
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    empty.base = base
    if y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    raw, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            place = node - first
            best = [(1e-6, 0, np.inf, 1 << 30)] * width
            for j, e in enumerate(edges):
                key, n_bins = place * (len(e) + 1) + code[:, j], len(e) + 1
                gs, hs, cs = (np.cumsum(np.bincount(key, w, width * n_bins).reshape(width, n_bins), axis=1) for w in (g, h, None))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                if not gl.shape[1]:
                    continue
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (ct - cl < least)] = 0
                k = gain.argmax(axis=1)
                for w in range(width):
                    if gain[w, k[w]] > best[w][0]:
                        best[w] = (float(gain[w, k[w]]), j, float(e[k[w]]), int(k[w]))
            feature[first : first + width] = [b[1] for b in best]
            threshold[first : first + width] = [b[2] for b in best]
            cut = np.array([b[3] for b in best])
            node = 2 * node + 1 + (code[np.arange(len(y)), feature[node]] > cut[place])
        leaf_of = node - inner
        leaf = rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + ridge)
        raw += leaf[leaf_of]
        made.append((feature, threshold, leaf))
    return Forest(base, *(np.stack([m[i] for m in made]) for i in range(3)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest fitted on at most ``sample_rows`` labelled documents outside the held-out fold."""
    chosen = sampled_documents(docs, sample(labels, "quality", folds, held_out, sample_rows, id_col), id_col, text_col)

    def make(texts: pa.Array) -> list[pa.Array]:
        x = statistics(texts)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))]

    rows = first_rows(annotate(chosen, make, "x array<double>").select("doc.__label_id", "doc.__label", "doc.h", "x"), sample_rows)
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["__label"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``doc``, a struct of all columns of ``docs``, with ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    return annotate(docs, lambda texts: [pa.array(sent.value.score(statistics(texts)))], "score double", text_col)


def quality(docs: DataFrame, labels: DataFrame, accept: float = 0.7, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``accept`` on)."""
    forest = train(docs, labels, folds, held_out, id_col=id_col, text_col=text_col, **options)
    found = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), forest).select("doc.id", "score")
    return found.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
