"""Toxicity by nearest labelled examples.

Terms are lower-cased runs of letters and digits.  A text is the vector of all its terms that the labelled examples know,
weighted by TF-IDF, document frequencies being counted over all documents, and by how far the term's share of toxic
examples is from chance, in standard errors (to a power; 0 leaves plain TF-IDF).  The examples stand in an inverted index
cut into blocks, with each term's greatest weight in each block.  A text's nearest examples by cosine are found exactly:
blocks are taken by falling bound until no bound reaches the k-th cosine.  Their votes, weighted by the square of the
cosine, are calibrated on votes for examples that were left out.

The power, the number of neighbours and the calibration come from cross-validation within the examples; the held-out fold
has no part in it.  The index alone is built from a bounded sample: at most ``sample_rows`` labelled rows.  Every document
is scored on its whole text by all its known terms.

Defined cases: texts without a known term, null and empty ones too, get the share of toxic examples; of equal cosines the
example of lesser text hash counts, so no doc_id has a part in a score; equal texts have equal scores; labels other than 0
and 1 are left out; of an id with several rows those of least text hash are learnt from; without labels all scores are
0.5; very long texts are read whole; an empty table has no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import tokens
from .labelled import first_rows, fold, sample, sampled_documents
from .textscan import U64, annotate, mix, signed, text_slices

POWERS, NEIGHBOURS, INNER = (0, 1, 2), (5, 15, 45), 3


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term's name, occurrences), by document and name."""
    words = tokens(texts)
    names, docs = words.names(), words.docs()
    order = np.lexsort((names, docs))
    n, d = names[order], docs[order]
    first = np.flatnonzero(np.append(True, (n[1:] != n[:-1]) | (d[1:] != d[:-1]))) if len(n) else np.zeros(0, np.int64)
    return d[first], n[first], np.diff(np.append(first, len(n)))


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``first[i]``, ``first[i] + 1``, ..., ``first[i] + size[i] - 1``, one i after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Vectors:
    """Sparse rows (row, term, count) over a sorted vocabulary."""

    def __init__(self, vocabulary: np.ndarray, rows: np.ndarray, names: np.ndarray, counts: np.ndarray, n: int) -> None:
        at = np.minimum(np.searchsorted(vocabulary, names), max(len(vocabulary) - 1, 0))
        hit = np.flatnonzero(vocabulary[at] == names) if len(vocabulary) else np.zeros(0, np.int64)
        self.row, self.term, self.count, self.n = rows[hit], at[hit], counts[hit], n

    def pick(self, rows: np.ndarray) -> "Vectors":
        """The rows where ``rows`` is true, numbered anew."""
        out = object.__new__(Vectors)
        keep = rows[self.row]
        out.row, out.term, out.count, out.n = (np.cumsum(rows) - 1)[self.row[keep]], self.term[keep], self.count[keep], int(rows.sum())
        return out

    def weights(self, value: np.ndarray) -> np.ndarray:
        """Each entry's share of its row's vector of length one."""
        w = (1 + np.log(self.count)) * value[self.term]
        return w / np.sqrt(np.maximum(np.bincount(self.row, w * w, self.n), 1e-300))[self.row]


def ties(vectors: Vectors, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """For each term how many standard errors its toxic examples are from chance, one example being added to the variance."""
    n, toxic = (np.bincount(vectors.term, w, n_terms) for w in (None, labels[vectors.row]))
    share = labels.mean() if len(labels) else 0.0
    return np.abs(toxic - n * share) / np.sqrt(n * share * (1 - share) + 1)


class Index:
    """A block-max inverted index over labelled examples."""

    def __init__(self, vectors: Vectors, value: np.ndarray, labels: np.ndarray, block: int = 64) -> None:
        self.value, self.labels, self.size = value, labels.astype(float), block
        self.n, self.n_blocks = vectors.n, -(-vectors.n // block)
        weight = vectors.weights(value)
        order = np.lexsort((vectors.row, vectors.term))
        term, self.example, self.weight = vectors.term[order], vectors.row[order], weight[order]
        of = self.example // block
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1]))) if len(term) else np.zeros(0, np.int64)
        self.block, self.start, self.postings = of[start], start, np.diff(np.append(start, len(term)))
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(len(value) + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine, of equal ones the first, and these cosines (to ten digits)."""
        at, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        entry, q = _spread(at, n), np.repeat(weights, n)
        block = self.block[entry]
        bound = np.bincount(block, q * self.top[entry], self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        cosine, kth, done, step = np.zeros(self.n), 0.0, 0, 8
        while done < len(order):
            now = order[done : done + step]
            now = now[bound[now] >= kth - 1e-9]
            if not len(now):
                break
            chosen = np.zeros(self.n_blocks, bool)
            chosen[now] = True
            pick = np.flatnonzero(chosen[block])
            e = entry[pick]
            place = _spread(self.start[e], self.postings[e])
            cosine += np.bincount(self.example[place], np.repeat(q[pick], self.postings[e]) * self.weight[place], self.n)
            done, step = done + step, 4 * step
            if k <= self.n:
                kth = np.partition(cosine, self.n - k)[self.n - k]
        cosine = np.round(cosine, 10)
        found = np.flatnonzero(cosine > 0)
        found = found[np.lexsort((found, -cosine[found]))[:k]]
        return found, cosine[found]

    def votes(self, vectors: Vectors, ks: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each row the vote of its nearest examples, a column for each of ``ks``, and these examples; -1 without any."""
        out, near = np.full((vectors.n, len(ks)), -1.0), [np.zeros(0, np.int64)] * vectors.n
        weight, known = vectors.weights(self.value), {}
        cuts = np.searchsorted(vectors.row, np.arange(vectors.n + 1))
        for i in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[i], cuts[i + 1]
            key = vectors.term[a:b].tobytes() + vectors.count[a:b].tobytes()
            if key not in known:
                found, cosine = self.nearest(vectors.term[a:b], weight[a:b], max(ks))
                square, label = cosine**2, self.labels[found]
                known[key] = ([(square[:k] * label[:k]).sum() / square[:k].sum() if len(found) else -1.0 for k in ks], found)
            out[i], near[i] = known[key]
        return out, near


def rising(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic shares of label 1 by vote: votes, and smoothed shares that never fall."""
    pools: list[list[float]] = []
    at, place = np.unique(np.round(votes, 3), return_inverse=True)
    for v, y, n in zip(at, np.bincount(place, labels), np.bincount(place), strict=True):
        pools.append([y, n, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y2, n2, _, high = pools.pop()
            pools[-1] = [pools[-1][0] + y2, pools[-1][1] + n2, pools[-1][2], high]
    return np.array([x for p in pools for x in (p[2], p[3])]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in (0, 1)])


def area(votes: np.ndarray, labels: np.ndarray) -> float:
    """The chance that a toxic example has the greater vote."""
    at, place, n = np.unique(votes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    one = labels == 1
    pairs = one.sum() * (~one).sum()
    return float((rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / pairs) if pairs else 0.5


class Model:
    """The index of all examples with what cross-validation chose."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, vectors: Vectors, labels: np.ndarray, ids: np.ndarray, fold_of: np.ndarray) -> None:
        self.vocabulary, self.ids = vocabulary, ids
        self.prior = (labels.sum() + 0.5) / (len(labels) + 1)
        best = None
        for power in POWERS:
            votes = np.full((len(labels), len(NEIGHBOURS)), -1.0)
            for f in range(INNER):
                inside, outside = fold_of == f, fold_of != f
                mine = vectors.pick(outside)
                value = idf * ties(mine, labels[outside], len(idf)) ** power
                votes[inside] = Index(mine, value, labels[outside]).votes(vectors.pick(inside), NEIGHBOURS)[0]
            for j, k in enumerate(NEIGHBOURS):
                score = area(votes[:, j], labels)
                if best is None or score > best[0] + 1e-6:
                    best = (score, power, k, votes[:, j])
        _, self.power, self.k, votes = best
        known = votes >= 0
        self.raw, self.fit = rising(votes[known], labels[known]) if known.any() else (np.array([0.0, 1.0]), np.array([self.prior, self.prior]))
        self.index = Index(vectors, idf * ties(vectors, labels, len(idf)) ** self.power, labels)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Scores, and the ids of the examples they come from."""
        votes, near = self.index.votes(Vectors(self.vocabulary, *term_counts(texts), len(texts)), (self.k,))
        votes = votes[:, 0]
        scores = np.where(votes >= 0, 0.99 * np.interp(votes, self.raw, self.fit) + 0.01 * votes, self.prior)
        return scores, [self.ids[n].tolist() for n in near]


def _frequencies(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.value), np.int64)
        for batch in batches:
            for part in text_slices(batch, max_bytes=4 << 20):
                total += np.bincount(Vectors(vocabulary.value, *term_counts(part.column("text")), len(part)).term, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def build(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model; None if no label is usable."""
    spark = docs.sparkSession
    chosen = sampled_documents(docs, sample(labels, "toxic", folds, held_out, sample_rows, id_col), id_col, text_col)

    def make(texts: pa.Array) -> list[pa.Array]:
        rows, names, counts = term_counts(texts)
        at = pa.array(np.searchsorted(rows, np.arange(len(texts) + 1)), pa.int32())
        return [pa.ListArray.from_arrays(at, pa.array(signed(names))), pa.ListArray.from_arrays(at, pa.array(counts))]

    got = first_rows(annotate(chosen, make, "terms array<long>, counts array<long>", most_bytes=4 << 20).select("doc.__label_id", "doc.__label", "doc.h", "terms", "counts"), sample_rows)
    if not got:
        return None
    sizes = [len(r.terms) for r in got]
    names = np.array([t for r in got for t in r.terms], np.int64).view(U64)
    vocabulary = np.unique(names)
    everything, sent = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), spark.sparkContext.broadcast(vocabulary)
    df = np.zeros(len(vocabulary))
    counted = everything.mapInArrow(_frequencies(sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + docs.count()) / (1 + df)) + 1e-3
    vectors = Vectors(vocabulary, np.repeat(np.arange(len(got)), sizes), names, np.array([c for r in got for c in r.counts], np.int64), len(got))
    hashes = np.array([r.h for r in got], np.int64).view(U64)
    return Model(vocabulary, idf, vectors, np.array([r["__label"] for r in got], float), np.array([r["__label_id"] for r in got], np.int64), (mix(hashes, 34) % U64(INNER)).astype(np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.5 on), evidence (ids of the nearest examples)."""
    model = build(docs, labels, folds, held_out, id_col=id_col, text_col=text_col, **options)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(texts: pa.Array) -> list[pa.Array]:
        if sent.value is None:
            return [pa.array(np.full(len(texts), 0.5)), pa.array([[]] * len(texts), pa.list_(pa.int64()))]
        scores, evidence = sent.value.score(texts)
        return [pa.array(scores), pa.array(evidence, pa.list_(pa.int64()))]

    found = annotate(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, "score double, evidence array<long>", most_bytes=4 << 20).select("doc.id", "score", "evidence")
    return found.select(F.col("id").alias(id_col), F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
