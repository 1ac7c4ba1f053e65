"""Windows in what genes leave free: at random, or matched to genes by length and GC.

Each placement takes its place from the next, so a chromosome is worked through in order by one task; chromosomes (at random)
or genomes (matched, whose numbers run on from chromosome to chromosome) are spread over the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import fnv1a
from .assembly import two_tier
from .intervals import flank_window, free_intervals


def _without(free: list[tuple[int, int]], at: int, start: int, end: int) -> None:
    """Take [start, end] out of the free interval number ``at`` that holds it."""
    low, high = free[at]
    free[at : at + 1] = [(a, b) for a, b in ((low, start - 1), (end + 1, high)) if a <= b]


def _draw(seed: int, name: str, what: str, n: int) -> int:
    return int(hashlib.md5(f"{seed}:{what}:{name}".encode()).hexdigest()[:15], 16) % n


def random_placement(rows: DataFrame, free: DataFrame, row_id: str, seed: int = 42, most: int | None = None) -> DataFrame:
    """(genome, chrom, id, start, end, name) of windows as long as each row's, at most ``most``, in intervals that are free.

    ``rows`` have genome, chrom, the id, start and end; ``free`` has genome, chrom, start, end.  In the order of ids a row
    draws one of the intervals that can hold it, each alike, and a start in it; what it takes is free no more.  A row that
    no interval can hold is left out.  Draws are MD5 of seed and id.
    """
    kind = rows.schema[row_id].dataType.simpleString()
    length = F.col("end") - F.col("start") + 1
    asked = rows.select("genome", "chrom", F.col(row_id).alias("id"), (F.least(length, F.lit(most)) if most else length).cast("long").alias("length")).where("length > 0")
    open_ = free.select("genome", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))

    def place(wanted: pd.DataFrame, gaps: pd.DataFrame) -> pd.DataFrame:
        left, out = sorted(zip(gaps["start"].tolist(), gaps["end"].tolist(), strict=True)), []
        for r in wanted.sort_values("id").itertuples(index=False):
            fits = [i for i, (a, b) in enumerate(left) if b - a + 1 >= r.length]
            if not fits:
                continue
            at = fits[_draw(seed, str(r.id), "gap", len(fits))]
            low, high = left[at]
            start = low + _draw(seed, str(r.id), "start", high - low + 2 - r.length)
            _without(left, at, start, start + r.length - 1)
            out.append((r.genome, r.chrom, r.id, start, start + r.length - 1, f"NC_{r.genome}_{r.id}"))
        return pd.DataFrame(out, columns=["genome", "chrom", "id", "start", "end", "name"])

    schema = f"genome string, chrom string, id {kind}, start long, end long, name string"
    return asked.groupBy("genome", "chrom").cogroup(open_.groupBy("genome", "chrom")).applyInPandas(place, schema)


def _prefix(seq: str, letters: bytes) -> np.ndarray:
    hit = np.isin(np.frombuffer(seq.encode("ascii", "replace"), np.uint8), np.frombuffer(letters, np.uint8))
    return np.concatenate(([0], np.cumsum(hit)))


def _share(gc: np.ndarray, known: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """GC among known letters of windows from 1-based starts; 0 without any."""
    n = known[start - 1 + length] - known[start - 1]
    return np.where(n > 0, (gc[start - 1 + length] - gc[start - 1]) / np.maximum(n, 1), 0.0)


def match_windows(genes: DataFrame, free: DataFrame, contigs: DataFrame, gene: str = "gene", seed: int = 42, tolerance: float = 0.03, step: float = 0.25) -> DataFrame:
    """(genome, chrom, gene, id, start, end, gc): for each gene's window a free one of its length and nearly its GC.

    ``genes`` have genome, chrom, the gene, start, end; ``free`` genome, chrom, start, end; ``contigs`` genome, chrom, seq.
    On a chromosome the longest go first, ties by name.  Starts are tried in each free interval: its first, then from
    ``(31 seed + 17 placed + FNV-1a(gene) mod 10007) mod room`` on by the greatest of ``step`` times the length,
    ``seed mod 97`` and 1; the first within the tolerance is taken, else the nearest of all.  Windows are numbered through a
    genome's chromosomes.  A gene that no interval can hold is left out.
    """
    asked = genes.where(F.col("end") >= F.col("start")).groupBy("genome", "chrom").agg(
        F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end") - 1).cast("long").alias("minus"), F.col(gene).alias("gene"), F.col("start").cast("long").alias("start"), fnv1a(F.col(gene)).cast("long").alias("hash")))).alias("genes")
    )
    gaps = free.groupBy("genome", "chrom").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("free"))
    lined = contigs.select("genome", "chrom", F.upper("seq").alias("seq")).join(asked, ["genome", "chrom"]).join(gaps, ["genome", "chrom"], "left")
    lined = lined.repartition("genome").sortWithinPartitions("genome", "chrom")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        genome, placed = None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.genome != genome:
                    genome, placed = r.genome, 0
                gc, known = _prefix(r.seq, b"GC"), _prefix(r.seq, b"ACGT")
                left = [] if r.free is None else [(x["start"], x["end"]) for x in r.free]
                for g in r.genes:
                    length, best = -g["minus"], None
                    aim = _share(gc, known, np.array([g["start"]]), length)[0]
                    stride = max(1, int(length * step), seed % 97)
                    for at, (low, high) in enumerate(left):
                        room = high - low + 2 - length
                        if room < 1:
                            continue
                        tried = np.arange(low + (seed * 31 + placed * 17 + g["hash"] % 10007) % room, high - length + 2, stride)
                        tried = tried if tried[0] == low else np.concatenate(([low], tried))
                        off = np.abs(_share(gc, known, tried, length) - aim)
                        near = np.flatnonzero(off <= tolerance)
                        i = int(near[0]) if len(near) else int(off.argmin())
                        if best is None or len(near) or off[i] < best[0]:
                            best = (float(off[i]), at, int(tried[i]))
                        if len(near):
                            break
                    if best is None:
                        continue
                    placed += 1
                    _, at, start = best
                    _without(left, at, start, start + length - 1)
                    share = float(_share(gc, known, np.array([start]), length)[0])
                    out.append((r.genome, r.chrom, g["gene"], f"NC_{r.genome}_{r.chrom}_{placed:06d}", start, start + length - 1, share))
            yield pd.DataFrame(out, columns=["genome", "chrom", "gene", "id", "start", "end", "gc"])

    return lined.mapInPandas(run, "genome string, chrom string, gene string, id string, start long, end long, gc double")


def gene_windows(genes: DataFrame, contigs: DataFrame, expression: DataFrame, flank: int = 10_000, seed: int = 42) -> DataFrame:
    """(genome, id, chrom, start, end, strand, kind, tpm, seq): windows of genes and as many matched ones without genes.

    ``genes`` have genome, chrom, gene, name, start, end, strand; ``contigs`` genome, chrom, seq; ``expression`` key, tpm.
    A gene's value is by its name, else by its id, else 0.  Genes of chromosomes without a sequence are left out.
    """
    sizes = contigs.select("genome", "chrom", F.length("seq").alias("length"))
    w = flank_window(F.col("start"), F.col("end"), F.col("strand"), F.col("length"), flank)
    wide = genes.join(sizes, ["genome", "chrom"]).withColumn("__w", w).withColumns({"start": F.col("__w.start"), "end": F.col("__w.end")}).drop("__w", "length").where("start <= end")
    chrom = F.to_json(F.struct("genome", "chrom"))
    gaps = free_intervals(wide.select(chrom.alias("__c"), "start", "end"), sizes.select(chrom.alias("__c"), "length"), "__c")
    back = F.from_json("__c", "genome string, chrom string")
    gaps = gaps.select(back["genome"].alias("genome"), back["chrom"].alias("chrom"), "start", "end")
    matched = match_windows(wide, gaps, contigs, "gene", seed)
    wide = wide.withColumn("__id", F.to_json(F.struct("genome", "gene")))
    values = two_tier(expression, wide, "__id", "name", "gene", "key", "tpm").select("__id", "tpm")
    own = wide.join(values, "__id", "left").select("genome", F.col("gene").alias("id"), "chrom", "start", "end", "strand", F.lit("gene").alias("kind"), F.coalesce(F.col("tpm").cast("double"), F.lit(0.0)).alias("tpm"))
    other = matched.select("genome", "id", "chrom", "start", "end", F.lit("+").alias("strand"), F.lit("non_coding").alias("kind"), F.lit(0.0).alias("tpm"))
    cut = F.upper(F.substring(F.col("__seq"), F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int")))
    return own.unionByName(other).join(contigs.select("genome", "chrom", F.col("seq").alias("__seq")), ["genome", "chrom"]).withColumn("seq", cut).drop("__seq")
