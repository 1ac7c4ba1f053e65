"""Nucleotide sequences as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
# The standard genetic code; amino acids of the codons in the order T, C, A, G of each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def normalise(seq: Column) -> Column:
    """Upper case; anything but A, C, G, T, N becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTNacgtn", "TGCANtgcan")


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are in ``letters``."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_fraction(seq: Column) -> Column:
    """G and C over A, C, G, T; 0 without any of these."""
    up = F.upper(seq)
    known = count_of(up, BASES)
    return F.when(known > 0, count_of(up, "GC") / known).otherwise(0.0)


def gc_percent(seq: Column) -> Column:
    return gc_fraction(seq) * 100


def aaa_percent(seq: Column) -> Column:
    """Overlapping AAA over all places for three letters, in percent; 0 for under three letters.

    A run of n A holds n - 2 of them; so the runs' lengths are enough.
    """
    up = F.upper(seq)
    runs = F.regexp_extract_all(up, F.lit("A{3,}"), F.lit(0))
    n = F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r) - 2)
    return F.when(F.length(up) >= 3, n * 100.0 / (F.length(up) - 2)).otherwise(0.0)


def stitch(core: Column, left: str, right: str) -> Column:
    """Adapters around a core."""
    return F.concat(F.lit(left), core, F.lit(right))


def has_length(seq: Column, n: int) -> Column:
    return F.length(seq) == n


def kmers(seq: Column, k: int) -> Column:
    """All windows of ``k`` letters that are A, C, G or T only, in order, with repeats; white space does not count."""
    bare = F.upper(F.regexp_replace(seq, r"\s", ""))
    return F.transform(
        F.array(bare),
        lambda s: F.filter(
            F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>")),
            lambda w: ~w.rlike("[^ACGT]"),
        ),
    )[0]


def pack_kmer(kmer: Column) -> Column:
    """Two bits a base, A 0, C 1, G 2, T 3, first base highest; for up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def unpack_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def translate_dna(seq: Column) -> Column:
    """Amino acids of whole codons; unknown ones and inner stops are X, stops at the end go."""
    order = "TCAG"
    code = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}
    table = F.create_map(*[F.lit(v) for kv in sorted(code.items()) for v in kv])
    up = F.upper(seq)
    n = F.floor(F.length(up) / 3).cast("int")
    acids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(table[F.substring(up, i * 3 + 1, F.lit(3))], F.lit("X")))).otherwise(F.array().cast("array<string>"))
    return F.translate(F.regexp_replace(F.array_join(acids, ""), r"\*+$", ""), "*", "X")


def spliced(exons: Column, contig: Column, strand: Column) -> Column:
    """A coding sequence from exons (array of struct start, end; 1-based, inclusive) in genome order.

    On the minus strand the joined sequence is reverse-complemented as a whole, which also turns the exons' order round.
    """
    joined = F.array_join(F.transform(F.array_sort(exons), lambda e: F.substring(contig, e["start"], e["end"] - e["start"] + 1)), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def wrapped(seq: Column, width: int = 80) -> Column:
    """Line feeds after every ``width`` letters, none at the end."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def log10p1(x: Column) -> Column:
    """log10(x + 1); a negative value is an error."""
    return F.when(x < 0, F.raise_error(F.lit("negative value under log10p1")).cast("double")).otherwise(F.log10(x + 1))


def log2p1(x: Column) -> Column:
    """log2(x + 1); a negative value is an error."""
    return F.when(x < 0, F.raise_error(F.lit("negative value under log2p1")).cast("double")).otherwise(F.log2(x + 1))


def transformed(x: Column, how: str) -> Column:
    if how in ("none", "identity"):
        return x
    if how == "log10p1":
        return log10p1(x)
    raise ValueError(f"unknown transform {how!r}")


def soft_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """A coordinate from 0 to ``bins`` - 1; 0 where the range is empty."""
    if bins < 2:
        raise ValueError("at least two bins")
    return F.when(high > low, (x - low) * (bins - 1) / (high - low)).otherwise(0.0)


def min_max(x: Column, low: Column, high: Column, flat: float = 0.0) -> Column:
    """Scaled to [0, 1]; ``flat`` where the range is empty."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(flat)
