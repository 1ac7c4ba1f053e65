"""Identifiers: cleaning, composing, taking apart, hashing, and the small vocabularies of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the held-out fold, after lower-casing and removal of blanks, "_" and "-".
ZSV_SPELLINGS = ("zsv", "zeroshot", "zeroshotvalidation")
# Other names of metrics, in lower case with "_" for blanks and "-".
METRIC_ALIASES = {
    "acc": "accuracy", "auroc": "auc", "r\u00b2": "r2", "genewise_pearson": "gene_wise_pearson", "gene_wise_pearson_median": "genewise_pearson_median",
    "samplewise_pearson": "sample_wise_pearson", "sample_wise_pearson_median": "samplewise_pearson_median", "learning_rate": "lr",
}
LOWER_IS_BETTER = ("loss", "mse", "rmse", "mae")
# Split strategies named in run names, in the order in which they are looked for, and what they are called.
STRATEGIES = {"hashfrag": "hashfrag", "pangenome": "pangenome", "mmseqs": "mmseqs", "blastp": "blastp", "paralog": "paralogs", "random": "random", "kmer": "kmer", "gc": "gc"}


def safe_name(x: Column) -> Column:
    """Runs of characters that are unsafe in file names become "_", outer ones go; nothing left is "sample"."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("sample"))


def mapped_id(sample: Column, region: Column) -> Column:
    """``{sample}__{region}``, each made safe for file names; null if either is."""
    return F.concat(safe_name(sample), F.lit("__"), safe_name(region.cast("string")))


def panel_id(x: Column) -> Column:
    """What stands after the last "__"; without one the query fails."""
    return F.when(x.contains("__"), F.substring_index(x, "__", -1)).when(x.isNotNull(), F.raise_error(F.concat(F.lit("no '__' in "), x)).cast("string"))


def marked_id(x: Column) -> Column:
    """The digits after the last "__", or the whole of a number; null for anything else."""
    return F.nullif(F.regexp_extract(F.substring_index(x, "__", -1), "^([0-9]+)$", 1), F.lit(""))


def accession(x: Column) -> Column:
    """The ``GCF_<digits>.<digits>`` at the start of a file's name; without one its name, less the last ending, up to ``_genomic``."""
    stem = F.regexp_replace(F.regexp_replace(x, "^.*/", ""), r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.nullif(F.regexp_extract(x, r"^(GCF_\d+\.\d+)", 1), F.lit("")), F.regexp_replace(stem, "_genomic.*$", ""))


def _bytes(x: Column) -> Column:
    """The UTF-8 bytes as an array of longs."""
    digits = F.hex(F.encode(x, "UTF-8"))
    n = F.length(digits) / 2
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a(x: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 32 bits, as a long."""
    # the prime is 2**24 + 403; the product is taken in two parts so that it stays within 64 bits
    def step(h: Column, b: Column) -> Column:
        return (h.bitwiseXOR(b) * 16777619) % 4294967296

    return F.aggregate(_bytes(x), F.lit(2166136261).cast("long"), step)


def hash_fold(x: Column, seed: int | str = 0, folds: int = 10) -> Column:
    """A fold from 1 to ``folds`` by the hash of ``seed:x``."""
    return (fnv1a(F.concat(F.lit(f"{seed}:"), x)) % folds + 1).cast("int")


def order_key(x: Column, seed: int | str) -> Column:
    """A reproducible pseudo-random order: the MD5 of ``seed:x``, the same in any SQL engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), x.cast("string")))


def protein_key(genome: Column, chrom: Column, raw: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.md5(F.concat_ws("|", genome, chrom, raw)), 1, 16))


def fold_label(x: Column) -> Column:
    """Spellings of the held-out fold become "zsv", of validation "val"; train and test are lower-cased; others are trimmed."""
    bare = F.trim(x)
    low = F.lower(bare)
    return (
        F.when(F.regexp_replace(low, "[ _-]", "").isin(*ZSV_SPELLINGS), "zsv")
        .when(low.isin("val", "validation"), "val")
        .when(low.isin("train", "test"), low)
        .otherwise(bare)
    )


def is_held_out(x: Column) -> Column:
    return F.coalesce(fold_label(x) == "zsv", F.lit(False))


def bucket(role: Column, fold: Column, strategy: str) -> Column:
    """The bucket of a row: "zero-shot-validation" over all; TRAIN, TEST or VAL by role, VAL going to TRAIN for "traintest"; or FOLD and the fold's name.

    Unknown roles, and blank folds for "fold", fail the query.
    """
    label = fold_label(role)
    if strategy == "fold":
        rest = F.when(F.trim(F.coalesce(fold, F.lit(""))) == "", F.raise_error(F.lit("a fold is blank")).cast("string")).otherwise(F.concat(F.lit("FOLD"), safe_name(fold)))
    elif strategy == "traintest":
        rest = F.upper(F.when(label == "val", "train").otherwise(label))
    elif strategy == "traintestval":
        rest = F.upper(label)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    unknown = F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("string")
    return F.when(is_held_out(fold) | is_held_out(role), "zero-shot-validation").when(~F.coalesce(label.isin("train", "test", "val"), F.lit(False)), unknown).otherwise(rest)


def without_prefix(x: Column, how: str) -> Column:
    """Identifier dialects, blanks and quotes around them aside: "gene" and "cds" (in any case) lose that prefix, "ctl" turns CTL0001 into CT_001."""
    bare = F.regexp_replace(F.trim(x), '^"+|"+$', "")
    if how == "gene":
        return F.regexp_replace(bare, "^gene-", "")
    if how == "cds":
        return F.regexp_replace(bare, "(?i)^cds-", "")
    if how == "ctl":
        number = F.regexp_extract(bare, "(?i)^CTL0*([0-9]+)$", 1)
        return F.when(number != "", F.concat(F.lit("CT_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))).otherwise(bare)
    if how == "none":
        return bare
    raise ValueError(f"unknown transform {how!r}")


def chromosome_token(x: Column) -> Column:
    """Number, X, Y or MT of a chromosome's name, "unplaced" for scaffolds and blank names, null for other names."""
    bare = F.trim(F.coalesce(x, F.lit("")))
    core = F.regexp_extract(bare, "(?i)^(?:chr|chromosome)?[_ ]?([0-9]+|X|Y|M|MT|MITO)$", 1)
    up = F.upper(core)
    number = F.regexp_replace(core, "^0+(?=[0-9])", "")
    return (
        F.when(bare == "", "unplaced")
        .when(core.rlike("^[0-9]+$"), number)
        .when(up.isin("X", "Y"), up)
        .when(up.isin("M", "MT", "MITO"), "MT")
        .when(bare.rlike("(?i)^(NW_|NT_|unplaced)|unplaced|_random_|_alt"), "unplaced")
    )


def strategy_of(run: Column) -> Column:
    """The first strategy whose name is in the run's name, else "unknown"."""
    low = F.lower(run)
    out = F
    for part, name in STRATEGIES.items():
        out = out.when(low.contains(part), name)
    return out.otherwise("unknown")


def strategy_number(run: Column, letter: str) -> Column:
    """The number after a parameter's letter in a run's name, as in ``_k7``; null if absent."""
    return F.nullif(F.regexp_extract(F.lower(run), f"(?:^|_){letter}([0-9]+)(?:_|$)", 1), F.lit("")).cast("int")


def metric_name(x: Column) -> Column:
    low = F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_")
    names = F.create_map(*[F.lit(v) for kv in METRIC_ALIASES.items() for v in kv])
    return F.coalesce(names[low], low)


def lower_is_better(x: Column) -> Column:
    """By name; of unknown metrics those are that speak of a loss or end in "error"."""
    name = metric_name(x)
    return name.isin(*LOWER_IS_BETTER) | name.contains("loss") | name.endswith("error")


def relation(homology_type: Column) -> Column:
    """"ortholog" or "paralog" by the type's name; null for others."""
    low = F.lower(homology_type)
    return F.when(low.contains("ortholog"), "ortholog").when(low.contains("paralog"), "paralog")
