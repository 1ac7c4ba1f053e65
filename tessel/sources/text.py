"""Tables, FASTA, GTF, BED, expression and log files.

All readers are Spark scans, so files are split and read by the executors, and any store of Spark's holds them.  Values stay
strings unless said otherwise; missing values of string tables are empty strings, as in the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns of the homology table that edges need.
HOMOLOGY_COLUMNS = ("gene_stable_id", "species", "homology_type", "homology_gene_stable_id", "homology_species")
EDGE_COLUMNS = ("gene1", "genome1", "gene2", "genome2", "relation")
GTF_COLUMNS = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
#: Number of a bucket in training tables.
FOLD_NUMBERS = {"TEST": 1, "VAL": 2, "TRAIN": 3}


def read_table(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """A delimited table with a header; every value is kept as a string."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, quote='"', escape='"')
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


def write_table(df: DataFrame, path: str, columns: list[str], sep: str = "|", compression: str = "none") -> None:
    """The named columns in that order; columns that ``df`` lacks and nulls are empty, others are left out."""
    out = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    out.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"', emptyValue="", compression=compression)


def header_id(header: Column) -> Column:
    """The last field of a piped header that is not blank, else the first word."""
    fields = F.filter(F.transform(F.split(header, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(header.contains("|"), F.element_at(fields, -1)).otherwise(F.regexp_extract(header, r"^\s*(\S*)", 1))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(id, header, seq) of all records; lines of a sequence are joined and upper-cased."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    cut = records.select(F.split("value", "\r?\n", 2).alias("x"))
    seq = F.upper(F.regexp_replace(F.coalesce(F.get("x", F.lit(1)), F.lit("")), r"\s", ""))
    return cut.select(header_id(F.col("x")[0]).alias("id"), F.trim(F.col("x")[0]).alias("header"), seq.alias("seq"))


def marked_fields(header: Column) -> Column:
    """genome, chrom, start, end, name, raw_id, id of a header of seven piped fields; a leading pipe may stand before them."""
    f = F.transform(F.split(F.regexp_replace(header, r"^\s*\|", ""), r"\|"), lambda x: F.trim(x))
    names = ("genome", "chrom", "start", "end", "name", "raw_id", "id")
    parts = [f[i].cast("long") if n in ("start", "end") else f[i] for i, n in enumerate(names)]
    return F.when(F.size(f) == 7, F.struct(*(p.alias(n) for p, n in zip(parts, names, strict=True))))


def read_marked(spark: SparkSession, path: str) -> DataFrame:
    """``read_fasta`` with the header's fields as columns; a header of another form has nulls."""
    found = read_fasta(spark, path).withColumn("m", marked_fields(F.col("header")))
    return found.select("m.*", "seq")


def fasta_record(header: Column, seq: Column, width: int | None = None) -> Column:
    """One record's text, its sequence in lines of ``width`` letters if given."""
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "") if width else seq
    return F.concat(F.lit(">"), header, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int | None = None) -> None:
    df.select(fasta_record(F.col(header), F.col(seq), width).alias("value")).write.mode("overwrite").text(path)


def read_gtf(spark: SparkSession, path: str, feature: str | None = None) -> DataFrame:
    """The nine columns of an annotation; comments and shorter lines are left out, coordinates are 1-based and inclusive."""
    lines = spark.read.text(path).where("not startswith(value, '#')").select(F.split("value", "\t").alias("x")).where(F.size("x") >= 9)
    rows = lines.select(*(F.col("x")[i].cast("long").alias(c) if c in ("start", "end") else F.col("x")[i].alias(c) for i, c in enumerate(GTF_COLUMNS)))
    return rows if feature is None else rows.where(F.col("feature") == feature)


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The value of ``key "value"``; of several the last."""
    return F.element_at(F.regexp_extract_all(attributes, F.lit(rf'(?:^|\W){key}\s+"([^"]*)"'), F.lit(1)), -1)


def gtf_attributes(attributes: Column) -> Column:
    """All ``key "value"`` pairs as a map; of a repeated key the last value counts."""
    pairs = F.arrays_zip(F.regexp_extract_all(attributes, F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(attributes, F.lit(r'(\w+)\s+"([^"]*)"'), F.lit(2)).alias("v"))
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("key"), p["v"].alias("value"), i.alias("i"))), lambda p: p["i"] == F.size(keys) - F.array_position(F.reverse(keys), p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["key"], p["value"])))


def read_wide(spark: SparkSession, path: str, sep: str = ",", keep: str = "first") -> DataFrame:
    """(gene, value, pos) of a table of one row whose header names genes; of a repeated gene the first or last stays, or all.

    Values that are no numbers are null.
    """
    text = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("x"))
    both = text.select(F.posexplode(F.arrays_zip(F.split(F.col("x")[0], sep).alias("gene"), F.split(F.col("x")[1], sep).alias("value"))).alias("pos", "p"))
    rows = both.select(F.trim("p.gene").alias("gene"), F.expr("try_cast(trim(p.value) as double)").alias("value"), "pos")
    if keep == "all":
        return rows
    order = F.col("pos") if keep == "first" else F.desc("pos")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("gene").orderBy(order))).where("__n = 1").drop("__n")


def write_wide(df: DataFrame, path: str, gene: str, value: str, sep: str = ",") -> None:
    """One row under a header of genes in their order.  The row holds one number per gene of an assembly, so it is one task's work."""
    items = F.array_sort(F.collect_list(F.struct(F.col(gene).alias("g"), F.col(value).alias("v"))))
    one = df.agg(items.alias("i")).select(F.concat(F.array_join(F.transform("i", lambda p: p["g"].cast("string")), sep), F.lit("\n"), F.array_join(F.transform("i", lambda p: p["v"].cast("string")), sep)).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(gene, count) of tabbed counts; rows of summaries, which begin with "__", are left out."""
    x = F.split("value", "\t")
    return spark.read.text(path).select(x[0].alias("gene"), x[1].cast("double").alias("count")).where("gene <> '' and not startswith(gene, '__')")


def read_matrix(spark: SparkSession, path: str, samples: list[str], sep: str = ",", key: str | None = None) -> DataFrame:
    """(id, sample, value) of an expression matrix: the samples named exactly, or by a part of their name, or else the first three.

    Cells that are no numbers are left out; of a repeated id the last row counts.
    """
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    names = [c.lstrip("﻿") for c in rows.columns]
    rows = rows.toDF(*names).withColumn("__at", F.monotonically_increasing_id())
    key = key or names[0]
    rest = [c for c in names if c != key]
    chosen = [c for c in rest if c in samples] or [c for c in rest if any(s in c for s in samples)] or rest[:3]
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))).where("__n = 1")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("sample"), F.expr(f"try_cast(`{c}` as double)").alias("value")) for c in chosen)))
    return last.select(F.col(key).alias("id"), cells.alias("c")).select("id", "c.sample", "c.value").where("value is not null")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand; 0-based and half-open.  A missing name is ``chrom:start-end``, a missing score 0, a missing strand "+"."""
    x = F.split("value", "\t")
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')")
    rows = rows.select(x[0].alias("chrom"), x[1].cast("long").alias("start"), x[2].cast("long").alias("end"), F.get(x, F.lit(3)).alias("name"), F.get(x, F.lit(4)).alias("score"), F.get(x, F.lit(5)).alias("strand"))
    place = F.concat(F.col("chrom"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end"))
    checked = F.when(F.col("end") <= F.col("start"), F.raise_error(F.concat(F.lit("empty interval "), place))).otherwise(F.col("end"))
    return rows.select(
        "chrom", "start", checked.cast("long").alias("end"),
        F.when(F.coalesce(F.trim("name"), F.lit("")).isin("", "."), place).otherwise(F.trim("name")).alias("name"),
        F.coalesce(F.expr("try_cast(score as double)"), F.lit(0.0)).alias("score"),
        F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise("+").alias("strand"),
    )


def write_bed(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("score").cast("string"), "strand").alias("value")).write.mode("overwrite").text(path)


def training_rows(df: DataFrame, bucket: str = "bucket") -> DataFrame:
    """seq_id, seq, mean_value, fold, rev: the bucket's number as fold, rows of other buckets left out, rev 0."""
    number = F.create_map(*(F.lit(v) for kv in FOLD_NUMBERS.items() for v in kv))[F.col(bucket)]
    return df.select("seq_id", "seq", "mean_value", number.alias("fold"), F.lit(0).alias("rev")).where("fold is not null")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the forward strand, with numbers as such."""
    rows = read_table(spark, path, "\t")
    return rows.select("seq_id", "seq", F.col("mean_value").cast("double"), F.col("fold").cast("int"), F.col("rev").cast("int")).where("rev = 0")


def read_homologies(spark: SparkSession, path: str) -> DataFrame:
    """A tabbed homology table, zipped or not; fails on the driver if a needed column is missing."""
    rows = read_table(spark, path, "\t")
    missing = [c for c in HOMOLOGY_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return rows


def write_edges(edges: DataFrame, path: str) -> None:
    write_table(edges, path, list(EDGE_COLUMNS), "\t", "gzip")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    rows = read_table(spark, path, "\t")
    if tuple(rows.columns) != EDGE_COLUMNS:
        raise ValueError(f"{path} has columns {rows.columns}")
    return rows


def write_vectors(df: DataFrame, path: str) -> None:
    """(id, role, layer, vec) as Parquet, a folder per layer."""
    df.select("id", F.col("role").cast("byte").alias("role"), "layer", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").partitionBy("layer").parquet(path)


def read_vectors(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """Only the folders of the wanted layers are read."""
    rows = spark.read.parquet(path).withColumn("layer", F.col("layer").cast("string"))
    return rows if layers is None else rows.where(F.col("layer").isin(layers))


def read_epochs(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """Metric lines of JSON (``fields`` is DDL with ``epoch``); lines that are none are left out, of an epoch the last counts."""
    lines = spark.read.text(path).select(F.from_json("value", fields).alias("r"), F.monotonically_increasing_id().alias("__at"))
    rows = lines.where("r.epoch is not null").select("r.*", "__at")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("epoch").orderBy(F.desc("__at")))).where("__n = 1").drop("__n", "__at")


def merge_sparse(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of each column the last value that is not blank."""
    rest = [c for c in df.columns if c not in (key, order)]
    last = (F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.col(order))).alias(c) for c in rest)
    return df.groupBy(key).agg(*last)
