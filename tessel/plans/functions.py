"""Queries of the scalar functions.  Sequences are made from part names, as the tables hold no genomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import sequences as Q
from . import Registry, Tables

R = Registry()

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASES = "acgtacgtacgtacgtacgtacgtac"
#: A nucleotide sequence from a name, the same in both engines.
SEQ_SQL = f"upper(regexp_replace(translate(lower(p_name || p_type || p_brand), '{LETTERS}', '{AS_BASES}'), '[^acgt]', 'n', 'g'))"


def sequences(t: Tables):
    raw = F.lower(F.concat("p_name", "p_type", "p_brand"))
    return t.part.select("p_partkey", F.upper(F.regexp_replace(F.translate(raw, LETTERS, AS_BASES), "[^acgt]", "n")).alias("seq"))


@R.add("f01_safe_name", "select c_custkey, coalesce(nullif(regexp_replace(regexp_replace(c_name || ' /' || c_mktsegment || '#', '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'sample') as name from customer")
def _(t):
    return t.customer.select("c_custkey", N.safe_name(F.concat("c_name", F.lit(" /"), "c_mktsegment", F.lit("#"))).alias("name"))


@R.add("f02_f03_composite_ids", "select l_orderkey, l_linenumber, 'S_' || l_orderkey::varchar || '__' || case when l_linenumber = 1 then 'sample' else 'r.' || l_linenumber::varchar end as id, case when l_linenumber = 1 then 'sample' else 'r.' || l_linenumber::varchar end as panel, null::varchar as marked, l_linenumber::varchar as marked_number from lineitem")
def _(t):
    region = F.when(F.col("l_linenumber") == 1, F.lit(" /#")).otherwise(F.concat(F.lit("_r."), F.col("l_linenumber").cast("string"), F.lit("? ")))
    x = t.lineitem.select("l_orderkey", "l_linenumber", N.mapped_id(F.concat(F.lit("/S "), F.col("l_orderkey").cast("string")), region).alias("id"))
    return x.select("*", N.panel_id(F.col("id")).alias("panel"), N.marked_id(F.col("id")).alias("marked"), N.marked_id(F.concat(F.lit("a__"), F.col("l_linenumber").cast("string"))).alias("marked_number"))


@R.add("f04_accession", "select s_suppkey, 'GCF_' || lpad(s_suppkey::varchar, 9, '0') || '.1' as accession, 'plain' || s_suppkey::varchar as stem, 'x_GCF_000000001.1_asm' as inner_name, 'GCF_nodot' as no_version from supplier")
def _(t):
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("GCF_"), F.lpad(k, 9, "0"), F.lit(".1_asm_genomic.gtf"))
    return t.supplier.select(
        "s_suppkey", N.accession(name).alias("accession"), N.accession(F.concat(F.lit("plain"), k, F.lit("_genomic.gtf"))).alias("stem"),
        N.accession(F.lit("x_GCF_000000001.1_asm_genomic.gtf")).alias("inner_name"), N.accession(F.lit("GCF_nodot.fna")).alias("no_version"),
    )


@R.add("f05_f06_fnv_folds", """
with recursive b as (select c_custkey, '0:' || c_name as s from customer),
h as (select c_custkey, s, 0 as i, 2166136261::bigint as h from b
      union all select c_custkey, s, i + 1, (xor(h, ascii(substr(s, i + 1, 1))::bigint)::hugeint * 16777619 % 4294967296)::bigint from h where i < length(s))
select c_custkey, h as hash, (h % 10 + 1)::int as fold from h where i = length(s)""")
def _(t):
    x = F.col("c_name")
    return t.customer.select("c_custkey", N.fnv1a(F.concat(F.lit("0:"), x)).alias("hash"), N.hash_fold(x).alias("fold"))


@R.add("f07_protein_key", "select s_suppkey, 'p' || substr(md5(s_nationkey::varchar || '|' || s_name || '|' || s_suppkey::varchar), 1, 16) as key from supplier")
def _(t):
    return t.supplier.select("s_suppkey", N.protein_key(F.col("s_nationkey").cast("string"), F.col("s_name"), F.col("s_suppkey").cast("string")).alias("key"))


@R.add("f08_f09_log_transforms", "select o_orderkey, log10(o_totalprice + 1) as log10p1, log2(o_totalprice + 1) as log2p1 from orders")
def _(t):
    return t.orders.select("o_orderkey", Q.transformed(F.col("o_totalprice"), "log10p1").alias("log10p1"), Q.log2p1(F.col("o_totalprice")).alias("log2p1"))


@R.add("f10_f11_scaling", """
select o_orderkey, case when hi > lo then (v - lo) * 17 / (hi - lo) else 0 end as bin18, case when hi > lo then (v - lo) / (hi - lo) else 0 end as unit
from (select o_orderkey, log2(o_totalprice + 1) as v, min(log2(o_totalprice + 1)) over (partition by o_orderpriority) as lo, max(log2(o_totalprice + 1)) over (partition by o_orderpriority) as hi from orders)""")
def _(t):
    v = t.orders.select("o_orderkey", "o_orderpriority", Q.log2p1(F.col("o_totalprice")).alias("v"))
    # group limits are aggregated and joined back, so a group is never sorted or held in one task
    r = v.groupBy("o_orderpriority").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    return v.join(F.broadcast(r), "o_orderpriority").select("o_orderkey", Q.soft_bin(x, lo, hi, 18).alias("bin18"), Q.min_max(x, lo, hi).alias("unit"))


@R.add("f12_f13_dna", f"""
select p_partkey, seq as dna, reverse(translate(seq, 'ACGTN', 'TGCAN')) as rc from (select p_partkey, {SEQ_SQL} as seq from part)""")
def _(t):
    return sequences(t).select("p_partkey", Q.normalise(F.col("seq")).alias("dna"), Q.reverse_complement(F.col("seq")).alias("rc"))


@R.add("f14_f15_composition", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part)
select p_partkey, coalesce(length(regexp_replace(seq, '[^GC]', '', 'g'))::double / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0), 0) as gc,
       case when length(seq) >= 3 then len(list_filter(range(1, length(seq) - 1), lambda i: substr(seq, i, 3) = 'AAA')) * 100.0 / (length(seq) - 2) else 0 end as aaa
from s""")
def _(t):
    return sequences(t).select("p_partkey", Q.gc_fraction(F.col("seq")).alias("gc"), Q.aaa_percent(F.col("seq")).alias("aaa"))


@R.add("f16_v06_stitch", f"select p_partkey, 'AGGACCGGATCAACT' || seq || 'CATTGCGTGAACCGA' as insert_seq from (select p_partkey, {SEQ_SQL} as seq from part) where length(seq) = 22")
def _(t):
    s = sequences(t).where(Q.has_length(F.col("seq"), 22))
    return s.select("p_partkey", Q.stitch(F.col("seq"), "AGGACCGGATCAACT", "CATTGCGTGAACCGA").alias("insert_seq"))


_CODONS = ", ".join(f"'{a}{b}{c}': '{Q.CODE[16 * i + 4 * j + k]}'" for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG"))


@R.add("f17_translation", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part),
a as (select p_partkey, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: coalesce((map {{{_CODONS}}})[substr(seq, i * 3 + 1, 3)], 'X')), '') as p from s)
select p_partkey, replace(regexp_replace(p, '\\*+$', ''), '*', 'X') as protein from a""")
def _(t):
    return sequences(t).select("p_partkey", Q.translate_dna(F.col("seq")).alias("protein"))


@R.add("f18_spliced_cds", f"""
with s as (select p_partkey, p_size, {SEQ_SQL} as seq from part), j as (select *, substr(seq, 2, 5) || substr(seq, 10, 6) as cds from s)
select p_partkey, case when p_size % 2 = 0 then cds else reverse(translate(cds, 'ACGTN', 'TGCAN')) end as cds from j""")
def _(t):
    s = sequences(t).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    exons = F.array(F.struct(F.lit(10).alias("start"), F.lit(15).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(6).alias("end")))
    return s.select("p_partkey", Q.spliced(exons, F.col("seq"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")).alias("cds"))


@R.add("f19_prefixes", "select s_suppkey, s_name as gene, s_name as cds, 'CT_' || case when length(s_suppkey::varchar) < 3 then lpad(s_suppkey::varchar, 3, '0') else s_suppkey::varchar end as ctl, 'gene-' || s_name as other from supplier")
def _(t):
    k = F.col("s_suppkey").cast("string")
    quoted = lambda p, x: F.concat(F.lit(' "' + p), x, F.lit('" '))
    return t.supplier.select(
        "s_suppkey", N.without_prefix(quoted("gene-", F.col("s_name")), "gene").alias("gene"), N.without_prefix(quoted("CDS-", F.col("s_name")), "cds").alias("cds"),
        N.without_prefix(quoted("ctl00", k), "ctl").alias("ctl"), N.without_prefix(F.concat(F.lit("gene-"), "s_name"), "cds").alias("other"),
    )


#: Names of chromosomes, and their tokens.
_CHROMOSOMES = {
    "chr1": "1", "007": "7", "chr 7": "7", "CHROMOSOME_12": "12", "chr100": "100", "x": "X", "chrY": "Y", "MT": "MT", "chrM": "MT", "Mito": "MT", "": "unplaced", "  ": "unplaced",
    "NW_001": "unplaced", "nt_9": "unplaced", "chr1_random_2": "unplaced", "chr3_alt": "unplaced", "my_Unplaced_1": "unplaced", "scaffold_9": None, "NC_000001.11": None, "chr": None,
}


@R.add("f20_chromosome_token", "select n_nationkey, raw, token from nation cross join (values " + ", ".join(f"('{a}', {'null' if b is None else repr(b)})" for a, b in _CHROMOSOMES.items()) + ") as v(raw, token)")
def _(t):
    rows = t.nation.select("n_nationkey", F.explode(F.array(*map(F.lit, _CHROMOSOMES))).alias("raw"))
    return rows.select("*", N.chromosome_token(F.col("raw")).alias("token"))


@R.add("f21_run_names", """
select l_orderkey, l_linenumber, case l_linenumber when 1 then 'kmer' when 2 then 'pangenome' when 3 then 'paralogs' when 4 then 'hashfrag' when 5 then 'gc' when 6 then 'random' else 'unknown' end as strategy,
 case when l_linenumber <= 2 then l_linenumber end as k from lineitem""")
def _(t):
    n = F.col("l_linenumber")
    run = F.when(n == 1, F.lit("run9_kmer_k1_legnet")).when(n == 2, "run9_pangenome_kmer_k2").when(n == 3, "run5_Paralog_x").when(n == 4, "random_hashfrag").when(n == 5, "run_GC").when(n == 6, "run9_random_paralo").otherwise("run_loco")
    return t.lineitem.select("l_orderkey", "l_linenumber", N.strategy_of(run).alias("strategy"), N.strategy_number(run, "k").alias("k"))


@R.add("f22_json_payload", """select s_suppkey, '{"balance":' || floor(s_acctbal)::bigint || ',"nation":' || s_nationkey || '}' as additional, s_nationkey as nation from supplier""")
def _(t):
    x = t.supplier.select("s_suppkey", F.to_json(F.struct(F.floor("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))).alias("additional"))
    return x.select("*", F.from_json("additional", "balance long, nation int")["nation"].alias("nation"))


#: Spellings of metrics, their names, and whether less is better.
_METRICS = {
    "AUROC": ("auc", False), " Acc ": ("accuracy", False), "Genewise Pearson": ("gene_wise_pearson", False), "gene-wise-pearson-median": ("genewise_pearson_median", False), "Learning Rate": ("lr", False),
    "samplewise_pearson": ("sample_wise_pearson", False), "MSE": ("mse", True), "val loss": ("val_loss", True), "mean squared error": ("mean_squared_error", True), "R2": ("r2", False),
}


@R.add("f23_metric_names", "select event_id, raw, metric, lower_better from events cross join (values " + ", ".join(f"('{k}', '{a}', {str(b).lower()})" for k, (a, b) in _METRICS.items()) + ") as v(raw, metric, lower_better)")
def _(t):
    rows = t.events.select("event_id", F.explode(F.array(*map(F.lit, _METRICS))).alias("raw"))
    return rows.select("*", N.metric_name(F.col("raw")).alias("metric"), N.lower_is_better(F.col("raw")).alias("lower_better"))


@R.add("f25_kmer_packing", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part), w as (select p_partkey, unnest(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 5))) as k from s),
v as (select p_partkey, k, list_sum(list_transform(range(1, 6), lambda i: (strpos('ACGT', substr(k, i, 1)) - 1) * pow(4, 5 - i)))::bigint as code from w where not contains(k, 'N'))
select p_partkey, code, k as kmer from v""")
def _(t):
    s = sequences(t).select("p_partkey", F.explode(Q.kmers(F.col("seq"), 5)).alias("k"))
    return s.select("p_partkey", Q.pack_kmer(F.col("k")).alias("code")).select("*", Q.unpack_kmer(F.col("code"), 5).alias("kmer"))


@R.add("f26_timestamps", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@R.add("v10_v11_labels", """
select l_orderkey, l_linenumber, role, case role when 'zsv' then 'zero-shot-validation' when 'val' then 'TRAIN' else upper(role) end as two, case role when 'zsv' then 'zero-shot-validation' else upper(role) end as three,
 case role when 'zsv' then 'zero-shot-validation' else 'FOLDf_' || l_linenumber end as fold, 'zeroshotval' as other
from (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'zsv' when 1 then 'val' when 2 then 'train' else 'test' end as role from lineitem)""")
def _(t):
    n = F.col("l_linenumber") % 4
    raw = F.when(n == 0, " Zero-Shot_validation ").when(n == 1, "Validation").when(n == 2, "TRAIN").otherwise("Test ")
    x = t.lineitem.select("l_orderkey", "l_linenumber", N.fold_label(raw).alias("role"), F.concat(F.lit("f "), F.col("l_linenumber").cast("string")).alias("f"))
    kinds = {"two": "traintest", "three": "traintestval", "fold": "fold"}
    return x.select("l_orderkey", "l_linenumber", "role", *(N.bucket(F.col("role"), F.col("f"), k).alias(c) for c, k in kinds.items()), N.fold_label(F.lit("zeroshotval")).alias("other"))


@R.add("k01_kmer_counts", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part), k as (select p_partkey, unnest(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 4))) as kmer from s)
select p_partkey, kmer, count(*) as n from k where not contains(kmer, 'N') group by 1, 2""")
def _(t):
    from ..operators.features import kmer_counts

    return kmer_counts(sequences(t), "p_partkey", "seq", 4)


@R.add("k02_kmer_frequencies", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part), k as (select p_partkey, unnest(list_transform(range(1, length(seq) - 3), lambda i: substr(seq, i, 4))) as kmer from s),
c as (select p_partkey, kmer, count(*) as n from k where not contains(kmer, 'N') group by 1, 2)
select p_partkey, 'kmer_' || kmer as feature, ln(1 + n / sum(n) over (partition by p_partkey)) as value from c""")
def _(t):
    from ..operators.features import kmer_features

    return kmer_features(sequences(t), "p_partkey", "seq", [4], log=True)


@R.add("k03_composition_features", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part)
select p_partkey, 'GC_pct' as feature, 100 * coalesce(length(regexp_replace(seq, '[^GC]', '', 'g'))::double / nullif(length(regexp_replace(seq, '[^ACGT]', '', 'g')), 0), 0) as value from s
union all select p_partkey, 'AAA_pct', case when length(seq) >= 3 then len(list_filter(range(1, length(seq) - 1), lambda i: substr(seq, i, 3) = 'AAA')) * 100.0 / (length(seq) - 2) else 0 end from s""")
def _(t):
    from ..operators.features import composition_features

    return composition_features(sequences(t), "p_partkey", "seq")


@R.add("k04_dense_kmers", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part),
grid as (select a || b as kmer from (values ('A'), ('C'), ('G'), ('T')) x(a), (values ('A'), ('C'), ('G'), ('T')) y(b)),
k as (select p_partkey, unnest(list_transform(range(1, length(seq)), lambda i: substr(seq, i, 2))) as kmer from s),
c as (select p_partkey, kmer, count(*) as n from k where not contains(kmer, 'N') group by 1, 2),
n as (select p_partkey, sum(n) as total from c group by 1)
select s.p_partkey, list(coalesce(c.n, 0) / coalesce(n.total, 1) order by grid.kmer) as vec from s cross join grid left join c on c.p_partkey = s.p_partkey and c.kmer = grid.kmer left join n on n.p_partkey = s.p_partkey group by 1""")
def _(t):
    from ..operators.features import dense_kmers

    return dense_kmers(sequences(t), "p_partkey", "seq", 2)


@R.add("w08_prefix_gc", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part)
select p_partkey, list_transform(range(1, length(seq) + 1), lambda i: length(regexp_replace(substr(seq, 1, i::int), '[^GC]', '', 'g'))::int) as prefix from s""")
def _(t):
    from ..operators.features import prefix_counts

    return sequences(t).select("p_partkey", prefix_counts(F.col("seq"), "GC").alias("prefix"))


@R.add("m14_first_atg", f"""
with s as (select p_partkey, {SEQ_SQL} as seq from part)
select p_partkey, length(seq) as n, strpos(replace(seq, 'N', ''), 'ATG') as atg,
       case when strpos(replace(seq, 'N', ''), 'ATG') > 0 then list_filter(range(1, length(seq) + 1), lambda i: substr(seq, i::int, 1) <> 'N')[strpos(replace(seq, 'N', ''), 'ATG')] end::bigint as column_no from s""")
def _(t):
    from ..operators.features import first_motif

    s = sequences(t).select("p_partkey", "seq", F.translate("seq", "N", "-").alias("aligned"))
    return s.select("p_partkey", F.length("seq").cast("long").alias("n"), F.instr(F.translate("aligned", "-", ""), "ATG").cast("long").alias("atg"), first_motif(F.col("aligned"), "ATG").alias("column_no"))
