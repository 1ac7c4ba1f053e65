"""Queries of placement, refinement, strategies of splits, graph files, and the statistics that go with them."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import features as K
from ..operators import graphs as G
from ..operators import intervals as I  # noqa: E741
from ..operators import metrics as M
from ..operators import placement as P
from ..operators import refine as C
from ..operators import splits as L
from ..operators import strategies as T
from ..sources import graph as S
from ..storage import Stored
from . import Registry
from .functions import SEQ_SQL, sequences
from .splitting import _ROLE, _ranked
from .tables import _IV, intervals

R = Registry()


# intervals


@R.add("a02_exons", f"""
select chrom, list(struct_pack(start := start, "end" := "end") order by start, "end") as segments from {_IV} group by chrom""")
def _(t):
    return I.grouped_segments(intervals(t), ["chrom"])


@R.add("i02_centre_trim", f"""
select id, start + greatest("end" - start + 1 - 20, 0) // 2 as start, "end" - (greatest("end" - start + 1 - 20, 0) - greatest("end" - start + 1 - 20, 0) // 2) as "end" from {_IV}""")
def _(t):
    segments = F.array(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    return intervals(t).select("id", F.inline(I.centre_trim(segments, 20)))


@R.add("i03_segment_sequence", f"select 'p' || p_partkey as id, substr(s, 3, 4) || substr(s, 9, 3) as seq from (select p_partkey, {SEQ_SQL} as s from part)")
def _(t):
    pair = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((3, 6), (9, 11))])
    return sequences(t).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), I.segment_sequence(F.col("seq"), pair).alias("seq"))


_SITES = "(select s_suppkey as id, s_nationkey as chrom, s_suppkey * 13 % 1009 as start, s_suppkey * 13 % 1009 + s_suppkey % 40 as \"end\" from supplier)"


def sites(t):
    s = F.col("s_suppkey") * 13 % 1009
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("chrom"), s.alias("start"), (s + F.col("s_suppkey") % 40).alias("end"))


@R.add("i06_trimmed_windows", f"""
with i as {_SITES}, n as (select a.id, any_value(a.chrom) as chrom, any_value(a.start) as s, any_value(a."end") as e, max(b."end") filter (where b."end" < a.start) as u, min(b.start) filter (where b.start > a."end") as d
 from i a left join i b using (chrom) group by 1), w as (select id, chrom, greatest(1, s - 100) as low, e + 100 as high, u, d from n),
x as (select *, greatest(low, coalesce(u + 1, low)) as a, least(high, coalesce(d - 1, high)) as b from w)
select id, chrom, case when a <= b then a else low end as window_start, case when a <= b then b else high end as window_end from x""")
def _(t):
    return I.trim_to_neighbours(sites(t), "chrom", "id", 100)


def contigs(t):
    """Twelve contigs of two genomes, each of many part names."""
    part = F.col("p_partkey") % 12
    joined = sequences(t).withColumn("c", part).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return joined.select(F.concat(F.lit("G"), (F.col("c") % 2).cast("string")).alias("genome"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("chrom"), "seq")


def genes(t):
    """A gene per supplier, spread over the contigs."""
    k = F.col("s_suppkey")
    c = k % 12
    start = (k * 37) % 200 + 1
    return t.supplier.select(
        F.concat(F.lit("G"), (c % 2).cast("string")).alias("genome"), F.concat(F.lit("c"), c.cast("string")).alias("chrom"), F.concat(F.lit("g"), k.cast("string")).alias("gene"),
        F.concat(F.lit("n"), (k % 7).cast("string")).alias("name"), start.alias("start"), (start + k % 9 + 3).alias("end"), F.when(k % 2 == 0, "-").otherwise("+").alias("strand"),
    )


def gaps(t):
    lengths = contigs(t).select("genome", "chrom", F.length("seq").alias("length"))
    return I.free_intervals(genes(t), lengths.select("chrom", "length"), "chrom").join(lengths.select("genome", "chrom"), "chrom").select("genome", "chrom", "start", "end")


@R.add("i08_random_placement")
def _(t):
    return P.random_placement(genes(t), gaps(t), "gene", 3, most=6)


@R.add("i09_matched_placement")
def _(t):
    return P.match_windows(genes(t), gaps(t), contigs(t), seed=5)


@R.add("i10_gene_windows")
def _(t):
    return P.gene_windows(genes(t), contigs(t), t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_nationkey").cast("double").alias("tpm")), 2, 5)


# graphs


def homologs(t):
    """Nodes and edges of a graph with orthologs across and paralogs within species."""
    n = t.customer.select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 4).cast("string").alias("species"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).otherwise("").alias("marked"))
    o = t.orders.select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 140 + 1).alias("v"))
    same = F.col("u") % 4 == F.col("v") % 4
    e = o.where("u <> v and (u + v) % 5 < 2").select("u", "v", F.when(same, "paralog").otherwise("ortholog").alias("relation"))
    return n, e.where((F.col("relation") == "paralog") | ((F.col("u") + F.col("v")) % 15 == 0))


@R.add("g07_members")
def _(t):
    return C.extract_clusters(*homologs(t))[0]


@R.add("g07_summary")
def _(t):
    return C.extract_clusters(*homologs(t))[1]


@R.add("j12_both_ends", 'select c_custkey as u, c_nationkey * 3 + 1 as v from customer where c_custkey in (select s_suppkey from supplier) and c_nationkey * 3 + 1 in (select s_suppkey from supplier)')
def _(t):
    return G.both_ends(t.customer.select(F.col("c_custkey").alias("u"), (F.col("c_nationkey") * 3 + 1).alias("v")), t.supplier, "s_suppkey")


@R.add("g04_capped_edges", "select l_suppkey as u, l_partkey as v, sum(l_quantity) as w from lineitem group by 1, 2 order by w desc, u, v limit 50")
def _(t):
    return G.capped_edges(t.lineitem.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.sum("l_quantity").alias("w")), "w", 50)


@R.add("g05_refined_clusters")
def _(t):
    s = sequences(t).select(F.col("p_partkey").alias("region"), "seq")
    found = G.contingency_clusters(s, "region", "seq", 8)
    return C.refine_shared(found, G.kmer_sets(s, "region", "seq", 8), 10)


@R.add("s18_graph_files", "select l_suppkey as u, l_partkey as v, count(*) as n, 8 as k, (select count(*) from supplier) as n_nodes from lineitem group by 1, 2")
def _(t):
    path = Stored(t.spark, "graph").path("g")
    S.write_graph(path, t.supplier.select("s_suppkey"), t.lineitem.groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.count("*").alias("n")), {"k": 8})
    _, edges, meta = S.read_graph(t.spark, path)
    return edges.select("*", F.lit(meta["k"]).alias("k"), F.lit(meta["n_nodes"]).cast("long").alias("n_nodes"))


@R.add("s23_tensors", "select i as row, [i * 0.5, i + 0.25]::double[] as vec from range(5) as r(i)")
def _(t):
    path = Stored(t.spark, "tensors").path("files")
    header = b'{"w": {"dtype": "F32", "shape": [5, 2], "data_offsets": [0, 40]}, "ids": {"dtype": "I64", "shape": [1], "data_offsets": [40, 48]}}'
    numbers = struct.pack("<10f", *(x for i in range(5) for x in (i * 0.5, i + 0.25))) + struct.pack("<q", 7)
    content = struct.pack("<Q", len(header)) + header + numbers
    fs = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    out = fs.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/m.safetensors"), True)
    out.write(bytearray(content))
    out.close()
    return S.read_tensors(t.spark, path, "w").select("row", F.col("vec").cast("array<double>").alias("vec"))


# strategies


def _ids(t):
    return t.customer.select(F.col("c_custkey").alias("ID"), F.concat(F.lit("G"), (F.col("c_nationkey") % 3).cast("string")).alias("genome"), F.concat(F.lit("chr"), F.col("c_nationkey").cast("string")).alias("chr"))


def _folds(t):
    return t.customer.select(F.col("c_custkey").alias("ID"), F.when(F.col("c_custkey") % 10 == 0, "Zero-Shot Validation").otherwise((F.col("c_custkey") % 10).cast("string")).alias("fold"))


def _part_ids(t):
    return t.part.select(F.col("p_partkey").alias("ID"))


def _part_sequences(t):
    return {"sequences": sequences(t).select(F.col("p_partkey").alias("ID"), "seq")}


@R.add("l12_random", f"""
select c_custkey as "ID", {_ROLE} as train_test, (c_custkey % 10)::varchar as fold from {_ranked('(select * from customer where c_custkey % 10 > 0) as c', 'c_custkey', 42)}
union all select c_custkey, 'zsv', 'zsv' from customer where c_custkey % 10 = 0""")
def _(t):
    return T.split("random", _ids(t), folds=_folds(t))


@R.add("l11_gc")
def _(t):
    return T.split("gc", _part_ids(t), tables=_part_sequences(t), method="kmeans", clusters=6)


@R.add("l11_kmer")
def _(t):
    return T.split("kmer", _part_ids(t), tables=_part_sequences(t), k=2, method="kmeans_elbow")


@R.add("l11_pangenome")
def _(t):
    return T.split("pangenome", _part_ids(t), tables=_part_sequences(t), k=8, method="contingency", most=20)


@R.add("l11_blastp")
def _(t):
    hits = t.orders.where("o_custkey % 4 = 0").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 50 + 1).alias("v"))
    return T.split("blastp", _ids(t), folds=_folds(t), tables={"hits": hits})


@R.add("l12_mmseqs")
def _(t):
    return T.split("mmseqs", _ids(t), tables={"clusters": t.customer.select(F.col("c_nationkey").alias("representative"), F.col("c_custkey").alias("member")).where("member % 7 > 0")})


@R.add("l12_hashfrag")
def _(t):
    return T.split("hashfrag", _ids(t), folds=_folds(t), tables={"groups": t.customer.select(F.col("c_custkey").alias("ID"), F.col("c_nationkey").alias("group"))})


@R.add("l12_paralogs_only")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("ID"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("orthogroup"), (F.col("c_custkey") % 5).alias("degree"))
    return T.split("paralogs_only", _ids(t), tables={"genes": rows})


@R.add("l12_loco")
def _(t):
    return T.split("loco", _ids(t), folds=_folds(t))


@R.add("l12_scores", """
with n as (select count(*) as n from customer), s as (select c_custkey, c_acctbal as a, (c_custkey * 31 % 101)::double as b from customer),
q as (select (n * 6 // 10) as train, (n * 2 // 10) as test from n), a as (select *, row_number() over (order by a desc, c_custkey) as r from s),
x as (select a.*, r <= train as top from a, q), y as (select *, row_number() over (partition by top order by b desc, c_custkey) as r2 from x)
select c_custkey as "ID", case when top then 'train' when r2 <= (select test from q) then 'test' else 'val' end as train_test, null::varchar as fold from y""")
def _(t):
    scores = t.customer.select(F.col("c_custkey").alias("ID"), F.col("c_acctbal").alias("train"), F.lit(0.0).alias("val"), (F.col("c_custkey") * 31 % 101).cast("double").alias("test"))
    return T.split("vgae", _ids(t), tables={"scores": scores}, ratios=L.Ratios(train=6, test=2, val=2))


# audits and statistics


@R.add("w03_ranking", """
select l_returnflag, l_suppkey as run, median, auc, row_number() over (partition by l_returnflag order by median desc, auc desc, l_suppkey) as rank
from (select l_returnflag, l_suppkey, floor(avg(l_quantity)) as median, max(l_tax) as auc from lineitem group by 1, 2)""")
def _(t):
    per = t.lineitem.groupBy("l_returnflag", F.col("l_suppkey").alias("run")).agg(F.floor(F.avg("l_quantity")).cast("double").alias("median"), F.max("l_tax").alias("auc"))
    return A.ranking(per, ["l_returnflag"])


@R.add("a11_strata", """
with m as (select c_nationkey, c_mktsegment, count(*) as n, min(c_custkey) as f from customer group by 1, 2), b as (select c_nationkey, arg_max(c_mktsegment, struct_pack(n := n, f := -f)) as s from m group by 1),
t as (select c_nationkey, sum((c_custkey % 7)::double) as x from customer group by 1) select c_nationkey, 'x=' || printf('%.6f', x) || '||c_mktsegment=' || s as strata from t join b using (c_nationkey)""")
def _(t):
    return A.stratum_summary(t.customer.withColumn("x", (F.col("c_custkey") % 7).cast("double")), "c_nationkey", ["x"], ["c_mktsegment"], "c_custkey")


@R.add("a12_fold_sizes", """
with z as (select s_nationkey::varchar as f, count(*) as n from supplier group by 1), t as (select f, n from z order by n desc, f limit 10)
select count(*) as n_folds, avg((n = 1)::int) as singletons, min(n) as least, median(n) as median, avg(n) as mean, max(n) as most, (select list(f || ':' || n order by n desc, f) from t) as largest from z""")
def _(t):
    return A.fold_sizes(t.supplier.select(F.col("s_nationkey").cast("string").alias("fold")), "fold")


@R.add("e04_area", """
with c as (select tau, avg((c_acctbal / 10000 >= tau - 1e-12)::int) as s from customer, (select i / 10.0::double as tau from range(11) as r(i)) group by 1),
x as (select tau, s, lead(tau) over (order by tau) as t2, lead(s) over (order by tau) as s2 from c) select sum((t2 - tau) * (s2 + s) / 2) as auc from x""")
def _(t):
    c = t.customer.select((F.col("c_acctbal") / 10000).alias("s")).crossJoin(F.broadcast(t.spark.range(11).select((F.col("id") / 10).alias("tau"))))
    return A.area(c.groupBy("tau").agg(F.avg((F.col("s") >= F.col("tau") - 1e-12).cast("int")).alias("share")))


@R.add("m04_median_pearson", """
with g as (select l_suppkey, count(*) as n, covar_pop(l_quantity, l_discount) * count(*) / (sqrt(var_pop(l_quantity) * count(*) * var_pop(l_discount) * count(*)) + 1e-8) as r from lineitem group by 1)
select quantile_disc(r, 0.5) as median from g where n >= 2""")
def _(t):
    x = t.lineitem.groupBy("l_suppkey").agg(M.damped_pearson(F.col("l_quantity"), F.col("l_discount")).alias("x"))
    return x.agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("median"))


@R.add("m05_accuracy", "select l_returnflag, avg(((l_quantity > 25)::int = (l_discount * 10 >= 0.5)::int)::int) as accuracy from lineitem group by 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(M.accuracy(F.col("l_quantity") > 25, F.col("l_discount") * 10).alias("accuracy"))


@R.add("m08_ks_similarity", """
with v as (select distinct l_quantity as x from lineitem), r as (select distinct l_returnflag as run from lineitem), c as (select run, x, (select avg((l_quantity <= x)::int) from lineitem where l_returnflag = run) as f from v, r)
select a.run as run_a, b.run as run_b, 1 - max(abs(a.f - b.f)) as similarity from c a join c b on a.x = b.x and a.run < b.run group by 1, 2""")
def _(t):
    return M.ks_similarity(t.lineitem, "l_returnflag", "l_quantity")


@R.add("m09_size_normalised")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("n"), F.col("l_discount").alias("gap"))
    return M.size_normalised(rows, "y", "n", "gap")


def _differences(t):
    return t.lineitem.select("l_suppkey", (F.col("l_quantity") - F.col("l_discount") * 250 - 13).alias("d"))


@R.add("m10_wilcoxon", """
with d as (select l_suppkey, l_quantity - l_discount * 250 - 13 as d from lineitem), u as (select l_suppkey, d, abs(d) as a from d where d <> 0),
k as (select *, rank() over (partition by l_suppkey order by a) + (count(*) over (partition by l_suppkey, a) - 1) / 2 as r from u),
t as (select l_suppkey, sum(t * t * t - t) as ties from (select l_suppkey, a, count(*) as t from u group by 1, 2) group by 1),
g as (select l_suppkey, count(*) as n, sum(case when d > 0 then r else 0 end) as w_plus, median(d) as median from k group by 1)
select l_suppkey, n, w_plus, median, (w_plus - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) as z from g join t using (l_suppkey) where n >= 5""")
def _(t):
    return M.wilcoxon(_differences(t), ["l_suppkey"], "d").select("l_suppkey", "n", "w_plus", "median", "z")


@R.add("m10_false_discovery", """
with p as (select l_suppkey, (l_suppkey * 37 % 101 + 1) / 200.0::double as p from (select distinct l_suppkey from lineitem)), k as (select *, p * count(*) over () / row_number() over (order by p, l_suppkey) as raw from p)
select l_suppkey, p, least(1.0, min(raw) over (order by p desc, l_suppkey desc rows between unbounded preceding and current row)) as q from k""")
def _(t):
    p = t.lineitem.select("l_suppkey").distinct().withColumn("p", (F.col("l_suppkey") * 37 % 101 + 1) / 200.0)
    return M.benjamini_hochberg(p, "p", ["l_suppkey"])


@R.add("m15_density", """
with s as (select l_returnflag, count(*) as n, greatest(stddev_samp(l_quantity), 1e-6) * pow(count(*), -0.2) as h from lineitem group by 1), g as (select i * (60.0::double / 19) as x from range(20) as r(i))
select l_returnflag, x, avg(exp(-pow((x - l_quantity) / h, 2) / 2) / (h * 2.5066282746310002)) as density from lineitem join s using (l_returnflag), g group by 1, 2""")
def _(t):
    return M.density(t.lineitem, "l_quantity", 0.0, 60.0, 20, ["l_returnflag"])


@R.add("k05_projection")
def _(t):
    counts = K.kmer_features(sequences(t), "p_partkey", "seq", [3])
    return K.projected(counts, "p_partkey", "feature", "value", 8, 3)
