"""Queries of split assignment, its audit, and the graphs that splits come from.

Customers stand for regions, nations for clusters and market segments for strata.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import splits as L
from ..operators.components import connected_components
from . import Registry

R = Registry()

#: Sizes of train, val and test among n rows by default, as SQL over a column n.
_TEST = "greatest(1, round_even(n * 0.1, 0))::bigint"
_VAL = f"greatest(1, round_even((n - {_TEST}) * 0.1, 0))::bigint"


def _ranked(table: str, key: str, seed: int, by: str = "") -> str:
    part = f"partition by {by} " if by else ""
    over = f"({part.strip()})" if by else "()"
    return f"(select *, row_number() over ({part}order by md5('{seed}:' || {key}::varchar), {key}) as rank, count(*) over {over} as n from {table})"


_ROLE = f"case when rank <= n - {_TEST} - {_VAL} then 'train' when rank <= n - {_TEST} then 'val' else 'test' end"


@R.add("l01_sizes", f"select l_orderkey, n - {_TEST} - {_VAL} as n_train, {_VAL} as n_val, {_TEST} as n_test from (select l_orderkey, count(*) + 2 as n from lineitem group by 1)")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg((F.count("*") + 2).alias("n"))
    s = L.size_columns(F.col("n"))
    return n.select("l_orderkey", *[s[r].cast("long").alias(f"n_{r}") for r in ("train", "val", "test")])


@R.add("l02_random_split", f"select c_custkey, {_ROLE} as train_test from {_ranked('customer', 'c_custkey', 7)}")
def _(t):
    return L.random_split(t.customer.select("c_custkey"), "c_custkey", 7)


@R.add("l03_stratified_split", f"select c_custkey, c_mktsegment, {_ROLE} as train_test from {_ranked('customer', 'c_custkey', 7, 'c_mktsegment')}")
def _(t):
    return L.stratified_split(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey", ["c_mktsegment"], 7)


@R.add("l04_two_level_split", f"""
with a as (select c_custkey, {_ROLE} as m1 from {_ranked('customer', 'c_custkey', 3)})
select c_custkey, m1, {_ROLE} as m2, case m1 when 'train' then 0 when 'val' then 1 else 2 end as class from {_ranked('a', 'c_custkey', 4, 'm1')}""")
def _(t):
    return L.two_level_split(t.customer.select("c_custkey"), "c_custkey", 3)


@R.add("l05_greedy_roles", """
with recursive f as (select c_nationkey, count(*) as size, row_number() over (order by count(*) desc, c_nationkey) as i from customer group by 1),
g as (select 0::bigint as i, 0::bigint as te, 0::bigint as tr, 0::bigint as va, -1 as c_nationkey, 0::bigint as size, '' as train_test
  union all
  select i, te + (case when pick = 'test' then size else 0 end)::bigint, tr + (case when pick = 'train' then size else 0 end)::bigint, va + (case when pick = 'val' then size else 0 end)::bigint, k, size, pick
  from (select *, case when ct <= least(ct, cr, cv) + 1e-12 then 'test' when cr <= least(ct, cr, cv) + 1e-12 then 'train' else 'val' end as pick
        from (select f.i, g.te, g.tr, g.va, f.c_nationkey as k, f.size, g.te + g.tr + g.va + f.size as n,
                abs((g.te + f.size) / n - 0.2) + abs(g.tr / n - 0.6) + abs(g.va / n - 0.2) as ct,
                abs(g.te / n - 0.2) + abs((g.tr + f.size) / n - 0.6) + abs(g.va / n - 0.2) as cr,
                abs(g.te / n - 0.2) + abs(g.tr / n - 0.6) + abs((g.va + f.size) / n - 0.2) as cv
              from g join f on f.i = g.i + 1)))
select c_nationkey, size, train_test from g where i > 0""")
def _(t):
    return L.greedy_roles(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("size")), "c_nationkey", "size")


@R.add("l06_shuffled_roles", f"with f as (select distinct c_nationkey from customer) select c_nationkey, {_ROLE} as train_test from {_ranked('f', 'c_nationkey', 5)}")
def _(t):
    return L.shuffled_roles(t.customer.select("c_nationkey").distinct(), "c_nationkey", 5)


@R.add("l07_assignment", f"""
with f as (select distinct c_nationkey from customer), r as (select c_nationkey, {_ROLE} as train_test from {_ranked('f', 'c_nationkey', 5)})
select c_custkey as region, c_nationkey as cluster, train_test, c_nationkey::varchar as fold, '{{"c_mktsegment":"' || c_mktsegment || '"}}' as additional from customer join r using (c_nationkey)""")
def _(t):
    roles = L.shuffled_roles(t.customer.select("c_nationkey").distinct(), "c_nationkey", 5)
    return L.assignment(t.customer, "c_custkey", "c_nationkey", roles, ["c_mktsegment"])


@R.add("l08_chromosome_split", f"""
with p as (select distinct c_mktsegment as genome, (c_nationkey + 1) as k from customer),
f as (select genome || '|chr' || k as fold, case when k <= 22 then k::varchar when k = 23 then 'X' when k = 24 then 'Y' else 'MT' end as token
      from p),
s as (select *, case when count(*) over (partition by token) >= 3 then token else '(pooled)' end as stratum
      from (select case when token = 'X' then replace(fold, 'chr23', 'chrX') when token = 'Y' then replace(fold, 'chr24', 'chrY') when token = 'MT' then replace(fold, 'chr25', 'MT') else fold end as fold, token from f))
select fold, token, case when n < 3 then (['train', 'val', 'test'])[(rank - 1) % 3 + 1] else {_ROLE} end as train_test from {_ranked('s', 'fold', 2, 'stratum')}""")
def _(t):
    k = F.col("c_nationkey") + 1
    chrom = F.when(k <= 22, F.concat(F.lit("chr"), k.cast("string"))).when(k == 23, "chrX").when(k == 24, "chrY").otherwise("MT")
    return L.chromosome_split(t.customer.select("c_mktsegment", chrom.alias("chrom")), "c_mktsegment", "chrom", 2)


@R.add("w07_take_groups", """
select c_nationkey, size, coalesce(sum(size) over (order by md5('1:' || c_nationkey::varchar), c_nationkey rows between unbounded preceding and 1 preceding), 0) < sum(size) over () * 0.2 as taken
from (select c_nationkey, count(*) as size from customer group by 1)""")
def _(t):
    return L.take_groups(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("size")), "c_nationkey", "size", 0.2, 1)


@R.add("l09_orthogonal_split", f"""
with g as (select c_nationkey, count(*) as size from customer group by 1),
k as (select c_nationkey, coalesce(sum(size) over (order by md5('1:' || c_nationkey::varchar), c_nationkey rows between unbounded preceding and 1 preceding), 0) < sum(size) over () * 0.1 as taken from g),
m as (select c_custkey, c_nationkey, taken from customer join k using (c_nationkey)), rest as (select c_custkey, c_nationkey from m where not taken)
select c_custkey, c_nationkey, 'test' as train_test from m where taken
union all select c_custkey, c_nationkey, case when rank <= {_TEST} then 'val' else 'train' end from {_ranked('rest', 'c_custkey', 2)}""")
def _(t):
    return L.orthogonal_split(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", seed=1)


@R.add("l10_paralogs_only", """
with g as (select c_custkey, c_acctbal, case when c_custkey % 5 > 0 then c_custkey // 10 end as og from customer),
f as (select *, og is not null and row_number() over (partition by og order by c_acctbal desc, c_custkey) = 1 as first from g),
r as (select c_custkey, row_number() over (order by md5('3:' || c_custkey::varchar), c_custkey) as rank, count(*) over () as n from f where not first)
select c_custkey, 'train' as train_test from f where first
union all select c_custkey, case when rank <= ceil(n / 2.0) then 'test' else 'val' end from r""")
def _(t):
    g = t.customer.select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 5 > 0, F.floor(F.col("c_custkey") / 10)).alias("og"))
    return L.paralogs_only_split(g, "c_custkey", "og", "c_acctbal", 3).select("c_custkey", "train_test")


@R.add("l13_quota_assign", """
with s as (select c_custkey, c_acctbal as train, -c_acctbal as val, c_custkey % 97 as test, count(*) over () as n from customer),
e as (select n, floor(n * 0.6 + 1e-9) as a, floor(n * 0.2 + 1e-9) as b from s limit 1),
q as (select a + (n - a - 2 * b >= 1 and n * 0.6 - a >= n * 0.2 - b - 1e-9 or n - a - 2 * b >= 3)::int as qa, b + (case when n * 0.6 - a >= n * 0.2 - b - 1e-9 then n - a - 2 * b >= 2 else n - a - 2 * b >= 1 end)::int as qt from e),
a as (select *, row_number() over (order by train desc, c_custkey) as r from s),
b as (select *, row_number() over (order by test desc, c_custkey) as r2 from a where r > (select qa from q))
select c_custkey, 'train' as train_test from a where r <= (select qa from q)
union all select c_custkey, case when r2 <= (select qt from q) then 'test' else 'val' end from b""")
def _(t):
    s = t.customer.select("c_custkey", F.col("c_acctbal").alias("train"), (-F.col("c_acctbal")).alias("val"), (F.col("c_custkey") % 97).alias("test"))
    return L.quota_assign(s, "c_custkey").select("c_custkey", "train_test")


@R.add("l14_cv_folds", """
with recursive f as (select c_nationkey, count(*) as size, row_number() over (order by count(*) desc, c_nationkey) as i from customer group by 1),
g as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as load, -1 as c_nationkey, 0::bigint as size, 0 as cv
  union all select f.i, list_transform(g.load, lambda v, j: case when j = list_position(g.load, list_min(g.load)) then v + f.size else v end), f.c_nationkey, f.size, list_position(g.load, list_min(g.load))::int - 1
  from g join f on f.i = g.i + 1)
select c_nationkey, size, cv from g where i > 0""")
def _(t):
    return L.cv_folds(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("size")), "c_nationkey", "size", 5)


@R.add("l14_leave_one_out", """
select c_custkey, cv, round, case when cv is null then 'zsv' when cv = round then 'test' when cv = (round + 1) % 5 then 'val' else 'train' end as train_test
from (select c_custkey, case when c_custkey % 11 > 0 then (c_custkey % 5)::int end as cv from customer), (select unnest([0, 1, 2, 3, 4]) as round)""")
def _(t):
    return L.leave_one_out(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, (F.col("c_custkey") % 5).cast("int")).alias("cv")), 5)


_LABELS = "case when l_linenumber = 7 then 'Zero-Shot' when l_linenumber = 6 then 'validation' when l_linenumber = 5 then 'TEST' when l_linenumber = 4 then 'odd' else 'train' end"


def _labels():
    n = F.col("l_linenumber")
    return F.when(n == 7, "Zero-Shot").when(n == 6, "validation").when(n == 5, "TEST").when(n == 4, "odd").otherwise("train")


@R.add("a08_role_counts", "select count_if(l_linenumber < 4 or l_linenumber > 7) as n_train, count_if(l_linenumber = 6) as n_val, count_if(l_linenumber = 5) as n_test, count_if(l_linenumber = 7) as n_zsv, count_if(l_linenumber = 4) as n_other from lineitem")
def _(t):
    return L.role_counts(t.lineitem.select(_labels().alias("train_test")))


@R.add("a09_role_fractions", "select count_if(l_linenumber < 4 or l_linenumber > 7) / n as p_train, count_if(l_linenumber = 6) / n as p_val, count_if(l_linenumber = 5) / n as p_test from lineitem, (select count_if(l_linenumber not in (4, 7)) as n from lineitem) group by n")
def _(t):
    return A.role_fractions(t.lineitem.select(_labels().alias("train_test")))


@R.add("l15_aligned", """
with c as (select count_if(l_linenumber < 4 or l_linenumber > 7) as n_train, count_if(l_linenumber = 6) as n_val, count_if(l_linenumber = 5) as n_test, count_if(l_linenumber = 7) as n_zsv, count_if(l_linenumber = 4) as n_other from lineitem),
d as (select *, greatest(abs(n_train / (n_train + n_val + n_test) - 0.6), abs(n_val / (n_train + n_val + n_test) - 0.2), abs(n_test / (n_train + n_val + n_test) - 0.2)) as deviation from c)
select *, deviation <= 0.05 as aligned from d""")
def _(t):
    return L.aligned(t.lineitem.select(_labels().alias("train_test")))


@R.add("l15_swap_labels", "select c_custkey, case when c_custkey % 5 = 0 then 'val' when c_custkey % 5 = 1 then 'test' else 'train' end as train_test from customer")
def _(t):
    k = F.col("c_custkey") % 5
    return L.swap_labels(t.customer.select("c_custkey", F.when(k == 0, "val").when(k == 1, "train").otherwise("test").alias("train_test")))


@R.add("w05_l16_rule_folds", """
select c_custkey, coalesce(case when c_mktsegment = 'BUILDING' and c_nationkey = 3 then 'zsv' when c_nationkey = 3 then 'zsv' when c_mktsegment = 'BUILDING' then '2' end, '0') as fold from customer""")
def _(t):
    rules = t.spark.createDataFrame([("BUILDING", "c_mktsegment", "1", 0), ("BUILDING", "c_mktsegment", "2", 1), ("3", "c_nationkey", "zero-shot", 2)], "identificator string, column string, fold string, rule_no int")
    return L.rule_folds(t.customer, "c_custkey", rules, ["c_mktsegment", "c_nationkey"])


@R.add("l17_adversarial_labels", "select c_custkey, case c_custkey % 4 when 0 then 0.0 when 1 then 1.0 when 2 then 2.0 else c_acctbal end as target from customer")
def _(t):
    old = t.customer.select("c_custkey", F.element_at(F.array(*map(F.lit, ("train", "validation", "Test", "zsv"))), (F.col("c_custkey") % 4 + 1).cast("int")).alias("train_test"))
    return L.adversarial_labels(t.customer.select("c_custkey", F.col("c_acctbal").alias("target")), "c_custkey", old, "target")


@R.add("u05_group_integrity", "select l_orderkey, count(distinct l_returnflag) as n_roles, count(*) as n_rows from lineitem group by 1 having count(distinct l_returnflag) > 1")
def _(t):
    return L.group_integrity(t.lineitem, "l_orderkey", "l_returnflag")


_SPLIT = f"(select c_custkey, c_nationkey, {_ROLE} as train_test from {_ranked('customer', 'c_custkey', 7)})"


@R.add("a10_group_imbalance", f"""
with s as {_SPLIT}, p as (select avg((train_test = 'train')::int) as p_train, avg((train_test = 'val')::int) as p_val, avg((train_test = 'test')::int) as p_test from s)
select c_nationkey, count(*) as n, count_if(train_test = 'train') as n_train, count_if(train_test = 'val') as n_val, count_if(train_test = 'test') as n_test,
  sqrt(pow(count_if(train_test = 'train') - count(*) * any_value(p_train), 2) + pow(count_if(train_test = 'val') - count(*) * any_value(p_val), 2) + pow(count_if(train_test = 'test') - count(*) * any_value(p_test), 2)) as sd
from s, p group by 1""")
def _(t):
    return A.group_imbalance(L.random_split(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", 7), "c_nationkey")


@R.add("a25_dispersion", f"""
with s as {_SPLIT}, p as (select avg((train_test = 'train')::int) as p_train, avg((train_test = 'val')::int) as p_val, avg((train_test = 'test')::int) as p_test from s),
g as (select count(*) as n, sqrt(pow(count_if(train_test = 'train') - count(*) * any_value(p_train), 2) + pow(count_if(train_test = 'val') - count(*) * any_value(p_val), 2) + pow(count_if(train_test = 'test') - count(*) * any_value(p_test), 2)) as sd from s, p group by c_nationkey),
q as (select quantile_cont(sd / sqrt(n), 0.1) as lo, quantile_cont(sd / sqrt(n), 0.9) as hi from g)
select avg(sd) as mean, sum(sd * sqrt(n)) / sum(sqrt(n)) as weighted, avg(greatest(least(sd / sqrt(n), hi), lo)) as robust, avg(log10(greatest(sd, 1e-6))) as log_balance from g, q""")
def _(t):
    return A.dispersion(A.group_imbalance(L.random_split(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", 7), "c_nationkey"))


_EDGES = "(select distinct least(l_orderkey % 977, l_suppkey + 2000) as u, greatest(l_orderkey % 977, l_suppkey + 2000) as v from lineitem where l_quantity >= 49.5)"


def edges(t):
    x = t.lineitem.where("l_quantity >= 49.5").select((F.col("l_orderkey") % 977).alias("a"), (F.col("l_suppkey") + 2000).alias("b"))
    return x.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


_COMPONENTS = f"""with recursive e as {_EDGES}, b as (select u, v from e union select v, u from e),
reach as (select u as node, u as low from b union select b.v, r.low from reach r join b on b.u = r.node and r.low < b.v),
c as (select node, min(low) as component from reach group by 1)"""


@R.add("g01_components", f"{_COMPONENTS} select node, component from c")
def _(t):
    return connected_components(edges(t))


@R.add("g08_graph_statistics", f"""{_COMPONENTS}, z as (select component, count(*) as n from c group by 1)
select (select count(*) from e) as n_edges, (select count(*) from c) as n_nodes, count(*) as n_components, max(n) as largest, list(n order by n desc)[count(*) // 2 + 1] as median_size, count_if(n = 1) as n_singletons from z""")
def _(t):
    from ..operators.graphs import statistics

    return statistics(edges(t))


@R.add("a14_degrees", f"with e as {_EDGES} select node, count(*) as degree from (select u as node from e union all select v from e) group by 1")
def _(t):
    from ..operators.graphs import degrees

    return degrees(edges(t))


@R.add("g09_weights", "select l_suppkey, n, ln(1 + n) / max(ln(1 + n)) over () as weight from (select l_suppkey, count(*) as n from lineitem group by 1)")
def _(t):
    from ..operators.graphs import normalised_weights

    return normalised_weights(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")), "n")


@R.add("k06_structural_features", f"""
with e as {_EDGES}, b as (select u, v from e union all select v, u from e), d as (select u as node, count(*) as degree from b group by 1)
select node, degree, ln(1 + degree) as log_degree from d""")
def _(t):
    from ..operators.features import structural_features

    return structural_features(edges(t)).select("node", "degree", "log_degree")


#: All of lineitem: an order's node is even, a supplier's odd.
_ALL_EDGES = "(select distinct least(l_orderkey * 2, l_suppkey * 2 + 1) as u, greatest(l_orderkey * 2, l_suppkey * 2 + 1) as v from lineitem)"


def all_edges(t):
    x = t.lineitem.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    return x.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


# without SQL, which would have to recurse over whole tables; tests hold both against brute force
@R.add("g01_components_whole")
def _(t):
    return connected_components(all_edges(t))


@R.add("g08_graph_statistics_whole")
def _(t):
    from ..operators.graphs import statistics

    return statistics(all_edges(t))


@R.add("a14_degrees_whole", f"with e as {_ALL_EDGES} select node, count(*) as degree from (select u as node from e union all select v from e) group by 1")
def _(t):
    from ..operators.graphs import degrees

    return degrees(all_edges(t))


@R.add("k06_structural_features_whole", f"""
with e as {_ALL_EDGES}, b as (select u, v from e union all select v, u from e), d as (select u as node, count(*) as degree from b group by 1)
select node, degree, ln(1 + degree) as log_degree from d""")
def _(t):
    from ..operators.features import structural_features

    return structural_features(all_edges(t)).select("node", "degree", "log_degree")


@R.add("u04_edges_distinct", "select distinct least(s_nationkey, c_nationkey) as u, greatest(s_nationkey, c_nationkey) as v from (select distinct s_nationkey from supplier), (select distinct c_nationkey from customer) where s_nationkey <> c_nationkey and (s_nationkey + c_nationkey) % 3 = 0")
def _(t):
    from ..operators.graphs import undirected

    s, c = t.supplier.select("s_nationkey").distinct(), t.customer.select("c_nationkey").distinct()
    return undirected(s.join(c, (F.col("s_nationkey") != F.col("c_nationkey")) & ((F.col("s_nationkey") + F.col("c_nationkey")) % 3 == 0)), "s_nationkey", "c_nationkey")


@R.add("u04_edges_distinct_whole", "select distinct least(s_nationkey, c_nationkey) as u, greatest(s_nationkey, c_nationkey) as v from (select distinct s_nationkey from supplier), (select distinct c_nationkey from customer) where s_nationkey <> c_nationkey")
def _(t):
    from ..operators.graphs import undirected

    s, c = t.supplier.select("s_nationkey").distinct(), t.customer.select("c_nationkey").distinct()
    return undirected(s.join(c, F.col("s_nationkey") != F.col("c_nationkey")), "s_nationkey", "c_nationkey")


_KMER_SET = """with s as (select s_suppkey as region, translate(lpad(s_suppkey::varchar, 6, '0') || lpad((s_suppkey * 7 % 1000)::varchar, 6, '3'), '0123456789', 'ACGTACGTAC') as seq from supplier),
k as (select distinct region, substr(seq, i, 6) as kmer from s, (select unnest(range(1, 8)) as i))"""


def regions(t):
    k = F.col("s_suppkey")
    raw = F.concat(F.lpad(k.cast("string"), 6, "0"), F.lpad((k * 7 % 1000).cast("string"), 6, "3"))
    return t.supplier.select(k.alias("region"), F.translate(raw, "0123456789", "ACGTACGTAC").alias("seq"))


@R.add("a16_document_frequency", f"{_KMER_SET} select kmer, count(*) as df from k group by 1 having count(*) >= 2")
def _(t):
    from ..operators.graphs import document_frequency, kmer_sets

    return document_frequency(kmer_sets(regions(t), "region", "seq", 6), 2)


@R.add("a17_cooccurrence", f"{_KMER_SET} select a.kmer as a, b.kmer as b, count(*) as n from k a join k b on a.region = b.region and a.kmer < b.kmer group by 1, 2 having count(*) >= 2")
def _(t):
    from ..operators.graphs import cooccurrence, kmer_sets

    return cooccurrence(kmer_sets(regions(t), "region", "seq", 6), 2)


@R.add("g02_contingency_clusters", f"""{_KMER_SET.replace('with s', 'with recursive s')},
l as (select distinct kmer, region, min(region) over (partition by kmer) as owner from k), b as (select owner as u, region as v from l where owner <> region union select region, owner from l where owner <> region),
reach as (select region as node, region as low from s union select b.v, r.low from reach r join b on b.u = r.node and r.low < b.v)
select node as region, min(low) as cluster from reach group by 1""")
def _(t):
    from ..operators.graphs import contingency_clusters

    return contingency_clusters(regions(t), "region", "seq", 6)


@R.add("g03_majority_clusters")
def _(t):
    from ..operators.graphs import majority_clusters

    return majority_clusters(regions(t), "region", "seq", 6)


@R.add("a18_majority_vote", "select l_orderkey, l_returnflag as vote, n from (select l_orderkey, l_returnflag, count(*) as n, row_number() over (partition by l_orderkey order by count(*) desc, l_returnflag) as r from lineitem group by 1, 2) where r = 1")
def _(t):
    from ..operators.graphs import majority_vote

    return majority_vote(t.lineitem, "l_orderkey", "l_returnflag")


@R.add("flagship", f"""
with s as {_SPLIT}, p as (select avg((train_test = 'train')::int) as p_train, avg((train_test = 'val')::int) as p_val, avg((train_test = 'test')::int) as p_test from s)
select c_nationkey, count(*) as n, count_if(train_test = 'train') as n_train, count_if(train_test = 'val') as n_val, count_if(train_test = 'test') as n_test,
  sqrt(pow(count_if(train_test = 'train') - count(*) * any_value(p_train), 2) + pow(count_if(train_test = 'val') - count(*) * any_value(p_val), 2) + pow(count_if(train_test = 'test') - count(*) * any_value(p_test), 2)) as sd
from s, p group by 1""")
def _(t):
    return A.group_imbalance(L.random_split(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", 7), "c_nationkey")


@R.add("l01_sizes_by_ratio", """
select l_orderkey, n_train, n_val, n_test from (select l_orderkey, n,
  case n when 5 then 3 when 6 then 4 when 7 then 4 when 8 then 5 when 9 then 5 when 10 then 6 when 11 then 7 end as n_train,
  case n when 5 then 1 when 6 then 1 when 7 then 1 when 8 then 1 when 9 then 2 when 10 then 2 when 11 then 2 end as n_val,
  case n when 5 then 1 when 6 then 1 when 7 then 2 when 8 then 2 when 9 then 2 when 10 then 2 when 11 then 2 end as n_test
  from (select l_orderkey, least(count(*), 7) + 4 as n from lineitem group by 1))""")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg((F.least(F.count("*"), F.lit(7)) + 4).alias("n"))
    s = L.size_columns(F.col("n"), L.Ratios())
    return n.select("l_orderkey", *[s[r].cast("int").alias(f"n_{r}") for r in ("train", "val", "test")])


@R.add("l01_sizes_by_ratio_whole", """
select l_orderkey, n * 3 // 5 + (case when n % 5 > n * 3 % 5 then 2 else 0 end < k)::bigint as n_train,
  n // 5 + (case when n * 3 % 5 >= n % 5 then 1 else 0 end + 1 < k)::bigint as n_val, n // 5 + (case when n * 3 % 5 >= n % 5 then 1 else 0 end < k)::bigint as n_test
from (select l_orderkey, n, (n * 3 % 5 + 2 * (n % 5)) // 5 as k from (select l_orderkey, count(*) + 4 as n from lineitem group by 1))""")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg((F.count("*") + 4).alias("n"))
    s = L.size_columns(F.col("n"), L.Ratios())
    return n.select("l_orderkey", *[s[r].cast("long").alias(f"n_{r}") for r in ("train", "val", "test")])
