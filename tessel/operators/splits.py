"""Split assignment: sizes, roles and folds, with whole groups and held-out rows.

Random orders are the MD5 of ``seed:id``, so every engine gives the same split.  Shares are named arguments; their order
is never positional.  Rows of the held-out fold are taken out by the callers before anything is allocated.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import chromosome_token, fold_label, order_key
from ..storage import Stored, exchanged
from .profiles import sequential_ids

ROLES = ("train", "val", "test")
#: The order in which ``greedy_roles`` prefers roles.
_GREEDY = ("test", "train", "val")


@dataclass(frozen=True)
class Ratios:
    """Shares of train, test and val."""

    train: float = 3
    test: float = 1
    val: float = 1

    def __post_init__(self) -> None:
        if min(self.train, self.test, self.val) < 0 or self.train + self.test + self.val <= 0:
            raise ValueError("shares must not be negative, and not all zero")

    def share(self, role: str) -> float:
        return getattr(self, role) / (self.train + self.test + self.val)


#: A tenth for test, and a tenth of the rest for val.
DEFAULT_SHARES = {"test": 0.1, "val": 0.09, "train": 0.81}


def size_columns(n: Column, ratios: Ratios | None = None) -> dict[str, Column]:
    """Counts of train, val and test among ``n`` rows, which must be 3 at least.

    Without ratios test is a tenth, rounded half to even, and val a tenth of the rest, both 1 at least.  With ratios
    largest remainders decide, ties in the order train, test, val; then a role with a share but no row takes one from
    the largest.
    """
    if ratios is None:
        test = F.greatest(F.lit(1), F.bround(n * 0.1).cast("long"))
        val = F.greatest(F.lit(1), F.bround((n - test) * 0.1).cast("long"))
        return {"train": n - test - val, "val": val, "test": test}
    order = ("train", "test", "val")
    exact = {r: n * F.lit(ratios.share(r)) for r in order}
    whole = {r: F.floor(exact[r] + 1e-9).cast("long") for r in order}
    left = n - sum(whole.values())
    rest = {r: F.greatest(exact[r] - whole[r], F.lit(0.0)) for r in order}
    place = {r: sum((F.when((rest[o] > rest[r] + 1e-9) | ((F.abs(rest[o] - rest[r]) <= 1e-9) & F.lit(order.index(o) < order.index(r))), 1).otherwise(0) for o in order if o != r), F.lit(0)) for r in order}
    got = {r: whole[r] + F.when(place[r] < left, 1).otherwise(0) for r in order}
    empty = {r: F.when((got[r] == 0) & F.lit(ratios.share(r) > 0), 1).otherwise(0) for r in order}
    lacking = sum(empty.values())
    most = F.greatest(*got.values())
    largest = F.when(got["train"] == most, "train").when(got["test"] == most, "test").otherwise("val")
    return {r: got[r] + empty[r] - F.when(largest == r, lacking).otherwise(0) for r in ROLES}


def _role(rank: Column, sizes: dict[str, Column]) -> Column:
    """Role by rank from 1: train first, then val, then test."""
    return F.when(rank <= sizes["train"], "train").when(rank <= sizes["train"] + sizes["val"], "val").otherwise("test")


def ranked(rows: DataFrame, key: str, seed: int | str, by: list[str] | None = None, name: str = "rank", total: str = "n", buckets: int = 64) -> DataFrame:
    """Rank from 1 in the reproducible random order, within groups, and the groups' sizes.

    The order's first hexadecimal digits deal every group out to buckets, which keep the order among themselves; so a
    group of any size is sorted in parts, and a bucket's first rank is a sum over the buckets' counts.
    """
    by = by or []
    keyed = rows.withColumn("__key", order_key(F.col(key), seed))
    keyed = keyed.withColumn("__bucket", F.floor(F.conv(F.substring("__key", 1, 4), 16, 10).cast("long") * buckets / 65536))
    counts = keyed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__bucket")
    whole = Window.partitionBy(*by)
    base = counts.select(*by, "__bucket", (F.sum("__n").over(upto) - F.col("__n")).alias("__base"), F.sum("__n").over(whole).alias(total))
    inner = Window.partitionBy(*by, "__bucket").orderBy("__key", key)
    placed = keyed.withColumn("__at", F.row_number().over(inner))
    same = [placed[c].eqNullSafe(base[c]) for c in [*by, "__bucket"]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return placed.join(base, cond).select(*[placed[c] for c in rows.columns], (F.col("__at") + F.col("__base")).alias(name), F.col(total))


def random_split(rows: DataFrame, key: str, seed: int = 0, ratios: Ratios | None = None) -> DataFrame:
    """``rows`` with ``train_test``; fewer than three rows are an error."""
    out = ranked(rows, key, seed)
    n = F.when(F.col("n") < 3, F.raise_error(F.lit("a split needs three rows")).cast("long")).otherwise(F.col("n"))
    return out.withColumn("train_test", _role(F.col("rank"), size_columns(n, ratios))).drop("rank", "n")


def stratified_split(rows: DataFrame, key: str, strata: list[str], seed: int = 0, ratios: Ratios | None = None) -> DataFrame:
    """The same within each composite stratum; a stratum of fewer than three rows is an error."""
    out = ranked(rows, key, seed, strata)
    n = F.when(F.col("n") < 3, F.raise_error(F.lit("a stratum needs three rows")).cast("long")).otherwise(F.col("n"))
    return out.withColumn("train_test", _role(F.col("rank"), size_columns(n, ratios))).drop("rank", "n")


def two_level_split(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A random split, and a second one stratified by it, with the first as class: train 0, val 1, test 2."""
    first = random_split(rows, key, seed).withColumnRenamed("train_test", "m1")
    second = stratified_split(first, key, ["m1"], seed + 1).withColumnRenamed("train_test", "m2")
    return second.withColumn("class", F.when(F.col("m1") == "train", 0).when(F.col("m1") == "val", 1).otherwise(2))


def _dealt(sizes: Iterable[int], ratios: Ratios) -> Iterator[int]:
    """For each size in turn the place in ``_GREEDY`` of the role that it goes to."""
    have, total = [0, 0, 0], 0
    a, b, c = (ratios.share(o) for o in _GREEDY)
    for n in sizes:
        total += n
        t, (x, y, z) = max(total, 1), have
        x0, y0, z0 = abs(x / t - a), abs(y / t - b), abs(z / t - c)
        cost = (sum((abs((x + n) / t - a), y0, z0)), sum((x0, abs((y + n) / t - b), z0)), sum((x0, y0, abs((z + n) / t - c))))
        most = min(cost) + 1e-12
        pick = 0 if cost[0] <= most else 1 if cost[1] <= most else 2
        have[pick] += n
        yield pick


def greedy_roles(folds: DataFrame, fold: str, size: str, ratios: Ratios | None = None, most_folds: int = 10_000) -> DataFrame:
    """(fold, size, train_test): largest fold first, each to the role after which the shares of what has been dealt out are
    nearest to the wanted ones (sum of absolute differences); of equal ones the least name, test before train before val.

    Fewer than three folds are train and val in the order of their names.  The rule is sequential but asks for sizes only:
    up to ``most_folds`` folds are dealt out on the driver.  Of more, one task goes through the distinct sizes and how many
    folds have each, and folds get the roles by their place in the order.
    """
    r = ratios or Ratios()
    given = folds.select(F.col(fold), F.col(size).cast("long").alias(size))
    rows = given.limit(most_folds + 1).collect()
    if len(rows) <= most_folds:
        if len(rows) < 3:
            out = [(f, n, o) for (f, n), o in zip(sorted((r[0], r[1]) for r in rows), ("train", "val"), strict=False)]
        else:
            rows = given.orderBy(F.desc(size), fold).collect()
            out = [(f, n, _GREEDY[k]) for (f, n), k in zip(rows, _dealt((n for _, n in rows), r), strict=True)]
        kind = folds.schema[fold].dataType.simpleString()
        return folds.sparkSession.createDataFrame(out, f"`{fold}` {kind}, `{size}` long, train_test string")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = itertools.chain.from_iterable(itertools.repeat(n, k) for b in batches for n, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        picks, at = _dealt(sizes, r), 1
        while len(part := np.fromiter(itertools.islice(picks, 50_000), np.int8)):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["__at", "__role"])
            at += len(part)

    store = Stored(folds.sparkSession, "greedy")
    given = store.put(given, "folds")
    # a row per distinct size, of which there are at most the root of twice as many as members
    counts = given.groupBy(F.col(size).alias("s")).agg(F.count("*").alias("k")).repartition(1).sortWithinPartitions(F.desc("s"))
    roles = store.put(counts.mapInArrow(deal, "__at long, __role byte"), "roles")
    placed = sequential_ids(given.withColumn("__down", -F.col(size)), ["__down", fold], "__at").join(exchanged(roles), "__at")
    return placed.select(fold, size, F.element_at(F.array(*map(F.lit, _GREEDY)), (F.col("__role") + 1).cast("int")).alias("train_test"))


def shuffled_roles(folds: DataFrame, fold: str, seed: int = 0, ratios: Ratios | None = None) -> DataFrame:
    """Roles by number of folds in random order; fewer than three folds go train, val, test in turn."""
    out = ranked(folds, fold, seed)
    cyclic = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("rank") - 1) % 3 + 1).cast("int"))
    sized = _role(F.col("rank"), size_columns(F.greatest(F.col("n"), F.lit(3)), ratios))
    return out.withColumn("train_test", F.when(F.col("n") < 3, cyclic).otherwise(sized)).drop("rank", "n")


def assignment(members: DataFrame, region: str, cluster: str, roles: DataFrame, additional: list[str] | None = None) -> DataFrame:
    """(region, cluster, train_test, fold, additional) from members of clusters and the clusters' roles."""
    extra = F.to_json(F.struct(*sorted(additional))) if additional else F.lit("{}")
    joined = members.join(roles.select(F.col(cluster).alias("__cluster"), "train_test"), F.col(cluster) == F.col("__cluster"))
    return joined.select(F.col(region).alias("region"), F.col(cluster).alias("cluster"), "train_test", F.col(cluster).cast("string").alias("fold"), extra.alias("additional"))


def chromosome_split(ids: DataFrame, genome: str, chrom: str, seed: int = 0, ratios: Ratios | None = None) -> DataFrame:
    """(fold, token, train_test): folds are genome|chromosome, stratified by the chromosome's token.

    Contigs without a token get an ordinal per genome.  Strata of fewer than three folds are pooled; a pool of fewer than
    three goes train, val, test in turn.
    """
    pairs = ids.select(F.col(genome).alias("genome"), F.col(chrom).alias("chrom")).distinct()
    named = pairs.withColumn("token", chromosome_token(F.col("chrom")))
    ordinals = named.where("token is null").withColumn("__no", F.dense_rank().over(Window.partitionBy("genome").orderBy("chrom")))
    folds = named.where("token is not null").unionByName(ordinals.select("genome", "chrom", F.col("__no").cast("string").alias("token")))
    folds = folds.select(F.concat_ws("|", "genome", "chrom").alias("fold"), "token")
    sized = folds.withColumn("__n", F.count("*").over(Window.partitionBy("token")))
    sized = sized.withColumn("stratum", F.when(F.col("__n") >= 3, F.col("token")).otherwise(F.lit("(pooled)")))
    out = ranked(sized.drop("__n"), "fold", seed, ["stratum"])
    cyclic = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("rank") - 1) % 3 + 1).cast("int"))
    role = F.when(F.col("n") < 3, cyclic).otherwise(_role(F.col("rank"), size_columns(F.greatest(F.col("n"), F.lit(3)), ratios)))
    return out.select("fold", "token", role.alias("train_test"))


def take_groups(groups: DataFrame, group: str, size: str, share: float, seed: int = 0) -> DataFrame:
    """``groups`` with ``taken``: whole groups in random order while what is taken is below the share of the total."""
    order = Window.orderBy("__key", group).rowsBetween(Window.unboundedPreceding, -1)
    keyed = groups.withColumn("__key", order_key(F.col(group), seed))
    total = groups.agg(F.sum(size).alias("__total"))
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    return keyed.withColumn("__before", before).crossJoin(F.broadcast(total)).withColumn("taken", F.col("__before") < F.col("__total") * share).drop("__key", "__before", "__total")


def orthogonal_split(members: DataFrame, key: str, group: str, p_test: float = 0.1, val_share: float = 0.1, seed: int = 0) -> DataFrame:
    """Whole groups to test up to its share; a tenth of the other rows, by row, to val.

    The rows' carving can leave a group in both train and val, as in the procedure that this follows.
    """
    groups = members.groupBy(group).agg(F.count("*").alias("__size"))
    taken = take_groups(groups, group, "__size", p_test, seed).select(F.col(group).alias("__group"), "taken")
    joined = members.join(taken, F.col(group) == F.col("__group")).drop("__group")
    pool = ranked(joined.where("not taken"), key, seed + 1)
    val = F.greatest(F.lit(1), F.bround(F.col("n") * val_share).cast("long"))
    rest = pool.withColumn("train_test", F.when(F.col("rank") <= val, "val").otherwise("train")).drop("rank", "n", "taken")
    return joined.where("taken").drop("taken").withColumn("train_test", F.lit("test")).unionByName(rest)


def paralogs_only_split(genes: DataFrame, gene: str, orthogroup: str, degree: str, seed: int = 0) -> DataFrame:
    """One train gene per orthogroup, that of the greatest paralog degree, then least name; the others half to test, half to val.

    Genes without an orthogroup are never train.
    """
    best = Window.partitionBy(orthogroup).orderBy(F.desc(degree), gene)
    first = genes.withColumn("__first", F.col(orthogroup).isNotNull() & (F.row_number().over(best) == 1))
    rest = ranked(first.where("not __first").drop("__first"), gene, seed)
    halves = rest.withColumn("train_test", F.when(F.col("rank") <= F.ceil(F.col("n") / 2), "test").otherwise("val")).drop("rank", "n")
    return first.where("__first").drop("__first").withColumn("train_test", F.lit("train")).unionByName(halves)


#: The order in which roles of equal quotas are filled.
FILL_ORDER = ("train", "test", "val")


def quotas(n: int, ratios: Ratios | None = None) -> dict[str, int]:
    """Rows per role by largest remainders; a role without any takes one from the largest."""
    r = ratios or Ratios()
    exact = {o: n * r.share(o) for o in FILL_ORDER}
    out = {o: int(exact[o] + 1e-9) for o in FILL_ORDER}
    for o in sorted(FILL_ORDER, key=lambda o: (-round(exact[o] - out[o], 9), FILL_ORDER.index(o)))[: n - sum(out.values())]:
        out[o] += 1
    for o in FILL_ORDER:
        if not out[o]:
            rich = max(FILL_ORDER, key=lambda p: (out[p], -FILL_ORDER.index(p)))
            if out[rich] <= 1:
                raise ValueError(f"{n} rows are too few for three roles")
            out[rich] -= 1
            out[o] = 1
    return out


def _greatest(rows: DataFrame, by: str, key: str, n: int, cells: int = 4096) -> DataFrame:
    """``rows`` with ``__top``: whether a row is among the ``n`` of greatest ``by``, ties by ``key``.

    The cut is found by counts: ranges of the value that hold it are narrowed until one holds few rows, and only these are
    ordered, so no task sorts the table.
    """
    v, low, high, above = F.col(by).cast("double"), float("-inf"), float("inf"), 0
    while True:
        part = rows.where((v > low) & (v <= high)) if low > float("-inf") else rows.where(v <= high)
        s = part.agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).head()
        if not s.n or s.n <= 100_000 or s.lo == s.hi:
            break
        width = (s.hi - s.lo) / cells
        cell = F.least(F.lit(cells - 1), F.floor((v - s.lo) / width))
        found = None
        for r in sorted(part.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect(), key=lambda r: -r.c):
            if above + r.n >= n:
                found = r
                break
            above += r.n
        if found is None or (found.lo, found.hi) == (s.lo, s.hi):
            break
        low, high = float(np.nextafter(found.lo, -np.inf)), found.hi
    edge = part.orderBy(F.desc(by), key).limit(max(n - above, 0)).select(F.col(key).alias("__edge"))
    marked = rows.join(edge, F.col(key) == F.col("__edge"), "left")
    return marked.withColumn("__top", (v > high) | F.col("__edge").isNotNull()).drop("__edge")


def quota_assign(scores: DataFrame, key: str, ratios: Ratios | None = None) -> DataFrame:
    """``scores`` (key, train, val, test) with ``train_test``: roles fill their quotas by score, the largest first, equal ones in the order of ``FILL_ORDER``."""
    quota = quotas(scores.count(), ratios)
    left, out = scores, None
    order = sorted(FILL_ORDER, key=lambda o: (-quota[o], FILL_ORDER.index(o)))
    for o in order[:-1]:
        marked = _greatest(left, o, key, quota[o])
        part = marked.where("__top").drop("__top").withColumn("train_test", F.lit(o))
        out = part if out is None else out.unionByName(part)
        left = marked.where("not __top").drop("__top")
    return out.unionByName(left.withColumn("train_test", F.lit(order[-1])))


def cv_folds(clusters: DataFrame, cluster: str, size: str, n: int) -> DataFrame:
    """(cluster, size, cv): largest first into the least loaded of ``n`` folds, the first of equals."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(size)).cast("long").alias("minus"), F.col(cluster).alias("cluster"))))
    kind = clusters.schema[cluster].dataType.simpleString()

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(a["load"], F.array_min(a["load"])).cast("int")
        load = F.transform(a["load"], lambda v, i: F.when(i + 1 == at, v - x["minus"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(a["done"], F.array(F.struct(x["cluster"].alias("cluster"), (-x["minus"]).alias("size"), (at - 1).alias("cv")))).alias("done"))

    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), n).alias("load"), F.array().cast(f"array<struct<cluster:{kind},size:bigint,cv:int>>").alias("done"))
    out = clusters.agg(items.alias("items")).select(F.inline(F.aggregate("items", begin, step, lambda a: a["done"])))
    return out.select(F.col("cluster").alias(cluster), F.col("size").alias(size), "cv")


def leave_one_out(folds: DataFrame, n: int, cv: str = "cv") -> DataFrame:
    """Each row once per round: the round's fold is test, the next one val, the rest train; null folds stay held out."""
    rounds = folds.sparkSession.range(n).select(F.col("id").cast("int").alias("round"))
    role = F.when(F.col(cv).isNull(), "zsv").when(F.col(cv) == F.col("round"), "test").when(F.col(cv) == (F.col("round") + 1) % n, "val").otherwise("train")
    return folds.crossJoin(F.broadcast(rounds)).withColumn("train_test", role)


def role_counts(rows: DataFrame, role: str = "train_test") -> DataFrame:
    """One row: n_train, n_val, n_test, n_zsv, n_other, after the labels' spellings are made one."""
    label = fold_label(F.col(role))
    known = (*ROLES, "zsv")
    return rows.agg(*[F.count_if(label == k).alias(f"n_{k}") for k in known], F.count_if(~F.coalesce(label.isin(*known), F.lit(False))).alias("n_other"))


def aligned(rows: DataFrame, role: str = "train_test", ratios: Ratios | None = None, tolerance: float = 0.05) -> DataFrame:
    """One row: whether the shares of the roles, without held-out rows, are within the tolerance of the ratios."""
    r = ratios or Ratios()
    counts = role_counts(rows, role)
    total = F.col("n_train") + F.col("n_val") + F.col("n_test")
    far = F.greatest(*[F.abs(F.col(f"n_{o}") / total - r.share(o)) for o in ROLES])
    return counts.select("*", far.alias("deviation"), (far <= tolerance).alias("aligned"))


def swap_labels(rows: DataFrame, role: str = "train_test", ratios: Ratios | None = None, tolerance: float = 0.05) -> DataFrame:
    """``rows`` with the roles renamed by that one exchange of labels, or none, that comes nearest to the ratios.

    If even that is further off than the tolerance the roles stay as they are.
    """
    r = ratios or Ratios()
    c = role_counts(rows, role).head()
    n = {o: c[f"n_{o}"] for o in ROLES}
    total = max(sum(n.values()), 1)
    swaps = [{o: o for o in ROLES}] + [{a: b, b: a, **{o: o for o in ROLES if o not in (a, b)}} for a, b in (("train", "test"), ("train", "val"), ("test", "val"))]
    far = [max(abs(n[o] / total - r.share(m[o])) for o in ROLES) for m in swaps]
    best = swaps[far.index(min(far))] if min(far) <= tolerance else swaps[0]
    out = F.col(role)
    for a, b in best.items():
        out = F.when(F.col(role) == a, b).otherwise(out)
    return rows.withColumn(role, out)


def rule_folds(ids: DataFrame, key: str, rules: DataFrame, columns: list[str], default: str = "0") -> DataFrame:
    """(key, fold): of the rules (identificator, column, fold, rule_no) that match a row the last one counts."""
    long = ids.select(F.col(key).alias("__key"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    hits = long.join(rules, (F.col("x.column") == rules["column"]) & (F.col("x.value") == rules["identificator"]))
    last = hits.groupBy("__key").agg(F.max_by("fold", "rule_no").alias("__fold"))
    return ids.select(key).join(last, F.col(key) == F.col("__key"), "left").select(key, F.coalesce(fold_label(F.col("__fold")), F.lit(default)).alias("fold"))


def adversarial_labels(split: DataFrame, key: str, previous: DataFrame, value: str, role: str = "train_test") -> DataFrame:
    """``split`` with the previous split's role as class, train 0, val 1, test 2; rows without one keep their value."""
    old = previous.select(F.col(key).alias("__key"), fold_label(F.col(role)).alias("__old"))
    code = F.when(F.col("__old") == "train", 0.0).when(F.col("__old") == "val", 1.0).when(F.col("__old") == "test", 2.0)
    return split.join(old, F.col(key) == F.col("__key"), "left").withColumn(value, F.coalesce(code, F.col(value))).drop("__key", "__old")


def group_integrity(rows: DataFrame, group: str, role: str = "train_test") -> DataFrame:
    """Groups that are in two roles or more: group, n_roles, n_rows."""
    return rows.groupBy(group).agg(F.count_distinct(role).alias("n_roles"), F.count("*").alias("n_rows")).where("n_roles > 1")
