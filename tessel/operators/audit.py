"""Audits of a split: how evenly groups are dealt out, and how near test rows are to train rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import fold_label
from .splits import ROLES


def role_fractions(rows: DataFrame, role: str = "train_test") -> DataFrame:
    """One row: shares of train, val and test among the rows with one of these roles; without any it is an error."""
    label = fold_label(F.col(role))
    n = {r: F.count_if(label == r) for r in ROLES}
    total = sum(n.values())
    safe = F.when(total == 0, F.raise_error(F.lit("no row has a role")).cast("long")).otherwise(total)
    return rows.agg(*[(n[r] / safe).alias(f"p_{r}") for r in ROLES])


def group_imbalance(rows: DataFrame, group: str, role: str = "train_test", least: int = 1) -> DataFrame:
    """Per group: n, n_train, n_val, n_test, and the distance ``sd`` of these from what the whole table's shares lead to expect.

    Held-out rows and those without a group do not count.  Groups of fewer than ``least`` rows are left out.
    """
    label = fold_label(F.col(role))
    used = rows.withColumn("__role", label).where(F.col("__role").isin(*ROLES) & F.col(group).isNotNull())
    shares = role_fractions(used, "__role")
    per = used.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(F.col("__role") == r).alias(f"n_{r}") for r in ROLES]).where(F.col("n") >= least)
    far = sum(((F.col(f"n_{r}") - F.col("n") * F.col(f"p_{r}")) ** 2 for r in ROLES), F.lit(0.0))
    return per.crossJoin(F.broadcast(shares)).withColumn("sd", F.sqrt(far)).drop(*[f"p_{r}" for r in ROLES])


def dispersion(groups: DataFrame, power: float = 0.5, floor: float = 1e-6, least: int = 8) -> DataFrame:
    """One row over group imbalances: mean, weighted by n**power, robust, log_balance.

    ``robust`` is the mean of sd / sqrt(n), from 8 groups on cut at its 10th and 90th percentile.
    """
    unit = groups.withColumn("__u", F.col("sd") / F.sqrt("n"))
    cuts = unit.agg(F.percentile("__u", 0.1).alias("__lo"), F.percentile("__u", 0.9).alias("__hi"), F.count("*").alias("__k"))
    joined = unit.crossJoin(F.broadcast(cuts))
    cut = F.when(F.col("__k") >= least, F.greatest(F.least("__u", "__hi"), "__lo")).otherwise(F.col("__u"))
    w = F.pow(F.col("n").cast("double"), F.lit(power))
    return joined.agg(F.avg("sd").alias("mean"), (F.sum(F.col("sd") * w) / F.sum(w)).alias("weighted"), F.avg(cut).alias("robust"), F.avg(F.log10(F.greatest(F.col("sd"), F.lit(floor)))).alias("log_balance"))


def score_summary(scores: DataFrame, score: str, tau: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """n, mean, median, p90, p99 and the share at ``tau`` or above."""
    s = F.col(score)
    return scores.groupBy(*(by or [])).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), F.percentile(s, 0.9).alias("p90"), F.percentile(s, 0.99).alias("p99"), F.avg((s >= tau).cast("double")).alias("p_tau"))


def exceedance(scores: DataFrame, score: str, points: int = 101, by: list[str] | None = None) -> DataFrame:
    """(tau, share): the share of scores at tau or above, for a grid from 0 to 1.

    Each score is counted once, at the last grid point that it reaches; the shares are running sums over the grid.
    """
    by = by or []
    step = points - 1
    cell = F.least(F.lit(step), F.floor(F.col(score) * step + 1e-9)).cast("int")
    counted = scores.where(F.col(score).isNotNull()).groupBy(*by, cell.alias("__cell")).agg(F.count("*").alias("__n"))
    groups = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    grid = scores.sparkSession.range(points).select(F.col("id").cast("int").alias("__cell"))
    frame = groups.crossJoin(F.broadcast(grid))
    below = counted.where("__cell >= 0")
    joined = frame.join(below, [*by, "__cell"], "left")
    from_top = Window.partitionBy(*by).orderBy(F.desc("__cell"))
    return joined.select(*by, (F.col("__cell") / step).alias("tau"), (F.coalesce(F.sum("__n").over(from_top), F.lit(0)) / F.col("__total")).alias("share"))


def area(curve: DataFrame, x: str = "tau", y: str = "share", by: list[str] | None = None) -> DataFrame:
    """Area under a curve by trapezoids."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(x)
    part = curve.withColumn("__a", (F.lead(x).over(order) - F.col(x)) * (F.lead(y).over(order) + F.col(y)) / 2)
    return part.groupBy(*by).agg(F.sum("__a").alias("auc"))


def ranking(rows: DataFrame, by: list[str], median: str = "median", auc: str = "auc", key: str = "run") -> DataFrame:
    """``rows`` with ``rank``: by median, then area, falling, then key; undefined values last."""
    def last(c: str) -> Column:
        return F.when(F.isnan(c) | F.col(c).isNull(), float("-inf")).otherwise(F.col(c))

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(last(median)), F.desc(last(auc)), key)))


def stratum_summary(members: DataFrame, fold: str, numeric: list[str], categorical: list[str], order: str) -> DataFrame:
    """Per fold one text: sums of numeric columns, modes of the others (ties: seen first by ``order``), joined by ``||``."""
    parts = members.groupBy(fold).agg(*[F.sum(c).alias(c) for c in numeric], *[F.count(c).alias(f"__n_{c}") for c in numeric])
    out = parts
    for c in categorical:
        counts = members.where(F.col(c).isNotNull()).groupBy(fold, c).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
        best = counts.groupBy(fold).agg(F.max_by(c, F.struct(F.col("__n"), -F.col("__first"))).alias(c))
        out = out.join(best, fold, "left")
    texts = [F.concat(F.lit(f"{c}="), F.when(F.col(f"__n_{c}") > 0, F.format_string("%.6f", c)).otherwise("NA")) for c in numeric]
    texts += [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in categorical]
    return out.select(fold, F.concat_ws("||", *texts).alias("strata"))


def fold_sizes(rows: DataFrame, fold: str) -> DataFrame:
    """One row on the folds' sizes without held-out rows: n_folds, share of singletons, min, median, mean, max, the ten largest."""
    sizes = rows.where(fold_label(F.col(fold)) != "zsv").groupBy(fold).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), fold).limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(fold).cast("string").alias("fold")))).alias("t"))
    whole = sizes.agg(F.count("*").alias("n_folds"), F.avg((F.col("n") == 1).cast("double")).alias("singletons"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"))
    return whole.crossJoin(F.broadcast(top)).select("n_folds", "singletons", "least", "median", "mean", "most", F.transform("t", lambda x: F.concat(x["fold"], F.lit(":"), (-x["minus"]).cast("string"))).alias("largest"))
