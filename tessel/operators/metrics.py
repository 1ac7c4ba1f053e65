"""Statistics over predictions, ranks and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def average_rank(rows: DataFrame, value: str, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``rows`` with the mean of the places that equal values share.

    Values are counted first, so only one row per distinct value is ranked.
    """
    keys = [*(by or []), value]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*(by or [])).orderBy(value)
    ranks = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], (F.sum("__n").over(order) - (F.col("__n") - 1) / 2).alias(name))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(ranks, cond).drop(*[f"__k{i}" for i in range(len(keys))])


def pearson(x: Column, y: Column) -> Column:
    """Pearson's coefficient as an aggregate over rows with both values; NaN for under two rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((n < 2) | constant, F.lit(NAN)).otherwise(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "spearman") -> DataFrame:
    """Pearson's coefficient of average ranks."""
    by = by or []
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranks = average_rank(average_rank(both, x, "__rx", by), y, "__ry", by)
    return ranks.groupBy(*by).agg(pearson(F.col("__rx"), F.col("__ry")).alias(name))


def ordinal_spearman(rows: DataFrame, x: str, y: str, tie: str, name: str = "spearman") -> DataFrame:
    """The variant with ordinal ranks, ties by ``tie``."""
    r = rows.withColumns({"__rx": F.row_number().over(Window.orderBy(x, tie)), "__ry": F.row_number().over(Window.orderBy(y, tie))})
    return r.agg(pearson(F.col("__rx"), F.col("__ry")).alias(name))


def regression(y: Column, p: Column) -> dict[str, Column]:
    """mse, rmse, mae and r2 as aggregates; r2 is NaN for under two rows or constant targets."""
    e = (y - p).cast("double")
    mse = F.avg(e * e)
    total = F.var_pop(y) * F.count(y)
    r2 = F.when((F.count(y) < 2) | (F.min(y) == F.max(y)), F.lit(NAN)).otherwise(1 - F.try_divide(F.sum(e * e), total))
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(e)), "r2": r2}


def lower_median(x: Column) -> Column:
    """The lower of the two middle values."""
    return F.percentile_disc(0.5, x) if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by x)")


def damped_pearson(x: Column, y: Column) -> Column:
    """Covariance over the product of deviations plus 1e-8; null for under two rows."""
    n = F.count(x)
    return F.when(n >= 2, F.covar_pop(x, y) * n / (F.sqrt(F.var_pop(x) * n * F.var_pop(y) * n) + 1e-8))


def roc_auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores; NaN with one kind of label only."""
    by = by or []
    points = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1 - F.col(label).cast("double")).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc(score))
    cum = points.withColumns({"tp": F.sum("p").over(order), "fp": F.sum("n").over(order)})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return cum.groupBy(*by).agg(F.when((F.sum("p") == 0) | (F.sum("n") == 0), F.lit(NAN)).otherwise(F.try_divide(area, F.sum("p") * F.sum("n"))).alias("auc"))


def accuracy(label: Column, score: Column, threshold: float = 0.5) -> Column:
    return F.avg((label.cast("int") == (score >= threshold).cast("int")).cast("double"))


def ks_similarity(rows: DataFrame, run: str, value: str) -> DataFrame:
    """(run_a, run_b, similarity): one less the greatest distance of the two runs' empirical distributions, all pairs a < b.

    There is a row per run and distinct value of either run, so runs should be few.
    """
    per = rows.groupBy(F.col(run).alias("run"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    totals = per.groupBy("run").agg(F.sum("n").alias("total"))
    a, b = totals.select(F.col("run").alias("run_a"), F.col("total").alias("ta")), totals.select(F.col("run").alias("run_b"), F.col("total").alias("tb"))
    pairs = a.join(b, F.col("run_a") < F.col("run_b"))
    left = pairs.join(per, pairs["run_a"] == per["run"]).select("run_a", "run_b", "v", (F.col("n") / F.col("ta")).alias("d"))
    right = pairs.join(per, pairs["run_b"] == per["run"]).select("run_a", "run_b", "v", (-F.col("n") / F.col("tb")).alias("d"))
    steps = left.unionByName(right).groupBy("run_a", "run_b", "v").agg(F.sum("d").alias("d"))
    gap = steps.withColumn("gap", F.abs(F.sum("d").over(Window.partitionBy("run_a", "run_b").orderBy("v"))))
    return gap.groupBy("run_a", "run_b").agg((1 - F.max("gap")).alias("similarity"))


def correlation_matrix(rows: DataFrame, run: str, group: str, value: str) -> DataFrame:
    """(run_a, run_b, r, n): Pearson's coefficient over the groups that both runs have, a < b."""
    per = rows.groupBy(F.col(run).alias("run"), F.col(group).alias("g")).agg(F.avg(value).alias("v"))
    a, b = (per.select(F.col("run").alias(f"run_{s}"), "g", F.col("v").alias(f"v{s}")) for s in ("a", "b"))
    return a.join(b, "g").where("run_a < run_b").groupBy("run_a", "run_b").agg(pearson(F.col("va"), F.col("vb")).alias("r"), F.count("*").alias("n"))


def ols(rows: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients of y on 1 and xs by the normal equations; the sums are Spark's, the small solve the driver's."""
    import numpy as np

    names = ["__one", *xs]
    cols = {n: (F.lit(1.0) if n == "__one" else F.col(n).cast("double")) for n in names}
    sums = [F.sum(cols[a] * cols[b]).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(cols[a] * F.col(y)).alias(f"{a}*y") for a in names]
    clean = rows.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    s = clean.agg(*sums).head().asDict()
    m = np.array([[s.get(f"{a}*{b}", s.get(f"{b}*{a}")) for b in names] for a in names], float)
    beta = np.linalg.lstsq(m, np.array([s[f"{a}*y"] for a in names], float), rcond=None)[0]
    return dict(zip(["intercept", *xs], map(float, beta), strict=True))


def size_normalised(rows: DataFrame, y: str, n: str, gap: str, fit_on: Column | None = None) -> DataFrame:
    """``rows`` with expected, residual, ratio and z of ``y`` given log(n) and the share of gaps."""
    base = rows.withColumn("__log", F.log(F.col(n).cast("double")))
    fit = base.where(fit_on) if fit_on is not None else base
    c = ols(fit, y, ["__log", gap])
    expected = F.lit(c["intercept"]) + F.col("__log") * c["__log"] + F.col(gap) * c[gap]
    out = base.withColumn("expected", expected).withColumn("residual", F.col(y) - F.col("expected")).drop("__log")
    sd = out.where(fit_on) if fit_on is not None else out
    s = sd.agg(F.stddev_samp("residual")).head()[0] or 0.0
    return out.withColumns({"ratio": F.try_divide(F.col(y), F.col("expected")), "z": F.try_divide(F.col("residual"), F.lit(s))})


def wilcoxon(rows: DataFrame, by: list[str], difference: str, least: int = 5) -> DataFrame:
    """Signed-rank test by the normal approximation, per group: n, w_plus, z, p, median; zero differences are left out."""
    used = rows.where(F.col(difference) != 0).withColumn("__abs", F.abs(difference))
    r = average_rank(used, "__abs", "__rank", by)
    ties = used.groupBy(*by, "__abs").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    per = r.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("__rank")).otherwise(0.0)).alias("w_plus"), F.expr(f"median({difference})").alias("median"))
    n = F.col("n")
    out = per.join(ties, by).where(n >= least)
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    out = out.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, sd))
    return out.withColumn("p", 2 * (1 - normal_cdf(F.abs("z")))).drop("ties")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function for z >= 0, to 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / 2.5066282746310002 * poly


def benjamini_hochberg(rows: DataFrame, p: str, key: list[str], q: str = "q") -> DataFrame:
    """``rows`` with false-discovery-rate adjusted values; one row per test."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    ranked = rows.withColumn("__raw", F.col(p) * n / F.row_number().over(Window.orderBy(p, *key)))
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min("__raw").over(Window.orderBy(F.desc(p), *[F.desc(k) for k in key]).rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("__raw")


def density(values: DataFrame, value: str, low: float, high: float, points: int = 50, by: list[str] | None = None) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth sd * n**(-1/5); the grid has a fixed number of points."""
    by = by or []
    grid = values.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
    stats = values.groupBy(*by).agg(F.count(value).alias("__n"), F.stddev_samp(value).alias("__sd"))
    stats = stats.withColumn("__h", F.greatest(F.coalesce("__sd", F.lit(0.0)), F.lit(1e-6)) * F.pow(F.col("__n"), F.lit(-0.2)))
    joined = values.select(*by, F.col(value).alias("__v")).join(F.broadcast(stats), by) if by else values.select(F.col(value).alias("__v")).crossJoin(F.broadcast(stats))
    u = (F.col("x") - F.col("__v")) / F.col("__h")
    return joined.crossJoin(F.broadcast(grid)).groupBy(*by, "x").agg(F.avg(F.exp(-u * u / 2) / (F.col("__h") * 2.5066282746310002)).alias("density"))
