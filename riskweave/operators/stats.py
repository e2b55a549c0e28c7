"""Tests, corrections, intervals and scores over columns; replicates are rows, spread by their number."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.ranks import ranked

from riskweave.functions.distributions import normal_cdf, t_two_sided


def welch(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row: t, degrees of freedom, p, Cohen's d over the mean variance, and the interval of the difference at 1.96."""
    of = lambda g: F.when(F.col(group) == g, F.col(value))
    out = df.agg(*(f(of(g)).alias(f"{n}{k}") for k, g in ((1, a), (2, b)) for f, n in ((F.avg, "m"), (F.var_samp, "v"), (F.count, "n"))))
    se2 = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    dof = se2 * se2 / (F.pow(F.col("v1") / F.col("n1"), 2) / (F.col("n1") - 1) + F.pow(F.col("v2") / F.col("n2"), 2) / (F.col("n2") - 1))
    diff = F.col("m1") - F.col("m2")
    out = out.select((diff / F.sqrt(se2)).alias("t"), dof.alias("dof"), (diff / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("cohen_d"), (diff - 1.96 * F.sqrt(se2)).alias("low"), (diff + 1.96 * F.sqrt(se2)).alias("high"))
    p = F.udf(lambda t, d: None if t is None or d is None else t_two_sided(t, d), "double")
    return out.withColumn("p", p("t", "dof"))


def diebold_mariano(df: DataFrame, e1: str, e2: str, order: str, horizon: int = 1) -> DataFrame:
    """One row: mean loss difference of squared errors, its long-run variance and the statistic.

    The series is one row a period; its window runs over the whole of it.
    """
    w = Window.orderBy(order)
    d = df.select(order, (F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2)).alias("x"))
    lags = range(1, horizon)
    d = d.select("x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in lags))
    long_run = F.var_samp("x")
    for k in lags:
        long_run = long_run + 2 * F.covar_samp("x", f"l{k}")
    out = d.agg(F.avg("x").alias("mean"), (long_run / F.count("x")).alias("var"))
    return out.select("mean", F.greatest("var", F.lit(1e-15)).alias("var"), (F.col("mean") / F.sqrt(F.greatest("var", F.lit(1e-15)))).alias("dm"))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal statistic; for a few rows, after aggregation."""
    return F.udf(lambda x: None if x is None else 2 * (1 - normal_cdf(abs(x))), "double")(z)


def corrected(df: DataFrame, p: str, order: list[str]) -> DataFrame:
    """``bonferroni``, ``holm`` and ``bh`` adjusted p; ``order`` makes the ranks total."""
    up = Window.orderBy(p, *order)
    down = Window.orderBy(F.desc(p), *(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_k", F.row_number().over(up)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    holm = F.max((F.col("_n") - F.col("_k") + 1) * F.col(p)).over(up.rowsBetween(Window.unboundedPreceding, 0))
    bh = F.min(F.col("_n") / F.col("_k") * F.col(p)).over(down)
    one = F.lit(1.0)
    return out.withColumns({"bonferroni": F.least(one, F.col(p) * F.col("_n")), "holm": F.least(one, holm), "bh": F.least(one, bh)}).drop("_k", "_n")


def conformal(calibration: DataFrame, test: DataFrame, y: str, yhat: str, alpha: float = 0.1) -> DataFrame:
    """``low`` and ``high`` of each test row: the prediction and the corrected quantile of absolute residuals."""
    away = calibration.select(F.abs(F.col(y) - F.col(yhat)).alias("away")).where("away IS NOT NULL")
    n = away.count()
    width = away.agg(F.percentile("away", min(math.ceil((1 - alpha) * (n + 1)) / n, 1.0) if n else 1.0).alias("width"))  # one row
    return test.join(F.broadcast(width)).select(*test.columns, (F.col(yhat) - F.col("width")).alias("low"), (F.col(yhat) + F.col("width")).alias("high"))


def calibration(df: DataFrame, y: str, low: str, high: str) -> DataFrame:
    """One row: coverage, mean width, and width penalised where coverage is under 95 %."""
    out = df.agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("double")).alias("picp"), F.avg(F.col(high) - F.col(low)).alias("mpiw"))
    return out.withColumn("cwc", F.when(F.col("picp") < 0.95, F.col("mpiw") * F.exp(-50 * (F.col("picp") - 0.95))).otherwise(F.col("mpiw")))


def pinball(df: DataFrame, y: str, yhat: str, q: float) -> Column:
    e = F.col(y) - F.col(yhat)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def regression(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: mse, rmse, mae, r2, and mape over rows where y is not zero."""
    e = F.col(y) - F.col(yhat)
    out = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("mape"), F.var_pop(y).alias("_v"))
    return out.select("mse", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).otherwise(0.0).alias("r2"), "mape")


def auc(df: DataFrame, label: str, score: str, key: list[str]) -> DataFrame:
    """(key, auc) from mean ranks of ties; 0 where one class is missing.

    Rows with equal scores are counted before ranks are formed.
    """
    levels = df.groupBy(*key, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    w = Window.partitionBy(*key).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    mid = F.sum("n").over(w) - (F.col("n") - 1) / 2
    out = levels.select(*key, (F.col("pos") * mid).alias("ranks"), "n", "pos").groupBy(*key).agg(F.sum("ranks").alias("r"), F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"))
    return out.select(*key, F.when((F.col("n1") == 0) | (F.col("n0") == 0), 0.0).otherwise((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def ar1(df: DataFrame, value: str, key: str, order: str = "d") -> DataFrame:
    """(key, slope, intercept) of each value on the one before."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, F.col(value).alias("y"), F.lag(value).over(w).alias("x")).where("x IS NOT NULL")
    return rows.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def ks_uniform(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """One row: the largest distance between the values' distribution and the uniform one on [low, high]."""
    f = F.least(F.greatest((F.col(value) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    rows = ranked(df.select(f.alias("f")), F.asc("f"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))  # one row
    return rows.join(n).agg(F.max(F.greatest(F.col("rank") / F.col("n") - F.col("f"), F.col("f") - (F.col("rank") - 1) / F.col("n"))).alias("ks"))


def _told_apart(df: DataFrame, key: list[str] | None) -> Column:
    """A hash of each row's key; without one, of all its columns and the number of the row among those equal to it, so that repeated rows stay apart."""
    if key:
        return F.xxhash64(*key)
    own = F.xxhash64(*df.columns)
    return F.xxhash64(own, F.row_number().over(Window.partitionBy(own).orderBy(own)))


def bootstrap(df: DataFrame, value: str, replicates: int, seed: int = 42, alpha: float = 0.05, key: list[str] | None = None) -> DataFrame:
    """One row: mean, percentile interval and population deviation of the means of Poisson resamples.

    A row enters each replicate a Poisson(1) number of times, decided by a hash of its key and
    replicate, so that replicates need no shuffle of the data: it is one pass and one partial
    aggregation by replicate.
    """
    rows = df.select(F.col(value).cast("double").alias("x"), _told_apart(df, key).alias("_row"))
    u = (F.pmod(F.xxhash64("_row", "b", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    count, level, total = F.lit(0), 0.0, math.exp(-1)
    for k in range(12):
        level += total
        count = count + F.when(u > level, 1).otherwise(0)
        total /= k + 1
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("k", count)
    means = drawn.groupBy("b").agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("m"))
    return means.agg(F.percentile("m", alpha / 2).alias("low"), F.percentile("m", 1 - alpha / 2).alias("high"), F.stddev_pop("m").alias("se"), F.count(F.lit(1)).alias("replicates"))


def sign_flip_test(df: DataFrame, a: str, b: str, replicates: int, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """One row: mean difference and the share of sign-flipped replicates at least as far from zero."""
    rows = df.select((F.col(a) - F.col(b)).alias("x"), _told_apart(df, key).alias("_row"))
    observed = rows.agg(F.avg("x").alias("observed"))
    sign = 1 - 2 * F.pmod(F.xxhash64("_row", "b", F.lit(seed)), F.lit(2))
    flipped = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).groupBy("b").agg(F.avg(sign * F.col("x")).alias("m"))
    far = F.abs("m") >= F.abs("observed")
    return flipped.join(F.broadcast(observed)).groupBy("observed").agg(F.avg(far.cast("double")).alias("p"))


def correlation_pairs(rows: DataFrame, names) -> DataFrame:
    """(x, y, c): Pearson's correlation of each two of the named columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = rows.agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}_{b}").alias("c")) for a, b in pairs))).alias("p")).select("p.*")


def compared(rows: DataFrame, model: str, score: str, baseline: str) -> DataFrame:
    """(model, mean, sd, median, n, t) of the scores of each model; t is Welch's against the baseline."""
    each = rows.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.percentile(score, 0.5).alias("median"), F.count(F.lit(1)).alias("n"), F.var_samp(score).alias("vr"))
    base = F.broadcast(each.where(F.col(model) == baseline).select(F.col("mean").alias("bm"), F.col("vr").alias("bv"), F.col("n").alias("bn")))
    return each.join(base).select(model, "mean", "sd", "median", "n", ((F.col("mean") - F.col("bm")) / F.sqrt(F.col("vr") / F.col("n") + F.col("bv") / F.col("bn"))).alias("t"))
