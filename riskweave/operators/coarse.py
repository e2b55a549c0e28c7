"""How well the slow modes of a network stand for all of it. Everything follows from one set of modes; no second spectrum is solved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import correlation


def rescaled(weights: DataFrame, mode_rows: DataFrame, by: str, k: int, strict: bool = True) -> DataFrame:
    """``weights`` (by, w and others) over the value of mode ``k``; where that is not positive, an error, or null if not ``strict``."""
    value = mode_rows.where(F.col("mode") == k).groupBy(by).agg(F.max("lambda").alias("_at"))
    positive = F.when(F.col("_at") > 0, F.col("_at"))
    if strict:
        positive = positive.otherwise(F.raise_error(F.lit(f"mode {k} has no positive value")).cast("double"))
    return weights.join(value, by).withColumn("w", F.col("w") / positive).drop("_at")


def spectrum_error(mode_rows: DataFrame, other: DataFrame, by: str, k: int) -> DataFrame:
    """(by, error): distance of the first ``k`` + 1 values of two spectra, over the length of the first; values that the other lacks are 0."""
    values = lambda rows: rows.where(F.col("mode") <= k).groupBy(by, "mode").agg(F.max("lambda").alias("lambda"))
    both = values(mode_rows).join(values(other).withColumnRenamed("lambda", "_o"), [by, "mode"], "left")
    away = F.pow(F.col("lambda") - F.coalesce("_o", F.lit(0.0)), F.lit(2))
    length = F.sqrt(F.sum(F.col("lambda") * F.col("lambda")))
    return both.groupBy(by).agg(F.when(length > 0, F.sqrt(F.sum(away)) / length).otherwise(0.0).alias("error"))


def diffusion_by_scale(mode_rows: DataFrame, by: str, sources: DataFrame, ks: list[int], times: list[float]) -> DataFrame:
    """(by, k, t, error, corr, rmse, r2): heat of one unit at each snapshot's node in ``sources`` (by, node), under all modes and under the first ``k`` + 1.

    Modes past ``k`` count with the value 0, as in the Laplacian that is summed up to ``k``. ``error`` is the length of the difference over that
    of the heat; ``corr`` is null and ``r2`` 1 where heat is the same at all nodes.
    """
    start = mode_rows.join(sources, [by, "node"]).select(by, "mode", F.col("v").alias("v0"))
    rows = mode_rows.join(start, [by, "mode"]).withColumn("c", F.col("v0") * F.col("v")).withColumn("t", F.explode(F.array(*map(F.lit, map(float, times)))))
    faded = F.col("c") * F.exp(-F.col("t") * F.col("lambda"))
    kept = [F.sum(F.when(F.col("mode") <= k, faded).otherwise(F.col("c"))).alias(f"q{k}") for k in ks]
    heat = rows.groupBy(by, "t", "node").agg(F.sum(faded).alias("p"), *kept)
    heat = heat.select(by, "t", "p", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"q{k}").alias("q")) for k in ks))).alias("x")).select(by, "t", "p", "x.*")
    away = F.sum(F.pow(F.col("p") - F.col("q"), F.lit(2)))
    total = F.var_pop("p") * F.count(F.lit(1))
    return heat.groupBy(by, "k", "t").agg(
        (F.sqrt(away) / F.sqrt(F.sum(F.col("p") * F.col("p")))).alias("error"), correlation("p", "q").alias("corr"),
        F.sqrt(away / F.count(F.lit(1))).alias("rmse"), F.when(total > 1e-12, 1 - away / total).otherwise(1.0).alias("r2"),
    )


def best_scale(scores: DataFrame, by: str, least: float = 0.9) -> DataFrame:
    """(by, k): the fewest modes whose r2, by mean over times, is over ``least``; 1 if none is."""
    each = scores.groupBy(by, "k").agg(F.avg("r2").alias("r2"))
    return each.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("r2") > least, F.col("k"))), F.lit(1).cast("long")).alias("k"))
