"""Tail risk of banks against the system: VaR, CoVaR, delta CoVaR, MES, SRISK."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.05
K = 0.08


def value_at_risk(returns: DataFrame, key: str = "bank", value: str = "r", alpha: float = ALPHA) -> DataFrame:
    """(key, var): exact percentile, interpolated."""
    return returns.groupBy(key).agg(F.percentile(value, alpha).alias("var"))


def with_system(returns: DataFrame) -> DataFrame:
    """(bank, d, r, m): each return beside the mean of all banks that period."""
    return returns.join(returns.groupBy("d").agg(F.avg("r").alias("m")), "d")


def risk_table(returns: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(bank, var, covar, delta_covar, mes) against the equal-weight system.

    CoVaR is the percentile of the bank where the system is at or below its VaR; with
    fewer than three such periods the bank's own VaR. Delta CoVaR sets it against the periods in
    which the system is within the tenth percentile of its distance from its median,
    with fewer than three the bank's median.
    """
    both = with_system(returns)
    market = returns.groupBy("d").agg(F.avg("r").alias("m"))
    level = market.agg(F.percentile("m", alpha).alias("sv"), F.median("m").alias("sm"))
    band = market.join(F.broadcast(level)).agg(F.greatest(F.percentile(F.abs(F.col("m") - F.col("sm")), 0.1), F.lit(1e-10)).alias("sb"))
    rows = both.join(F.broadcast(level)).join(F.broadcast(band))
    low, calm = F.col("m") <= F.col("sv"), F.abs(F.col("m") - F.col("sm")) <= F.col("sb")
    out = rows.groupBy("bank").agg(
        F.percentile("r", alpha).alias("var"), F.median("r").alias("mid"),
        F.count_if(low).alias("n_low"), F.count_if(calm).alias("n_calm"),
        F.percentile(F.when(low, F.col("r")), alpha).alias("covar_low"),
        F.percentile(F.when(calm, F.col("r")), alpha).alias("covar_calm"),
        F.avg(F.when(low, F.col("r"))).alias("mes"),
    )
    covar = F.when(F.col("n_low") < 3, F.col("var")).otherwise(F.col("covar_low"))
    calm_level = F.when(F.col("n_calm") < 3, F.col("mid")).otherwise(F.col("covar_calm"))
    return out.select("bank", "var", covar.alias("covar"), (covar - calm_level).alias("delta_covar"), "mes")


def srisk(mes: Column, equity: Column, debt: Column, k: float = K) -> Column:
    """Expected shortfall of capital in a crisis, never negative."""
    return F.greatest(F.lit(0.0), k * debt - (1 - k) * equity * (1 + mes))


def bank_metrics(state: DataFrame) -> DataFrame:
    """One row: mean and least CET1, number under 8 and under 4.5, mean LCR."""
    return state.agg(
        F.avg("cet1").alias("mean_cet1"), F.min("cet1").alias("min_cet1"), F.count_if(F.col("cet1") < 8).alias("stressed"),
        F.count_if(F.col("cet1") < 4.5).alias("insolvent"), F.avg("lcr").alias("mean_lcr"),
    )
