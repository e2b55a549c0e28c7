"""Forecasting and classification baselines on pyspark.ml, and scores of their forecasts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chronological(df: DataFrame, order: list[str], share: float = 0.8) -> DataFrame:
    """``train``: whether the row is within the first ``share`` of all rows, by rank over distinct first-order values."""
    cut = df.agg(F.percentile_approx(F.col(order[0]).cast("timestamp").cast("long"), share, 10_000).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("train", F.col(order[0]).cast("timestamp").cast("long") <= F.col("_cut")).drop("_cut")


def moving_average(df: DataFrame, value: str, key: str, width: int, order: str = "d") -> DataFrame:
    """``forecast``: mean of the ``width`` rows before."""
    return df.withColumn("forecast", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-width, -1)))


def persistence(df: DataFrame, value: str, key: str, order: str = "d") -> DataFrame:
    """``forecast``: the value before."""
    return df.withColumn("forecast", F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def ar1_path(slope, intercept, last, horizon: int):
    """The recursive forecast of an AR(1), in closed form."""
    power = F.pow(slope, F.lit(float(horizon)))
    return F.when(F.abs(slope - 1) < 1e-12, intercept * horizon + last).otherwise(intercept * (1 - power) / (1 - slope) + power * last)


def regressor(kind: str, label: str, **options):
    """A scaled regression pipeline by name: linear, forest or boosted."""
    kinds = {"linear": LinearRegression, "forest": RandomForestRegressor, "boosted": GBTRegressor}
    if kind not in kinds:
        raise ValueError(f"unknown regressor {kind}")
    return kinds[kind](labelCol=label, featuresCol="features", predictionCol="forecast", **options)


def fit(df: DataFrame, features: list[str], model) -> DataFrame:
    """``df`` with what a pipeline of assembler, scaler and ``model`` gives, fitted on rows where ``train`` holds."""
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model]
    return Pipeline(stages=steps).fit(df.where("train")).transform(df).drop("_raw", "features")


def classifier(label: str):
    return LogisticRegression(labelCol=label, featuresCol="features", probabilityCol="_p", predictionCol="predicted", rawPredictionCol="_r")


def probability(df: DataFrame) -> DataFrame:
    return df.withColumn("probability", vector_to_array("_p")[1]).drop("_p", "_r")


def clusters(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """``cluster`` of each row's array by k-means."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(rows).transform(rows).drop("_v")


def components(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``latent``: the first ``k`` principal components of each row's array."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_l").fit(rows).transform(rows).withColumn("latent", vector_to_array("_l")).drop("_v", "_l")


def granger(returns: DataFrame, lags: int = 2, alpha: float = 0.05, key: str = "bank", time: str = "d", value: str = "r") -> DataFrame:
    """(s, t, p, weight): does the past of s help to foretell t? F-test of the least p over lags 1 to ``lags``; weight 1 - p under ``alpha``.

    Pairs are formed by period, so a task holds the series of one pair at most.
    """
    import numpy as np
    import pandas as pd

    from riskweave.functions.distributions import f_upper

    def test(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("d")
        x, y, best = g["x"].to_numpy(dtype=float), g["y"].to_numpy(dtype=float), 1.0
        for lag in range(1, lags + 1):
            n = len(y) - lag
            if n <= 2 * lag + 1:
                continue
            past = lambda z: [z[lag - j : len(z) - j] for j in range(1, lag + 1)]
            sse = []
            for cols in (past(y), past(y) + past(x)):
                a = np.column_stack([np.ones(n), *cols])
                sse.append(float(((y[lag:] - a @ np.linalg.lstsq(a, y[lag:], rcond=None)[0]) ** 2).sum()))
            dof = n - 2 * lag - 1
            best = min(best, f_upper((sse[0] - sse[1]) / lag / max(sse[1] / dof, 1e-300), lag, dof))
        return pd.DataFrame({"s": [g["s"].iloc[0]], "t": [g["t"].iloc[0]], "p": [best]})

    a = returns.select(F.col(time).alias("d"), F.col(key).alias("s"), F.col(value).alias("x"))
    b = returns.select(F.col(time).alias("d"), F.col(key).alias("t"), F.col(value).alias("y"))
    kind = dict(returns.dtypes)[key]
    out = a.join(b, "d").where("s != t").groupBy("s", "t").applyInPandas(test, f"s {kind}, t {kind}, p double")
    return out.withColumn("weight", F.when(F.col("p") < alpha, 1 - F.col("p")).otherwise(0.0))
