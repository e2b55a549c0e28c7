"""Walk-forward folds, errors by target, and sensitivity of a model to its parameters."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import resampling


def expanding_folds(spark: SparkSession, n: int, splits: int, train: int, test: int, gap: int = 0) -> DataFrame:
    """(fold, train_end, test_start, test_end) over places 0 to ``n``, ends exclusive; training sets grow in equal steps."""
    free = n - train - gap - test
    if free <= 0:
        raise ValueError(f"{n} rows are too few for folds of {train} + {gap} + {test}")
    rows = spark.range(splits).select(F.col("id").alias("fold"), (train + F.col("id") * max(1, free // splits)).alias("train_end"))
    rows = rows.withColumn("test_start", F.col("train_end") + gap)
    return rows.withColumn("test_end", F.least(F.col("test_start") + test, F.lit(n))).where("test_end > test_start")


def spaced_folds(spark: SparkSession, n: int, splits: int, train: int, test: int, gap: int = 0) -> DataFrame:
    """Folds as of ``expanding_folds``, whose test sets are spread evenly and end with the last row."""
    first, last = train + gap, n - test
    if last <= first:
        raise ValueError(f"{n} rows are too few for folds of {train} + {gap} + {test}")
    start = F.expr(f"{first} + ({last - first} * id) div {max(1, splits - 1)}")
    rows = spark.range(splits).select(F.col("id").alias("fold"), start.alias("test_start"))
    return rows.select("fold", (F.col("test_start") - gap).alias("train_end"), "test_start", F.least(F.col("test_start") + test, F.lit(n)).alias("test_end"))


def walk_forward(rows: DataFrame, folds: DataFrame, x: str, y: str) -> DataFrame:
    """(fold, n, r2, mse) of a line fitted to the training rows (with ``i``) of each fold; folds are few, so they are sent to all tasks."""
    fit = rows.join(F.broadcast(folds), F.col("i") < F.col("train_end")).groupBy("fold").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"))
    tested = rows.join(F.broadcast(folds.join(fit, "fold")), (F.col("i") >= F.col("test_start")) & (F.col("i") < F.col("test_end")))
    return fits(tested.withColumn("p", F.col("base") + F.col("slope") * F.col(x)), y, "p", "fold")


def fits(rows: DataFrame, y: str, predicted: str, *by: str) -> DataFrame:
    """(by, n, r2, mse) of predictions; r2 is null where ``y`` is flat."""
    error = F.pow(F.col(y) - F.col(predicted), F.lit(2))
    total = F.var_pop(y) * F.count(F.lit(1))
    return rows.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(total > 0, 1 - F.sum(error) / total).alias("r2"), F.avg(error).alias("mse"))


def fold_summary(scores: DataFrame) -> DataFrame:
    """One row: mean, spread and median of r2 over folds, and the mean mse."""
    return scores.agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("sd_r2"), F.percentile("r2", 0.5).alias("median_r2"), F.avg("mse").alias("mse"))


def reconstruction(x: Column, y: Column) -> dict[str, Column]:
    """Errors of an array ``y`` against ``x``, by row: mean square, mean absolute error and cosine (null for a zero array)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    norms = F.sqrt(dot(x, x) * dot(y, y))
    return {
        "mse": total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))) / F.size(x),
        "mae": total(F.zip_with(x, y, lambda p, q: F.abs(p - q))) / F.size(x),
        "cosine": F.when(norms > 0, dot(x, y) / norms),
    }


# --- sensitivity ---------------------------------------------------------------------------------------


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _spread(prime: int) -> Column:
    """Place of point ``run`` in an evenly spread sequence from 0 to 1."""
    x = (F.col("run") + 0.5) * F.sqrt(F.lit(float(prime)))
    return x - F.floor(x)


def _scaled(bounds: dict[str, tuple[float, float]], skip: int = 0) -> dict[str, Column]:
    primes = _primes(skip + len(bounds))[skip:]
    return {name: lo + (hi - lo) * _spread(p) for (name, (lo, hi)), p in zip(bounds.items(), primes, strict=True)}


def _varied(spark: SparkSession, times: int, kinds: dict[str, dict[str, Column]]) -> DataFrame:
    each = [F.struct(F.lit(kind).alias("moved"), *(c.alias(n) for n, c in values.items())) for kind, values in kinds.items()]
    return spark.range(times).select(F.col("id").alias("run")).select("run", F.explode(F.array(*each)).alias("x")).select("run", "x.*")


def screening_points(spark: SparkSession, bounds: dict[str, tuple[float, float]], times: int, step: float = 0.5) -> DataFrame:
    """(run, moved, parameters): ``times`` base points, moved = '', and each with one parameter up by ``step`` of its range, its end at most."""
    base = _scaled(bounds)
    kinds = {"": base} | {n: base | {n: F.least(F.lit(hi), base[n] + step * (hi - lo))} for n, (lo, hi) in bounds.items()}
    return _varied(spark, times, kinds)


def elementary_effects(results: DataFrame, bounds: dict[str, tuple[float, float]], y: str, step: float = 0.5) -> DataFrame:
    """(parameter, effect, spread): mean size and deviation of the change of ``y`` by step, from the results at ``screening_points``."""
    width = F.create_map(*(F.lit(v) for n, (lo, hi) in bounds.items() for v in (n, step * (hi - lo))))
    base = results.where("moved = ''").select("run", F.col(y).alias("_base"))
    change = results.where("moved != ''").join(base, "run").select(F.col("moved").alias("parameter"), ((F.col(y) - F.col("_base")) / width[F.col("moved")]).alias("e"))
    return change.groupBy("parameter").agg(F.avg(F.abs("e")).alias("effect"), F.stddev_pop("e").alias("spread"))


def variance_points(spark: SparkSession, bounds: dict[str, tuple[float, float]], times: int) -> DataFrame:
    """(run, moved, parameters): points 'a' and 'b' that are independent, and for each parameter 'a' with that of 'b'."""
    a, b = _scaled(bounds), _scaled(bounds, len(bounds))
    kinds = {" a": a, " b": b} | {n: a | {n: b[n]} for n in bounds}
    return _varied(spark, times, kinds)


def variance_shares(results: DataFrame, y: str) -> DataFrame:
    """(parameter, first, total): shares of the variance of ``y`` that a parameter makes alone and with others, from ``variance_points``; null if ``y`` is flat."""
    ends = results.where("moved IN (' a', ' b')")
    both = ends.groupBy("run").agg(F.max(F.when(F.col("moved") == " a", F.col(y))).alias("a"), F.max(F.when(F.col("moved") == " b", F.col(y))).alias("b"))
    spread = F.broadcast(ends.agg(F.var_pop(y).alias("_v")))
    rows = results.where("moved NOT IN (' a', ' b')").join(both, "run")
    out = rows.groupBy(F.col("moved").alias("parameter")).agg(F.avg(F.col("b") * (F.col(y) - F.col("a"))).alias("f"), (F.avg(F.pow(F.col("a") - F.col(y), F.lit(2))) / 2).alias("t"))
    share = lambda c: F.when(F.col("_v") > 0, F.col(c) / F.col("_v"))
    return out.join(spread).select("parameter", share("f").alias("first"), share("t").alias("total"))


# --- intervals -----------------------------------------------------------------------------------------


def corrected_interval(rows: DataFrame, value: str, times: int, level: float = 0.95) -> DataFrame:
    """One row (estimate, low, high, se): interval of a mean over resamples of ``rows`` (with i), corrected for bias and acceleration.

    Leaving out one row moves a mean by its own distance from it, so the acceleration is a sixth of a ratio of moments.
    """
    mean = rows.agg(F.avg(value).alias("m"))
    m = mean.first()["m"]
    if m is None:
        return mean.select(F.col("m").alias("estimate"), *(F.lit(None).cast("double").alias(c) for c in ("low", "high", "se")))
    away = F.col(value) - m
    cubes, squares = rows.agg(F.sum(away * away * away), F.sum(away * away)).first()
    a = cubes / (6 * squares**1.5) if squares > 0 else 0.0
    each = resampling.resampled(rows, times).groupBy("b").agg(resampling.weighted(value)["mean"].alias("q"))
    below = each.agg(F.avg((F.col("q") < m).cast("double"))).first()[0]
    normal = NormalDist()
    bias = normal.inv_cdf(min(max(below, 0.5 / times), 1 - 0.5 / times))
    ends = [bias + normal.inv_cdf(p) for p in ((1 - level) / 2, (1 + level) / 2)]
    low, high = (normal.cdf(bias + z / (1 - a * z)) for z in ends)
    return each.agg(F.lit(m).alias("estimate"), F.percentile("q", low).alias("low"), F.percentile("q", high).alias("high"), F.stddev_pop("q").alias("se"))
