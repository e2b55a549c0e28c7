"""Resampling intervals. What a row counts in a resample is a function of the two alone, so results depend on neither file layout nor retries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.ranks import ranked

#: Chances of at most 0, 1, 2, ... counts of a Poisson number of mean one, in 2 ** 32 parts, up to where they can't be told from one.
TAIL = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i`` from 0, in the order of a key, by sorted ranges."""
    found = ranked(rows, *(F.asc(c) for c in order))
    return found.withColumn("i", F.col("rank") - 1).drop("rank")


def drawn(*parts: Column) -> Column:
    """32 bits that a hash gives for the numbers ``parts``; SQL of other engines can say the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def resampled(rows: DataFrame, times: int) -> DataFrame:
    """(b, w, columns): ``rows`` (with i) in ``times`` Poisson resamples, each with the number of times ``w`` that it counts; rows that don't count go.

    Every row is told apart by its place, so a table may have any number of rows. Rows are repeated within their task and sums over a resample are formed before anything is shuffled.
    """
    each = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
    each = each.withColumn("_u", F.explode(F.array(drawn(F.col("b"), F.col("i")))))  # through a generator, so that the hash isn't put in for each use of it
    return each.withColumn("w", sum((F.col("_u") >= t).cast("int") for t in TAIL)).where("w > 0").drop("_u")


def weighted(value: str | Column, w: str = "w") -> dict[str, Column]:
    """Mean and population variance of ``value`` under the counts ``w``."""
    value = F.col(value) if isinstance(value, str) else value
    mean = F.sum(F.col(w) * value) / F.sum(w)
    return {"mean": mean, "variance": F.sum(F.col(w) * value * value) / F.sum(w) - mean * mean}


def weighted_correlation(x: str, y: str, w: str = "w") -> Column:
    a, b = weighted(x, w), weighted(y, w)
    cov = F.sum(F.col(w) * F.col(x) * F.col(y)) / F.sum(w) - a["mean"] * b["mean"]
    return F.when((a["variance"] > 0) & (b["variance"] > 0), cov / F.sqrt(a["variance"] * b["variance"]))


def blocks(rows: DataFrame, times: int, size: int | None = None) -> DataFrame:
    """(b, columns): ``times`` samples of blocks of ``size`` neighbouring rows, cut to the number of ``rows`` (with i). A block may start at any row that has ``size`` - 1 after it, up to the 2 ** 32nd."""
    n = rows.count()
    size = size or max(1, -int(-((3 * n) ** (1 / 3)) // 1))
    starts = rows.sparkSession.range(times).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, -(-n // size) - 1)).cast("long"))).alias("i"))
    taken = starts.select("b", "i", (drawn(F.col("b"), F.col("i")) % max(1, n - size + 1)).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k"))
    return taken.where(F.col("i") * size + F.col("k") < n).select("b", (F.col("first") + F.col("k")).alias("i")).join(rows, "i")


def intervals(each: DataFrame, of: dict[str, str], level: float = 0.95) -> DataFrame:
    """One row: ``name_low`` and ``name_high`` of each statistic over the resamples."""
    ends = (("low", (1 - level) / 2), ("high", (1 + level) / 2))
    return each.agg(*(F.percentile(c, q).alias(f"{name}_{end}" if name else end) for name, c in of.items() for end, q in ends))
