"""Thresholds of correlation networks that hold across time: correlations of many windows from one pass, spectra of all folds and thresholds as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import quadrature as quad
from riskweave.sources.scratch import materialise

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def cumulated(series: DataFrame, by: list[str], key: str, value: str, time: str) -> DataFrame:
    """(by, s, t, i, n, x, y, xx, yy, xy): sums of products of each pair of series up to and with its i-th common time, from 1, in one pass over the pairs."""
    a = series.select(*by, time, F.col(key).alias("s"), F.col(value).alias("_x"))
    b = series.select(*by, time, F.col(key).alias("t"), F.col(value).alias("_y"))
    so_far = Window.partitionBy(*by, "s", "t").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    of = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "yy": F.col("_y") * F.col("_y"), "xy": F.col("_x") * F.col("_y")}
    rows = a.join(b, [*by, time]).where("s < t")
    return rows.select(*by, "s", "t", F.row_number().over(so_far).alias("i"), *(F.sum(c).over(so_far).alias(name) for name, c in of.items()))


def _correlation(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    spread = (n * xx - x * x) * (n * yy - y * y)
    # a flat side leaves rounding errors only
    return F.when((n * xx - x * x > 1e-12 * n * xx) & (n * yy - y * y > 1e-12 * n * yy), (n * xy - x * y) / F.sqrt(spread))


def fold_correlations(series: DataFrame, by: list[str], key: str, value: str, time: str, folds: int) -> DataFrame:
    """(by, fold, s, t, n, c): correlations within ``folds`` runs of T div folds times each, as differences of ``cumulated`` at their ends; what is over at the end is left out."""
    sums = cumulated(series, by, key, value, time)
    pair = Window.partitionBy(*by, "s", "t")
    ends = sums.withColumn("_size", F.floor(F.max("i").over(pair) / folds).cast("int"))
    ends = ends.where((F.col("_size") > 0) & (F.col("i") % F.col("_size") == 0) & (F.col("i") <= F.col("_size") * folds))
    less = {c: F.col(c) - F.coalesce(F.lag(c).over(pair.orderBy("i")), F.lit(0.0)) for c in _SUMS}
    rows = ends.select(*by, (F.col("i") / F.col("_size") - 1).cast("int").alias("fold"), "s", "t", *(c.alias(name) for name, c in less.items()))
    return rows.select(*by, "fold", "s", "t", F.col("n").cast("long").alias("n"), _correlation(*map(F.col, _SUMS)).alias("c"))


def fold_spectra(series: DataFrame, by: str, key: str, value: str, time: str, thresholds: list[float], folds: int = 5, spare: int = 10) -> DataFrame:
    """(by, fold, threshold, lam2, gap) of the networks of every fold cut at every threshold; folds of fewer times than series and ``spare`` are left out.

    Only times that all series of a snapshot have are used; series without an edge are nodes too, a null correlation is no edge.
    """
    keys = series.select(by, key).distinct()
    whole = keys.groupBy(by).agg(F.count(F.lit(1)).alias("_keys"))
    full = series.groupBy(by, time).agg(F.count(F.lit(1)).alias("_here")).join(whole, by).where("_here = _keys").select(by, time)
    pairs = materialise(fold_correlations(series.join(full, [by, time], "left_semi"), [by], key, value, time, folds))
    used = pairs.groupBy(by, "fold").agg(F.max("n").alias("n")).join(whole, by).where(F.col("n") >= F.col("_keys") + spare).select(by, "fold")
    grid = F.posexplode(F.array(*map(F.lit, map(float, thresholds)))).alias("place", "threshold")
    cells = used.select(by, "fold", grid).withColumn("cell", F.concat_ws("|", F.col(by).cast("string"), "fold", "place"))
    cells = materialise(cells)
    edges = pairs.join(cells, [by, "fold"]).where(F.col("c") >= F.col("threshold")).select("cell", "s", "t", "c")
    nodes = cells.join(keys, by).select("cell", F.col(key).alias("node"))
    found = materialise(quad.values(edges, nodes, "cell"))
    return cells.join(quad.places(found, "cell"), "cell").join(quad.widest_gap(found, "cell"), "cell").select(by, "fold", "threshold", "lam2", "gap")


def threshold_stability(spectra: DataFrame, by: str) -> DataFrame:
    """(by, threshold, folds, gap_mean, gap_cv, lam2_mean, lam2_cv, best): mean and relative spread over folds, null under two; ``best`` marks the steadiest gap, ties to the smaller threshold."""
    spread = lambda c: F.when(F.count(c) > 1, F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(1e-10)))
    out = spectra.groupBy(by, "threshold").agg(F.count(F.lit(1)).alias("folds"), F.avg("gap").alias("gap_mean"), spread("gap").alias("gap_cv"), F.avg("lam2").alias("lam2_mean"), spread("lam2").alias("lam2_cv"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(F.round("gap_cv", 9)), "threshold"))
    return out.withColumn("best", (first == 1) & F.col("gap_cv").isNotNull())
