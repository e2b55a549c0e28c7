"""Calibration of cascades by differential evolution (Storn and Price, 1997), as tables.

The population is a table of one row a candidate. A generation makes a trial of every candidate by hashes of seed, generation and place, and
evaluates all trials and all their runs as keys of one relational cascade; nothing is simulated candidate by candidate, and nothing depends on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.operators.contagion import EQUITY_SHARE
from riskweave.sources.scratch import forget, held, materialise


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, both excluded, from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(*parts: Column) -> Column:
    return F.sqrt(-2 * F.log(uniform(*parts, F.lit("r")))) * F.cos(2 * math.pi * uniform(*parts, F.lit("a")))


def cascades(state: DataFrame, exposures: DataFrame, by: list[str], lgd: str, rounds: int = 12) -> DataFrame:
    """(by, bank, cet1, defaulted): every cascade of losses on loans to banks whose ratio is below zero, all keys of ``by`` at once.

    ``state`` (by, bank, cet1, total_assets, interbank_assets, and the column ``lgd``, the share of a loan that is lost); ``exposures`` (source, target, weight) are the same for all keys. A cascade that hasn't ended after ``rounds`` is an error.
    """
    now = materialise(state.select(*by, "bank", "cet1", "total_assets", "interbank_assets", lgd, (F.col("cet1") < 0).alias("new"), (F.col("cet1") < 0).alias("defaulted")))
    # all rounds read the same loans, which may stand for joins of large tables
    edges = held(exposures).select(F.col("source").alias("bank"), F.col("target").alias("_lost"), "weight")
    for _ in range(rounds):
        fallen = now.where("new").select(*by, F.col("bank").alias("_lost"))
        if fallen.isEmpty():
            return now.select(*by, "bank", "cet1", "defaulted")
        lost = fallen.join(edges, "_lost").groupBy(*by, "bank").agg(F.sum("weight").alias("_loss"))
        hit = now.join(lost, [*by, "bank"], "left")
        loss = F.least(F.coalesce("_loss", F.lit(0.0)) * F.col(lgd), F.col("interbank_assets"))
        cet1 = F.col("cet1") - loss / (EQUITY_SHARE * F.col("total_assets")) * 100
        new = (cet1 < 0) & ~F.col("defaulted")
        after = hit.select(*by, "bank", cet1.alias("cet1"), "total_assets", (F.col("interbank_assets") - loss).alias("interbank_assets"), lgd, new.alias("new"), (new | F.col("defaulted")).alias("defaulted"))
        before, now = now, materialise(after)
        forget(before)
    raise RuntimeError(f"a cascade did not end in {rounds} rounds")


def cascade_metrics(candidates: DataFrame, state: DataFrame, exposures: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """(id, defaults, mean_cet1): share of banks that fail and mean ratio over ``runs`` shocks for each candidate (id, shock, spread, lgd).

    A bank's ratio falls by ``shock`` and by ``spread`` times a normal number of its own, which is the same for all candidates.
    """
    drawn = state.select("bank", "cet1", "total_assets", "interbank_assets").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    drawn = drawn.withColumn("_z", normal(F.col("bank"), F.col("run"), F.lit(seed)))
    # candidates are as many as the population, a parameter
    rows = drawn.join(F.broadcast(candidates.select("id", "shock", "spread", "lgd"))).withColumn("cet1", F.col("cet1") - F.col("shock") - F.col("spread") * F.col("_z"))
    ended = cascades(rows, exposures, ["id", "run"], "lgd")
    return ended.groupBy("id").agg(F.avg(F.col("defaulted").cast("double")).alias("defaults"), F.avg("cet1").alias("mean_cet1"))


def loss(metrics: DataFrame, targets: dict[str, float], weights: dict[str, float] | None = None) -> DataFrame:
    """(id, loss): weighted squared errors against the targets, relative where a target isn't zero."""
    weights = weights or {}
    error = lambda name, t: (F.col(name) - t) / (abs(t) if t else 1.0)
    return metrics.select("id", sum((weights.get(n, 1.0) * error(n, t) * error(n, t) for n, t in targets.items()), F.lit(0.0)).alias("loss"))


def evolve(
    spark: SparkSession, bounds: dict[str, tuple[float, float]], objective: Callable[[DataFrame], DataFrame], population: int = 20, generations: int = 30, scale: float = 0.7, crossover: float = 0.8, tolerance: float = 1e-4, seed: int = 42
) -> DataFrame:
    """(generation, id, parameters, loss) of every candidate that survived each generation.

    ``objective`` gives (id, loss) for a table (id, parameters). A trial adds ``scale`` times the difference of two others to the best candidate in every second place, to a third other in the rest, takes each parameter of it
    with the chance ``crossover`` and one for sure, and stays if it is not worse. Values past a bound are thrown back inside. It ends when losses differ by less than ``tolerance`` of their mean, or after ``generations``.
    """
    if population < 4:
        raise ValueError("differential evolution needs four candidates")
    names = list(bounds)

    def inside(c: Column, name: str, *parts: Column) -> Column:
        low, high = bounds[name]
        return F.when((c >= low) & (c <= high), c).otherwise(low + (high - low) * uniform(*parts, F.lit(name), F.lit("in")))

    # each parameter's range is cut into as many parts as there are candidates, and each part is used once
    start = spark.range(population)
    for name in names:
        low, high = bounds[name]
        part = F.row_number().over(Window.orderBy(F.xxhash64("id", F.lit(seed), F.lit(name)))) - 1
        start = start.withColumn(name, low + (high - low) * (part + uniform(F.col("id"), F.lit(seed), F.lit(name), F.lit("at"))) / population)
    start = materialise(start)
    now = materialise(start.join(objective(start), "id").select("id", *names, "loss"))
    out = now.withColumn("generation", F.lit(0))
    for g in range(1, generations + 1):
        spread = now.agg(F.stddev_pop("loss"), F.avg("loss")).first()
        if spread[0] <= tolerance * abs(spread[1]):
            break
        row = now.agg(F.collect_list(F.struct("id", *names, "loss")).alias("all"))  # one row, as long as the population
        others = F.filter("all", lambda c: c["id"] != F.col("id"))
        order = F.array_sort(F.transform(others, lambda c: F.struct(F.xxhash64(c["id"], F.col("id"), F.lit(seed), F.lit(g)).alias("h"), c.alias("c"))))
        best = F.array_min(F.transform("all", lambda c: F.struct(c["loss"].alias("loss"), c["id"].alias("id"), c.alias("c"))))["c"]
        picked = now.select("id", *names, "loss").join(F.broadcast(row)).withColumn("_o", order).withColumn("_best", best)
        a, b, c = (F.col("_o")[k]["c"] for k in range(3))
        base = lambda name: F.when(F.col("id") % 2 == 0, F.col("_best")[name]).otherwise(a[name])  # noqa: E731, B023
        sure = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(g), F.lit("sure")), F.lit(len(names)))
        trial = []
        for k, name in enumerate(names):
            parts = (F.col("id"), F.lit(seed), F.lit(g))
            moved = inside(base(name) + scale * (b[name] - c[name]), name, *parts)
            trial.append(F.when((sure == k) | (uniform(*parts, F.lit(name)) < crossover), moved).otherwise(F.col(name)).alias(f"_{name}"))
        trials = materialise(picked.select("id", *names, "loss", *trial))
        tried = objective(trials.select("id", *(F.col(f"_{n}").alias(n) for n in names))).withColumnRenamed("loss", "_loss")
        both = trials.join(tried, "id")
        better = F.col("_loss") <= F.col("loss")
        now = materialise(both.select("id", *(F.when(better, F.col(f"_{n}")).otherwise(F.col(n)).alias(n) for n in names), F.least("loss", "_loss").alias("loss")))
        out = out.unionByName(now.withColumn("generation", F.lit(g)))
        forget(trials)
    return out.select("generation", "id", *names, "loss")


def best(history: DataFrame) -> DataFrame:
    """One row: the candidate of the least loss, ties to the smaller id, and the generation that it survived last."""
    last = history.agg(F.max("generation").alias("generation"))
    return history.join(F.broadcast(last), "generation").orderBy("loss", "id").limit(1)
