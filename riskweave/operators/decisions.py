"""Decisions and dynamics of single banks, as column expressions over bank and pair rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import clip

#: Fixed values of the responses: most that is cut, and the change that cuts all of it; share of assets sought.
CAPITAL_CUT, CAPITAL_SCALE = 0.8, 10.0
LIQUIDITY_CUT, LIQUIDITY_SCALE = 0.9, 50.0
SOUGHT = 0.05
STRESS_GAIN = 1.5
STRESS_MOOD = 0.3
LEARNING_RATE = 0.1
MEMORY = 10


def shock_response(rows: DataFrame, stressed: bool = False) -> DataFrame:
    """``capital_cut``, ``liquidity_cut`` (null where the ratio didn't fall) and ``sought`` from d_cet1, d_lcr and total_assets; stressed banks cut half as much again."""

    def cut(c: str, most: float, scale: float) -> Column:
        share = F.least(F.lit(most), F.abs(F.col(c)) / scale)
        return F.when(F.col(c) < 0, F.least(F.lit(1.0), share * STRESS_GAIN) if stressed else share)

    return rows.withColumns({
        "capital_cut": cut("d_cet1", CAPITAL_CUT, CAPITAL_SCALE),
        "liquidity_cut": cut("d_lcr", LIQUIDITY_CUT, LIQUIDITY_SCALE),
        "sought": F.when(F.col("d_lcr") < 0, F.col("total_assets") * SOUGHT),
    })


def stressed_offers(offers: DataFrame, mood: float) -> DataFrame:
    """Offers of banks under stress: none in a mood under STRESS_MOOD, else once more in proportion to it."""
    return offers.where(F.lit(mood >= STRESS_MOOD)).withColumn("offer", F.col("offer") * mood)


def interaction_scores(outcomes: DataFrame, rate: float = LEARNING_RATE) -> DataFrame:
    """(lender, borrower, score): the moving average of a pair's outcomes in the order of ``at``, from 0."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be over 0 and at most 1")
    # (1 - rate)^(later outcomes) is the weight that an outcome has left, so that a sum says what folding would
    after = F.count(F.lit(1)).over(Window.partitionBy("lender", "borrower").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    rows = outcomes.withColumn("w", F.pow(F.lit(1 - rate), F.coalesce(after, F.lit(0))) * rate)
    return rows.groupBy("lender", "borrower").agg(F.sum(F.col("w") * F.col("outcome")).alias("score"))


def learned_offers(offers: DataFrame, scores: DataFrame) -> DataFrame:
    """Offers in proportion to one plus the pair's score (0 if unknown); those that fall to nothing go."""
    out = offers.join(scores, ["lender", "borrower"], "left").withColumn("offer", F.col("offer") * (1 + F.coalesce("score", F.lit(0.0))))
    return out.where("offer > 0").select("lender", "borrower", "offer")


def with_connections(exposures: DataFrame, amounts: DataFrame) -> DataFrame:
    """(source, target, weight): an amount lent takes the place of the weight there was."""
    new = amounts.select(F.col("lender").alias("source"), F.col("borrower").alias("target"), "amount")
    out = exposures.join(new, ["source", "target"], "full")
    return out.select("source", "target", F.coalesce("amount", "weight").alias("weight"))


def connection_strength(pairs: DataFrame, exposures: DataFrame) -> DataFrame:
    """``pairs`` (source, target) with ``weight``, 0 where there is no connection."""
    return pairs.join(exposures.select("source", "target", "weight"), ["source", "target"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def frozen(state: DataFrame, defaulted: DataFrame) -> DataFrame:
    """``state`` with ``frozen``: true for the banks in ``defaulted``."""
    return state.join(defaulted.select("bank").distinct().withColumn("frozen", F.lit(True)), "bank", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))


def remembered(states: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``states`` with ``memory``: the MEMORY latest values up to and with each row."""
    return states.withColumn("memory", F.collect_list(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(1 - MEMORY, 0)))


def jump_step(x: Column, mean: Column, z: Column, jumps: Column, pull: float = 0.05, spread: float = 0.25, low: float = 0.0, high: float = 30.0) -> Column:
    """One step of mean reversion with noise ``z`` and the sum ``jumps`` of its jumps."""
    return clip(x + pull * (mean - x) + spread * z + jumps, low, high)


def poisson(u: Column, rate: Column, most: int = 12) -> Column:
    """The Poisson number whose distribution function first reaches ``u``, from 0 to ``most``."""
    return F.transform(F.array(F.struct(u.alias("u"), rate.alias("rate"))), lambda c: _poisson(c, most))[0]


def _poisson(c: Column, most: int) -> Column:
    first = F.exp(-c["rate"])
    start = F.struct(F.lit(0).alias("n"), first.alias("p"), first.alias("f"))

    def more(a: Column, k: Column) -> Column:
        p = a["p"] * c["rate"] / k
        return F.when(a["f"] < c["u"], F.struct(k.alias("n"), p.alias("p"), (a["f"] + p).alias("f"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, more, lambda a: a["n"])


def next_regime(regime: Column, u: Column, stress: float = 0.0, to_crisis: float = 0.01, to_calm: float = 0.05) -> Column:
    """0 (calm) or 1 (crisis) after a step: stress makes crises likelier and longer."""
    return F.when(regime == 0, (u < to_crisis * (1 + 3 * stress)).cast("int")).otherwise(1 - (u < max(0.001, to_calm * (1 - 0.5 * stress))).cast("int"))


def regime_step(x: Column, mean: Column, z: Column, regime: Column, pull=(0.08, 0.02), spread=(0.15, 0.6), low: float = 0.0, high: float = 30.0) -> Column:
    a, s = F.when(regime == 0, pull[0]).otherwise(pull[1]), F.when(regime == 0, spread[0]).otherwise(spread[1])
    return clip(x + a * (mean - x) + s * z, low, high)


def slowed_step(x: Column, mean: Column, z: Column, stress: float = 0.0, pull: float = 0.05, spread: float = 0.25, threshold: float = 8.0, slowdown: float = 0.3, low: float = 0.0, high: float = 30.0) -> Column:
    """A step in which banks below the threshold recover the slower the further they are below it."""
    weak = pull * (slowdown + (1 - slowdown) * (1 - (threshold - x) / threshold))
    a = F.when(x < threshold, weak).otherwise(F.lit(pull)) * (1 - 0.5 * stress)
    return clip(x + a * (mean - x) + spread * z, low, high)
