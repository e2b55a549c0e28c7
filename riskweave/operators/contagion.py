"""Contagion between banks: decisions, matching, and the three channels of loss.

State is one row a bank (and run), exposures are (source, target, weight): the source has
lent to the target. Each round of a cascade is a join and an aggregation over the
newly defaulted only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import clip
from riskweave.sources.scratch import materialise

#: Fixed values of the channels and decisions.
LOSS_GIVEN_DEFAULT = 0.40
EQUITY_SHARE = 0.35
FUNDING_LEVEL, FUNDING_SENSITIVITY, FUNDING_RATE = 100.0, 0.05, 0.03
HAIRCUT, AMPLIFIER, HAIRCUT_CAP = 0.02, 1.5, 0.15
SOLVENT, LIQUID = 4.5, 100.0
#: (pull to the mean, spread, least, most) of the ratios.
DYNAMICS = {"cet1": (0.05, 0.25, 0.0, 30.0), "lcr": (0.04, 1.5, 20.0, 300.0), "nsfr": (0.04, 0.8, 30.0, 250.0)}


def solvent(cet1: Column) -> Column:
    return F.coalesce(cet1 >= SOLVENT, F.lit(True))


def liquid(lcr: Column) -> Column:
    return F.coalesce(lcr >= LIQUID, F.lit(True))


def lending_capacity(state: DataFrame) -> DataFrame:
    """``capacity``: a tenth of assets, more with liquidity and capital to spare."""
    return state.withColumn(
        "capacity",
        0.1 * F.col("total_assets") * (1 + F.greatest(F.lit(0.0), F.col("lcr") - 100) / 100) * (1 + F.greatest(F.lit(0.0), F.col("cet1") - 8) / 4),
    )


def lending_offers(state: DataFrame, exposures: DataFrame, mood: float) -> DataFrame:
    """(lender, borrower, offer): liquid banks to counterparties with CET1 of at least 6. ``decisions.stressed_offers`` says what banks under stress do."""
    a = lending_capacity(state).where(liquid(F.col("lcr"))).select(F.col("bank").alias("lender"), "capacity")
    b = state.where("cet1 >= 6").select(F.col("bank").alias("borrower"), "cet1")
    rows = exposures.select(F.col("source").alias("lender"), F.col("target").alias("borrower"), "weight").join(a, "lender").join(b, "borrower")
    return rows.select("lender", "borrower", (F.col("capacity") * mood * 0.1 * (1 + 2 * F.col("weight")) * F.least(F.lit(1.0), F.col("cet1") / 15)).alias("offer"))


def borrowing_requests(state: DataFrame, exposures: DataFrame, mood: float) -> DataFrame:
    """(lender, borrower, request): banks with LCR up to 120 from counterparties with LCR of at least 110."""
    need = state.where("lcr <= 120").select(F.col("bank").alias("borrower"), ((120 - F.col("lcr")) * F.col("total_assets") * 0.1 / 100 * (2 - mood)).alias("need"))
    lend = state.where("lcr >= 110").select(F.col("bank").alias("lender"), F.col("lcr").alias("lender_lcr"))
    rows = exposures.select(F.col("source").alias("lender"), F.col("target").alias("borrower"), "weight").join(need, "borrower").join(lend, "lender")
    return rows.select("lender", "borrower", (F.col("need") * 0.2 * (1 + F.col("weight")) * F.least(F.lit(1.0), F.col("lender_lcr") / 150)).alias("request"))


def matched(offers: DataFrame, requests: DataFrame, state: DataFrame) -> DataFrame:
    """(lender, borrower, amount): the lesser of offer and request, by borrower until the lender's cash is gone."""
    both = offers.join(requests, ["lender", "borrower"]).join(state.select(F.col("bank").alias("lender"), "cash"), "lender")
    both = both.withColumn("want", F.least("offer", "request"))
    before = F.coalesce(F.sum("want").over(Window.partitionBy("lender").orderBy("borrower").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return both.select("lender", "borrower", F.greatest(F.lit(0.0), F.least(F.col("want"), F.col("cash") - before)).alias("amount")).where("amount > 0")


def shocked(state: DataFrame, shocks: DataFrame) -> DataFrame:
    """Additive changes of (bank, d_cet1, d_lcr); banks without a shock stay, shocks of unknown banks go."""
    out = state.join(shocks, "bank", "left")
    return out.withColumns({"cet1": F.col("cet1") + F.coalesce("d_cet1", F.lit(0.0)), "lcr": F.col("lcr") + F.coalesce("d_lcr", F.lit(0.0))}).drop("d_cet1", "d_lcr")


def credit_losses(state: DataFrame, exposures: DataFrame, defaulted: DataFrame) -> DataFrame:
    """The state after losses on loans to ``defaulted`` (bank), summed and capped by interbank assets once a round."""
    loss = exposures.join(defaulted.select(F.col("bank").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("bank")).agg(F.sum(F.col("weight") * LOSS_GIVEN_DEFAULT).alias("loss"))
    out = state.join(loss, "bank", "left").withColumn("loss", F.least(F.coalesce("loss", F.lit(0.0)), F.col("interbank_assets")))
    return out.withColumns({
        "interbank_assets": F.col("interbank_assets") - F.col("loss"),
        "cet1": F.col("cet1") - F.col("loss") / (EQUITY_SHARE * F.col("total_assets")) * 100,
        "cash": F.col("cash") - 0.1 * F.col("loss"),
    })


def cascade(state: DataFrame, exposures: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The state after all rounds of credit losses, with ``defaulted`` and its ``round`` (0: before any loss)."""
    now = materialise(state.withColumn("round", F.when((F.col("cet1") < 0) | (F.col("cash") < 0), 0).cast("int")))
    exposures = materialise(exposures)
    for k in range(1, max_rounds + 1):
        new = now.where(F.col("round") == k - 1).select("bank")
        if new.isEmpty():
            break
        hit = credit_losses(now, exposures, new).drop("loss")
        now = materialise(hit.withColumn("round", F.when(F.col("round").isNull() & ((F.col("cet1") < 0) | (F.col("cash") < 0)), k).otherwise(F.col("round"))))
    else:
        if not now.where(F.col("round") == max_rounds).isEmpty():
            raise RuntimeError(f"the cascade did not end in {max_rounds} rounds")
    return now.withColumn("defaulted", F.col("round").isNotNull())


def fire_sale(state: DataFrame, exposures: DataFrame, defaulted: DataFrame, banks: int) -> DataFrame:
    """The state after a haircut for ties to defaulted banks, amplified by their number and capped."""
    count = defaulted.agg(F.count(F.lit(1)).alias("nd"))
    ties = exposures.join(defaulted.select(F.col("bank").alias("target")), "target", "left_semi").groupBy(F.col("source").alias("bank")).agg(F.sum("weight").alias("ties"))
    amp = 1 + F.greatest(F.col("nd") - 1, F.lit(0)) * (AMPLIFIER - 1) / max(banks - 1, 1)
    out = state.join(ties, "bank", "left").join(F.broadcast(count))
    out = out.withColumn("haircut", F.least(F.lit(HAIRCUT_CAP), F.coalesce("ties", F.lit(0.0)) * HAIRCUT * amp))
    return out.withColumns({"cet1": F.col("cet1") - F.col("haircut") * 100 * 0.1, "total_assets": F.col("total_assets") * (1 - F.col("haircut"))}).drop("ties", "nd")


def reverting(x: Column, mean: Column, ratio: str, steps: int) -> Column:
    """The ratio after ``steps`` without noise, inside its bounds."""
    pull, _, low, high = DYNAMICS[ratio]
    return clip(mean + (x - mean) * (1 - pull) ** steps, low, high)


def simulate(state: DataFrame, exposures: DataFrame, runs: int, steps: int, shock: float = 0.0, seed: int = 0) -> DataFrame:
    """(run, step, defaults, mean_cet1, mean_lcr): Monte Carlo runs, each a row of the plan and a seed of its own.

    Every run holds the whole network, which is small; runs are spread over tasks.
    """
    if steps <= 0:
        raise ValueError("steps must be positive")
    spark = state.sparkSession
    banks = state.select("bank", "cet1", "lcr", "nsfr", "total_assets", "cash", "interbank_assets").orderBy("bank").toPandas()
    place = {b: k for k, b in enumerate(banks["bank"])}
    w = np.zeros((len(banks), len(banks)))
    for r in exposures.collect():
        if r["source"] in place and r["target"] in place:
            w[place[r["source"]], place[r["target"]]] += r["weight"]
    start = banks.drop(columns="bank").to_numpy(dtype=float)

    def go(frames):
        for frame in frames:
            out = []
            for run in frame["id"]:
                rng = np.random.default_rng([seed, int(run)])
                x = start.copy()
                x[:, 0] -= shock
                mean, dead = start[:, :3].copy(), np.zeros(len(x), dtype=bool)
                for step in range(steps):
                    for k, (pull, spread, low, high) in enumerate(DYNAMICS.values()):
                        x[:, k] = np.clip(x[:, k] + pull * (mean[:, k] - x[:, k]) + spread * rng.standard_normal(len(x)), low - 100 * (k == 0), high)
                    while True:
                        new = ~dead & ((x[:, 0] < 0) | (x[:, 4] < 0))
                        if not new.any():
                            break
                        dead |= new
                        loss = np.minimum(w[:, new].sum(1) * LOSS_GIVEN_DEFAULT, x[:, 5])
                        x[:, 5] -= loss
                        x[:, 0] -= loss / (EQUITY_SHARE * x[:, 3]) * 100
                        x[:, 4] -= 0.1 * loss
                    gap = np.maximum(FUNDING_LEVEL - x[:, 1], 0)
                    run_on = (rng.random(w.shape) < 1 / (1 + np.exp(-FUNDING_SENSITIVITY * gap))[None, :]) & (gap > 0)[None, :]
                    pulled = (run_on * w).sum(0) * FUNDING_RATE
                    x[:, 4] -= pulled
                    x[:, 1] -= pulled / np.maximum(x[:, 3], 1e-9) * 100
                    if dead.any():
                        amp = 1 + (dead.sum() - 1) * (AMPLIFIER - 1) / max(len(x) - 1, 1)
                        cut = np.minimum(HAIRCUT_CAP, w[:, dead].sum(1) * HAIRCUT * amp)
                        x[:, 0] -= cut * 10
                        x[:, 3] *= 1 - cut
                    out.append((int(run), step, int(dead.sum()), float(x[:, 0].mean()), float(x[:, 1].mean())))
            yield pd.DataFrame(out, columns=["run", "step", "defaults", "mean_cet1", "mean_lcr"])

    return spark.range(runs).repartition(min(runs, 64)).mapInPandas(go, "run long, step long, defaults long, mean_cet1 double, mean_lcr double")
