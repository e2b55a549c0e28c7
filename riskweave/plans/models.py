"""Queries over models of a bank's next move: folds, features left out and dealt anew, quantiles, and a calibrated cascade."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.columns import rounded
from riskweave.operators import calibration as cal, regression as reg, timeseries as ts
from riskweave.plans.catalog import register
from riskweave.sources import views as v
from riskweave.sources.scratch import materialise

FEATURES = ["vol", "mean", "growth", "beta", "momentum", "r", "r1", "r2", "m"]
GROUPS = {"volatility": ["vol"], "trend": ["mean", "growth", "momentum"], "market": ["beta", "m"], "returns": ["r", "r1", "r2"]}


def _rows(s, d):
    """(bank, d, block, key, features, y): what was known of each bank by month, and its return in the month after; ``block`` numbers quarters of the whole span."""
    returns = materialise(v.ret(s, d))  # read by all that follows
    w = Window.partitionBy("bank").orderBy("d")
    lagged = returns.select("bank", "d", "r", F.lag("r", 1).over(w).alias("r1"), F.lag("r", 2).over(w).alias("r2"), F.lead("r").over(w).alias("y"))
    rows = lagged.join(ts.node_features(returns, 12, short=3), ["bank", "d"]).join(ts.market(returns), "d").where("y IS NOT NULL AND r2 IS NOT NULL")
    first = F.broadcast(rows.agg(F.min("d").alias("_first")))  # one row
    block = F.floor(F.months_between("d", "_first") / 3).cast("int")
    return rows.join(first).withColumn("block", block).withColumn("key", F.col("bank") * 10_000 + F.months_between("d", F.lit("1900-01-01")).cast("long")).drop("_first")


def _folds(rows):
    """Five folds that train on all quarters before a gap of one and are tested on the three that follow."""
    last = rows.agg((F.max("block") + 1).alias("n"))
    at = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold")
    folds = last.select(at, "n").withColumn("test_start", F.floor(F.col("n") / 4 + F.col("fold") * (F.col("n") * 3 / 4 - 3) / 4).cast("int"))
    return folds.select("fold", (F.col("test_start") - 1).alias("train_end"), "test_start", (F.col("test_start") + 3).alias("test_end"))


def _fitted(s, d, penalties):
    rows = materialise(_rows(s, d))
    folds = materialise(_folds(rows))
    cells = materialise(reg.fold_grams(reg.grams(rows, "block", FEATURES, "y"), "block", folds))
    return rows, folds, cells, materialise(reg.ridge_folds(cells, FEATURES, penalties))


@register("ridge_walk_forward")
def ridge_walk_forward(s, d):
    """Walk-forward errors of a ridge, by penalty, from one pass over the rows."""
    return rounded(_fitted(s, d, [0.0, 0.01, 0.1, 1.0, 10.0])[3].drop("beta"), "mse", "r2", "train_r2")


@register("feature_ablation")
def feature_ablation(s, d):
    _, _, cells, fits = _fitted(s, d, [0.1])
    return rounded(reg.group_ablation(cells, fits, FEATURES, GROUPS), "r2", "drop", "importance")


@register("permutation_importance")
def permutation_importance(s, d):
    rows, folds, _, fits = _fitted(s, d, [0.1])
    test = rows.join(F.broadcast(folds), (F.col("block") >= F.col("test_start")) & (F.col("block") < F.col("test_end")))
    return rounded(reg.permutation_importance(test, "fold", "key", FEATURES, "y", fits), "importance", "sd")


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


@register("quantile_regression")
def quantile_regression(s, d):
    """Share of next returns at or below each quantile's forecast, mean forecast and pinball loss; by halves of time, fitted on the first."""
    rows = materialise(_rows(s, d))
    half = F.broadcast(rows.agg(F.percentile("block", 0.5).alias("_half")))
    rows = materialise(rows.join(half).withColumn("fitted", F.col("block") <= F.col("_half")))
    names = ["vol", "momentum", "r", "m"]
    fit = reg.quantile_fit(rows.where("fitted"), names, "y", QUANTILES)
    out = reg.quantile_forecasts(rows, names, fit).select("fitted", "y", F.posexplode("quantiles").alias("place", "forecast"))
    tau = F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("place") + 1)
    e = F.col("y") - F.col("forecast")
    rows = out.withColumn("quantile", tau).groupBy("fitted", "quantile").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y") <= F.col("forecast")).cast("double")).alias("coverage"), F.avg("forecast").alias("forecast"), F.avg(F.greatest(F.col("quantile") * e, (F.col("quantile") - 1) * e)).alias("pinball"),
    )
    return rounded(rows, "coverage", "forecast", "pinball", digits=4)


@register("calibrated_cascade")
def calibrated_cascade(s, d):
    """Shock and loss given default under which cascades end with the share of failures and the mean ratio seen where last month's returns were negative; all generations."""
    state = materialise(v.bank_state(s, d))
    loans = materialise(v.latest_exposure(s, d))
    returns = materialise(v.ret(s, d))
    last = F.broadcast(returns.agg(F.max("d").alias("d")))
    seen = returns.join(last, "d").join(state.select("bank", "cet1"), "bank")
    goal = seen.agg(F.avg((F.col("r") < -0.3).cast("double")), F.avg(F.col("cet1") * (1 + F.least("r", F.lit(0.0))))).first()
    targets = {"defaults": goal[0] or 0.0, "mean_cet1": goal[1] or 0.0}
    objective = lambda c: cal.loss(cal.cascade_metrics(c, state, loans, 5), targets)
    found = cal.evolve(s, {"shock": (0.0, 8.0), "spread": (0.0, 4.0), "lgd": (0.0, 1.0)}, objective, population=10, generations=6)
    return rounded(found, "shock", "spread", "lgd", "loss", digits=5)
