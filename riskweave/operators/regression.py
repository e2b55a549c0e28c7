"""Regressions whose data stay in place: normal equations are summed in one pass, and only matrices of features by features are solved.

A Gram matrix here is of the columns 1, features, target. From it follow fits, errors and R2 of any linear model on its rows, so folds, penalties and groups of features
left out cost no further pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.scratch import forget, materialise


def grams(rows: DataFrame, block: str, features: list[str], target: str) -> DataFrame:
    """(block, pos, v): cells of each block's Gram matrix, row by row, in one pass; rows with a null or a value that isn't finite are left out.

    A task sums each batch by block before anything is shuffled.
    """
    names = [*features, target]
    kind = dict(rows.dtypes)[block]

    def run(frames):
        for frame in frames:
            x = frame[names].to_numpy(dtype=float)
            whole = np.isfinite(x).all(1)
            for b, part in frame[whole].groupby(block)[block]:
                z = np.hstack([np.ones((len(part), 1)), frame.loc[part.index, names].to_numpy(dtype=float)])
                yield pd.DataFrame({block: [b], "m": [(z.T @ z).ravel()]})

    parts = rows.select(block, *(F.col(c).cast("double").alias(c) for c in names)).where(F.col(block).isNotNull()).mapInPandas(run, f"{block} {kind}, m array<double>")
    return parts.select(block, F.posexplode("m").alias("pos", "v")).groupBy(block, "pos").agg(F.sum("v").alias("v"))


def fold_grams(cells: DataFrame, block: str, folds: DataFrame) -> DataFrame:
    """(fold, pos, train, test): Gram matrices of the rows that each of ``folds`` (fold, train_end, test_start, test_end; ends exclusive) is trained and tested on, as sums over blocks.

    ``block`` numbers runs of rows in order, and folds begin and end with blocks; both are few. A fold whose ``train_end`` is null is trained on all but its test blocks.
    """
    b = F.col(block)
    test = (b >= F.col("test_start")) & (b < F.col("test_end"))
    train = F.when(F.col("train_end").isNull(), ~test).otherwise(b < F.col("train_end"))
    total = lambda where, name: F.sum(F.when(where, F.col("v")).otherwise(0.0)).alias(name)
    return cells.join(F.broadcast(folds)).groupBy("fold", "pos").agg(total(train, "train"), total(test, "test"))


def _ridge(g: np.ndarray, penalty: float) -> np.ndarray | None:
    """Intercept and weights from a Gram matrix; the penalty is on features in units of their deviation, times the number of rows, and features without any have weight 0."""
    n = g[0, 0]
    if n <= 0:
        return None
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(cov)[:-1]
    live = var > 1e-12 * np.maximum(np.diag(g)[1:-1] / n, 1e-300)
    sd = np.sqrt(np.where(live, var, 1.0))
    a = (cov[:-1, :-1] / sd[:, None] / sd)[np.ix_(live, live)]
    w = np.zeros(len(sd))
    w[live] = np.linalg.lstsq(a + penalty * np.eye(live.sum()), (cov[:-1, -1] / sd)[live], rcond=None)[0]
    w = w / sd
    return np.append(mean[-1] - mean[:-1] @ w, w)


def _scores(g: np.ndarray, beta: np.ndarray) -> tuple[float, float, float]:
    """Number of rows, mean squared error and R2 of a linear model on the rows of a Gram matrix."""
    n = g[0, 0]
    if n <= 0:
        return 0.0, np.nan, np.nan
    e = np.append(beta, -1.0)
    mse = max(float(e @ g @ e) / n, 0.0)
    spread = g[-1, -1] / n - (g[0, -1] / n) ** 2
    return n, mse, 1 - mse / spread if spread > 0 else np.nan


def ridge_folds(cells: DataFrame, features: list[str], penalties: list[float]) -> DataFrame:
    """(fold, penalty, n, mse, r2, train_r2, beta) of a ridge for each fold of ``fold_grams`` and each penalty; a task solves the small matrices of one fold."""
    p = len(features) + 2
    kind = dict(cells.dtypes)["fold"]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        train, test = (group[c].to_numpy().reshape(p, p) for c in ("train", "test"))
        out = []
        for penalty in penalties:
            beta = _ridge(train, penalty)
            if beta is not None:
                n, mse, r2 = _scores(test, beta)
                out.append((group["fold"].iloc[0], penalty, int(round(n)), mse, r2, _scores(train, beta)[2], beta.tolist()))
        return pd.DataFrame(out, columns=["fold", "penalty", "n", "mse", "r2", "train_r2", "beta"])

    return cells.groupBy("fold").applyInPandas(solve, f"fold {kind}, penalty double, n long, mse double, r2 double, train_r2 double, beta array<double>")


def group_ablation(cells: DataFrame, fits: DataFrame, features: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """(fold, dropped, r2, drop, importance): R2 of each fold's fit (fold, beta) on its test rows when the features of a group are set to zero; importance is the drop over R2, at least 0.01."""
    p = len(features) + 2
    kind = dict(cells.dtypes)["fold"]
    rows = cells.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("pos", "test"))).alias("cells")).join(fits.select("fold", "beta"), "fold")
    rows = rows.select("fold", F.col("cells.test").alias("test"), "beta")

    def run(frames):
        for frame in frames:
            out = []
            for fold, test, beta in frame.itertuples(index=False):
                g, beta = np.asarray(test).reshape(p, p), np.asarray(beta)
                base = _scores(g, beta)[2]
                for name, held in groups.items():
                    r2 = _scores(g, np.append(beta[:1], np.where(np.isin(features, held), 0.0, beta[1:])))[2]
                    out.append((fold, name, r2, base - r2, (base - r2) / max(base, 0.01)))
            yield pd.DataFrame(out, columns=["fold", "dropped", "r2", "drop", "importance"])

    return rows.mapInPandas(run, f"fold {kind}, dropped string, r2 double, drop double, importance double")


def permuted(rows: DataFrame, fold: str, key: str, features: list[str], repeats: int, seed: int = 42, bucket: int = 4096) -> DataFrame:
    """(fold, key, feature, repeat, value): every feature's values dealt anew among the rows of their fold, all features and repeats at once.

    Rows fall into buckets by a hash of key, feature and repeat, of about ``bucket`` rows each; in a bucket a row takes the value of the one that stands at its place in the order of a second hash. So no
    window holds a whole fold, and results depend on keys alone. Keys are told apart within a fold.
    """
    size = rows.groupBy(fold).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / bucket)).cast("long").alias("_buckets"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))).alias("_f")
    long = rows.select(fold, key, each).select(fold, key, "_f.*").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = lambda salt: F.xxhash64(F.col(key), F.col("feature"), F.col("repeat"), F.lit(seed), F.lit(salt))
    long = long.join(size, fold).withColumn("_bucket", F.pmod(hashed(0), F.col("_buckets")))
    own = [fold, "feature", "repeat", "_bucket"]
    place = lambda salt: F.row_number().over(Window.partitionBy(*own).orderBy(hashed(salt), key))
    long = materialise(long.select(*own, key, "value", place(1).alias("_at"), place(2).alias("_from")))
    taken = long.select(*own, F.col("_from").alias("_at"), F.col("value").alias("_new"))
    return long.join(taken, [*own, "_at"]).select(fold, key, "feature", "repeat", F.col("_new").alias("value"))


def permutation_importance(rows: DataFrame, fold: str, key: str, features: list[str], target: str, fits: DataFrame, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance, sd, rank): mean drop of R2 over folds and repeats when a feature's values are dealt anew among the test rows, without fitting again.

    ``rows`` (fold, key, features, target) are test rows and ``fits`` (fold, beta) linear models; a row's forecast moves by its weight times the change of its value. Ties go to the smaller name.
    """
    beta = fits.select(fold, F.col("beta").alias("_beta"))
    forecast = sum((F.col("_beta")[k + 1] * F.col(f) for k, f in enumerate(features)), F.col("_beta")[0])
    scored = materialise(rows.select(fold, key, *features, F.col(target).alias("_y")).join(beta, fold).withColumn("_p", forecast))
    spread = scored.groupBy(fold).agg(F.var_pop("_y").alias("_v"), F.avg(F.pow(F.col("_y") - F.col("_p"), F.lit(2))).alias("_mse")).where("_v > 0")
    weight = F.create_map(*(x for k, f in enumerate(features) for x in (F.lit(f), F.lit(k + 1))))
    own = F.create_map(*(x for f in features for x in (F.lit(f), F.col(f).cast("double"))))
    moved = permuted(rows, fold, key, features, repeats, seed).join(scored, [fold, key])
    p = F.col("_p") + F.element_at(F.col("_beta"), weight[F.col("feature")] + 1) * (F.col("value") - own[F.col("feature")])
    each = moved.groupBy(fold, "feature", "repeat").agg(F.avg(F.pow(F.col("_y") - p, F.lit(2))).alias("_new")).join(spread, fold)
    drop = each.select("feature", ((F.col("_new") - F.col("_mse")) / F.col("_v")).alias("drop"))
    out = drop.groupBy("feature").agg(F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("sd"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "feature")))


def quantile_fit(rows: DataFrame, features: list[str], target: str, quantiles: list[float], rounds: int = 200, tolerance: float = 1e-4) -> dict[float, list[float]]:
    """Intercept and weights by quantile: the pinball loss, smoothed, minimised by iteratively reweighted normal equations (Hunter and Lange, 2000).

    A round is one pass that sums the equations of all quantiles; the driver solves systems as large as there are features. Smoothing shrinks
    from a tenth of the target's deviation to 1e-4 of it. Rows with a null or a value that isn't finite are left out; an empty table gives no fit.
    """
    names = [*features, target]
    held = rows.select(*(F.col(c).cast("double").alias(c) for c in names)).where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) < double('infinity')" for c in names))
    held = materialise(held)
    stats = held.agg(*(f(c).alias(f"{k}_{j}") for j, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if stats["m_0"] is None:
        return {}
    mean = np.array([stats[f"m_{j}"] for j in range(len(names))])
    sd = np.array([stats[f"s_{j}"] or 1.0 for j in range(len(names))])
    p, taus = len(features) + 1, np.array(quantiles, dtype=float)
    beta = np.zeros((len(taus), p))
    smooth, done = 0.1, False
    spark = held.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((beta, smooth))

        def run(frames, shared=shared):
            b, eps = shared.value
            total = np.zeros((len(taus), p, p + 1))
            for frame in frames:
                z = (frame.to_numpy(dtype=float) - mean) / sd
                x, y = np.hstack([np.ones((len(z), 1)), z[:, :-1]]), z[:, -1]
                for k, tau in enumerate(taus):
                    w = 1 / (eps + np.abs(y - x @ b[k]))
                    xw = x * w[:, None]
                    total[k, :, :p] += xw.T @ x
                    total[k, :, p] += xw.T @ y + (2 * tau - 1) * x.sum(0)
            yield pd.DataFrame({"v": [total.ravel()]})

        cells = held.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).toPandas().sort_values("pos")["v"].to_numpy()
        shared.unpersist()
        system = cells.reshape(len(taus), p, p + 1)
        new = np.stack([np.linalg.lstsq(s[:, :p], s[:, p], rcond=None)[0] for s in system])
        change, beta = np.abs(new - beta).max(), new
        if done and change < tolerance:
            break
        if change < max(tolerance, smooth / 10):
            done, smooth = smooth <= 1e-4, max(smooth / 10, 1e-4)
    forget(held)
    weights = beta[:, 1:] / sd[:-1] * sd[-1]
    base = mean[-1] + beta[:, 0] * sd[-1] - weights @ mean[:-1]
    return {float(t): [float(b), *map(float, w)] for t, b, w in zip(taus, base, weights, strict=True)}


def quantile_forecasts(rows: DataFrame, features: list[str], fit: dict[float, list[float]], out: str = "quantiles") -> DataFrame:
    """``rows`` with an array of forecasts, by ascending quantile; they are sorted by row, so quantiles never cross (Chernozhukov, Fernández-Val and Galichon, 2010)."""
    each = [sum((F.lit(w) * F.col(f) for w, f in zip(b[1:], features, strict=True)), F.lit(b[0])) for _, b in sorted(fit.items())]
    return rows.withColumn(out, F.sort_array(F.array(*each)))
