"""Ridge folds, ablation, permutation importance, quantiles, calibration and resampling against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import calibration as cal, ranks, regression as reg, resampling, stats, validation

R = np.random.default_rng(4)
N, NAMES = 600, ["a", "b", "c", "noise"]
X = R.normal(size=(N, 4)) * [1.0, 5.0, 0.2, 1.0] + [0, 10, 0, 0]
Y = 2 * X[:, 0] - 0.3 * X[:, 1] + 4 * X[:, 2] + R.normal(size=N)


@pytest.fixture(scope="module")
def rows(spark):
    held = [(i, i // 60, *map(float, X[i]), float(Y[i])) for i in range(N)] + [(N, 3, None, 1.0, 1.0, 1.0, 1.0), (N + 1, 3, math.nan, 1.0, 1.0, 1.0, 1.0), (N + 2, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(held, "i long, block int, a double, b double, c double, noise double, y double").repartition(7).cache()


def refit(train, test, penalty):
    mean, sd = X[train].mean(0), X[train].std(0)
    z = (X[train] - mean) / sd
    w = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(4), z.T @ (Y[train] - Y[train].mean()) / len(z)) / sd
    p = Y[train].mean() + (X[test] - mean) @ w
    mse = ((Y[test] - p) ** 2).mean()
    return w, mse, 1 - mse / Y[test].var()


FOLDS = [(0, 4, 5, 7), (1, 6, 7, 10), (2, None, 2, 4)]


@pytest.fixture(scope="module")
def solved(spark, rows):
    folds = spark.createDataFrame(FOLDS, "fold int, train_end int, test_start int, test_end int")
    cells = reg.fold_grams(reg.grams(rows, "block", NAMES, "y"), "block", folds).cache()
    return cells, reg.ridge_folds(cells, NAMES, [0.0, 0.5]).cache()


def places(train_end, start, end):
    block = np.arange(N) // 60
    test = (block >= start) & (block < end)
    return (~test if train_end is None else block < train_end), test


def test_ridge_by_folds_is_a_refit(solved):
    got = {(r["fold"], r["penalty"]): r for r in solved[1].collect()}
    for (fold, *ends), penalty in itertools.product(FOLDS, (0.0, 0.5)):
        train, test = places(*ends)
        w, mse, r2 = refit(train, test, penalty)
        r = got[fold, penalty]
        assert r["beta"][1:] == pytest.approx(list(w), abs=1e-8) and r["n"] == test.sum()
        assert (r["mse"], r["r2"]) == pytest.approx((mse, r2), abs=1e-8)


def test_ablation_of_groups(solved):
    cells, fits = solved
    fits = fits.where("penalty = 0")
    got = {(r["fold"], r["dropped"]): r for r in reg.group_ablation(cells, fits, NAMES, {"first": ["a", "b"], "noise": ["noise"]}).collect()}
    beta = {r["fold"]: np.array(r["beta"]) for r in fits.collect()}
    for fold, *ends in FOLDS:
        test = places(*ends)[1]
        for name, keep in (("first", [0, 0, 1, 1]), ("noise", [1, 1, 1, 0])):
            p = beta[fold][0] + (X[test] * keep) @ beta[fold][1:]
            assert got[fold, name]["r2"] == pytest.approx(1 - ((Y[test] - p) ** 2).mean() / Y[test].var(), abs=1e-7)
        assert got[fold, "first"]["importance"] > got[fold, "noise"]["importance"]


def test_permuted_values_are_a_permutation_by_fold(spark, rows):
    held = rows.where("a IS NOT NULL AND NOT isnan(a) AND block IS NOT NULL")
    got = reg.permuted(held, "block", "i", ["a", "noise"], 3, bucket=16).collect()
    for block, (feature, k), repeat in itertools.product((0, 9), (("a", 0), ("noise", 3)), range(3)):
        mine = {r["i"]: r["value"] for r in got if (r["block"], r["feature"], r["repeat"]) == (block, feature, repeat)}
        own = X[block * 60 : block * 60 + 60, k]
        assert sorted(mine.values()) == sorted(own) and set(mine) == set(range(block * 60, block * 60 + 60))
        assert sum(mine[block * 60 + i] == own[i] for i in range(60)) < 20


def test_importance_ranks_noise_last_whatever_the_layout(spark, rows, solved):
    fits = solved[1].where("penalty = 0 AND fold = 2").select("fold", "beta")
    test = rows.where("block IN (2, 3) AND a IS NOT NULL AND NOT isnan(a)").withColumn("fold", F.lit(2))
    one, seven = (sorted((r["rank"], r["feature"], round(r["importance"], 9), round(r["sd"], 9)) for r in reg.permutation_importance(test.repartition(n), "fold", "i", NAMES, "y", fits).collect()) for n in (1, 7))
    assert one == seven and one[-1][1] == "noise" and abs(one[-1][2]) < 0.02
    # dealing a feature anew adds about twice its share of the variance
    beta = np.array(fits.first()["beta"])[1:]
    test = places(None, 2, 4)[1]
    for _, feature, importance, _ in one:
        k = NAMES.index(feature)
        assert importance == pytest.approx(2 * beta[k] ** 2 * X[test, k].var() / Y[test].var(), rel=0.35, abs=0.02)


def pinball(y, p, tau):
    return np.maximum(tau * (y - p), (tau - 1) * (y - p)).mean()


def test_quantile_fits_are_the_least_pinball_loss(spark):
    n, taus = 60, [0.1, 0.5, 0.9]
    x = R.uniform(-1, 1, n)
    y = 1 + x + (0.5 + 0.4 * x) * R.normal(size=n)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, math.nan)], "x double, y double")
    fit = reg.quantile_fit(frame, ["x"], "y", taus)
    for tau in taus:  # an optimal line goes through two points
        lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i, j in itertools.combinations(range(n), 2)]
        best = min(pinball(y, y[i] + s * (x - x[i]), tau) for s, i in lines)
        base, slope = fit[tau]
        assert pinball(y, base + slope * x, tau) <= best * 1.002 + 1e-9
    assert reg.quantile_fit(frame.limit(0), ["x"], "y", taus) == {}


def test_quantile_coverage_and_order(spark, rows):
    taus = [0.05, 0.25, 0.5, 0.75, 0.95]
    fit = reg.quantile_fit(rows, NAMES, "y", taus)
    out = reg.quantile_forecasts(rows.where("a IS NOT NULL AND NOT isnan(a) AND i < 600"), NAMES, fit).select("y", "quantiles").collect()
    for k, tau in enumerate(taus):
        assert np.mean([r["y"] <= r["quantiles"][k] for r in out]) == pytest.approx(tau, abs=0.02)
    assert all(r["quantiles"] == sorted(r["quantiles"]) for r in out)


# calibration


def test_evolution_finds_a_minimum_whatever_the_layout(spark):
    def objective(parts):
        return lambda rows: rows.repartition(parts).select("id", (F.pow(F.col("x") - 1.5, F.lit(2)) + 3 * F.pow(F.col("z") + 0.25, F.lit(2))).alias("loss"))

    runs = [cal.evolve(spark, {"x": (-4.0, 4.0), "z": (-1.0, 1.0)}, objective(parts), population=12, generations=n) for parts, n in ((1, 20), (7, 3))]
    one, seven = (sorted(map(tuple, r.collect())) for r in runs)
    assert [r for r in one if r[0] <= 3] == seven
    least = [min(r[-1] for r in one if r[0] == g) for g in range(21) if any(r[0] == g for r in one)]
    assert least == sorted(least, reverse=True) and least[-1] < 1e-3
    top = cal.best(runs[0]).first()
    assert (top["x"], top["z"]) == pytest.approx((1.5, -0.25), abs=0.05)
    assert all(-4 <= r[2] <= 4 and -1 <= r[3] <= 1 for r in one)


BANKS = [(b, 3.0 + 0.8 * b, 10.0 + b, 4.0 + b % 3) for b in range(8)]
LOANS = [(a, b, 0.5 + (a * b) % 3) for a in range(8) for b in range(8) if a != b and (a + b) % 3]


def brute_cascade(cet1, lgd):
    cet1, held = list(cet1), [b[3] for b in BANKS]
    dead, new = set(), {b for b in range(8) if cet1[b] < 0}
    while new:
        dead |= new
        for b in range(8):
            loss = min(sum(w for s, t, w in LOANS if s == b and t in new) * lgd, held[b])
            held[b] -= loss
            cet1[b] -= loss / (0.35 * BANKS[b][2]) * 100
        new = {b for b in range(8) if cet1[b] < 0} - dead
    return cet1, dead


def test_cascades_of_many_keys_are_each_their_own(spark):
    state = spark.createDataFrame(BANKS, "bank long, cet1 double, total_assets double, interbank_assets double")
    keyed = state.withColumn("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("lgd", F.col("id") * 0.03).withColumn("cet1", F.col("cet1") - 3.5 - F.col("id"))
    got = cal.cascades(keyed, spark.createDataFrame(LOANS, "source long, target long, weight double"), ["id"], "lgd").collect()
    for k in range(3):
        cet1, dead = brute_cascade([b[1] - 3.5 - k for b in BANKS], k * 0.03)
        mine = {r["bank"]: r for r in got if r["id"] == k}
        assert {b for b, r in mine.items() if r["defaulted"]} == dead
        assert [mine[b]["cet1"] for b in range(8)] == pytest.approx(cet1)


def test_calibration_recovers_planted_parameters(spark):
    state = spark.createDataFrame(BANKS, "bank long, cet1 double, total_assets double, interbank_assets double")
    loans = spark.createDataFrame(LOANS, "source long, target long, weight double")
    metrics = lambda c: cal.cascade_metrics(c.withColumn("spread", F.lit(1.0)).withColumn("lgd", F.lit(0.02)), state, loans, 4)
    planted = metrics(spark.createDataFrame([(0, 4.0)], "id long, shock double")).first()
    targets = {"defaults": planted["defaults"], "mean_cet1": planted["mean_cet1"]}
    found = cal.best(cal.evolve(spark, {"shock": (0.0, 8.0)}, lambda c: cal.loss(metrics(c), targets), population=6, generations=6)).first()
    assert found["shock"] == pytest.approx(4.0, abs=0.4) and found["loss"] < 0.02


# resampling and ranks


def test_resamples_reach_all_of_a_long_table(spark):
    """Rows past any fixed number count too: the interval holds the mean of 0 to 29,999."""
    rows = resampling.numbered(spark.range(30_000).select(F.col("id").cast("double").alias("v")), ["v"])
    each = resampling.resampled(rows, 100).groupBy("b").agg(resampling.weighted("v")["mean"].alias("m"), F.sum("w").alias("n"), F.max("v").alias("top")).cache()
    got = each.collect()
    low, high = resampling.intervals(each, {"": "m"}).first()
    assert low < 14_999.5 < high and high - low < 300
    assert np.std([r["m"] for r in got]) == pytest.approx(30_000 / 12**0.5 / 30_000**0.5, rel=0.3)
    assert all(abs(r["n"] - 30_000) < 1000 and r["top"] > 29_000 for r in got)
    one = validation.corrected_interval(rows, "v", 100).first()
    assert one["low"] < one["estimate"] < one["high"] and one["estimate"] == 14_999.5


def test_poisson_counts_and_blocks(spark):
    counts = {r["w"]: r["count"] for r in resampling.resampled(spark.range(400).withColumnRenamed("id", "i"), 50).groupBy("w").count().collect()}
    for k in range(1, 5):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    taken = resampling.blocks(spark.range(20_000).withColumnRenamed("id", "i"), 10, 100).groupBy("b").agg(F.count("*").alias("n"), F.max("i").alias("top"), F.avg("i").alias("m")).collect()
    assert all(r["n"] == 20_000 and r["top"] > 18_000 and abs(r["m"] - 10_000) < 1500 for r in taken)


def test_numbers_and_distances_by_ranges(spark):
    v = R.uniform(0, 1, 500)
    frame = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(6)
    numbered = {r["v"]: r["i"] for r in resampling.numbered(frame, ["v"]).collect()}
    assert [numbered[x] for x in sorted(v)] == list(range(500))
    f = np.sort(v)
    want = max(max((k + 1) / 500 - x, x - k / 500) for k, x in enumerate(f))
    assert stats.ks_uniform(frame, "v", 0.0, 1.0).first()["ks"] == pytest.approx(want)
    assert ranks.ranked(frame.limit(0), F.asc("v")).count() == 0


def test_ranked_is_a_total_order(spark):
    got = ranks.ranked(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")), F.desc("v")).collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["rank"])] == sorted((k * 7919 % 5003 for k in range(5000)), reverse=True)
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert ranks.ranked(spark.range(0), F.asc("id")).count() == 0


def test_repeated_numbers_each_row(spark):
    got = ranks.repeated(spark.createDataFrame([("a", 1), ("b", 9001)], "k string, n long"), "n", "at").groupBy("k").agg(F.count("*").alias("c"), F.min("at").alias("low"), F.max("at").alias("high"), F.count_distinct("at").alias("d"))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 0, 0, 1), ("b", 9001, 0, 9000, 9001)}
