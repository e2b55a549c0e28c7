"""Invariants and edge cases of the operators on small fixtures."""

import datetime as dt
import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.distributions import beta_inc, f_upper, normal_cdf, t_two_sided
from riskweave.operators import coarse, contagion, learning, network, rates, risk, spectral, stats, timeseries, validation
from riskweave.operators.components import connected_components
from riskweave.sources import views as v

EDGES = [(0, 0, 1, 1.0), (0, 0, 2, 1.0), (0, 1, 2, 1.0), (0, 1, 3, 1.0), (0, 2, 4, 1.0), (0, 3, 4, 1.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "g int, s long, t long, c double").cache()


def test_laplacian_rows_sum_to_zero(edges):
    rows = network.laplacian(network.mirrored(edges), ["g"], normalised=False).groupBy("i").agg(F.sum("v").alias("x")).collect()
    assert len(rows) == 5 and all(abs(r["x"]) < 1e-12 for r in rows)


def test_modes_are_orthonormal_and_trace_holds(edges):
    m = spectral.modes(edges, "g", normalised=False)
    norms = m.groupBy("mode").agg(F.sum(F.col("v") * F.col("v")).alias("x")).collect()
    assert all(abs(r["x"] - 1) < 1e-9 for r in norms)
    s = spectral.spectrum(m, "g").first()
    assert s["total"] == pytest.approx(12) and s["lambda_2"] > 0 and s["nodes"] == 5


def test_diffusion_distance_is_a_metric(edges):
    rows = spectral.diffusion_distance(spectral.modes(edges, "g"), "g", 0.5).collect()
    d = {(r["a"], r["b"]): r["dist"] for r in rows} | {(r["b"], r["a"]): r["dist"] for r in rows}
    assert all(x > 0 for x in d.values())
    assert all(d[a, c] <= d[a, b] + d[b, c] + 1e-12 for a in range(5) for b in range(5) for c in range(5) if len({a, b, c}) == 3)


def test_spanning_tree_has_one_edge_less_than_nodes(edges):
    assert network.spanning_tree(edges.withColumnRenamed("c", "dist"), "g").count() == 4


def test_components_of_a_long_path_and_loops(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "source long, target long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and found[100] == found[101] == 100 and 200 not in found


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "source long, target long")).count() == 0


def test_clustering_of_a_triangle_with_a_tail(spark):
    e = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 1.0), (0, 0, 2, 1.0), (0, 2, 3, 1.0)], "g int, s long, t long, c double")
    found = {r["node"]: r["cc"] for r in network.clustering(network.mirrored(e), ["g"]).collect()}
    assert found == {0: 1.0, 1: 1.0, 2: pytest.approx(1 / 3), 3: 0.0}


def test_standardising_edges_without_spread(spark):
    e = spark.createDataFrame([(0, 1, 2, 3.0), (0, 2, 1, 3.0)], "g int, source long, target long, weight double")
    assert [r["weight"] for r in network.standardised(e, ["g"]).collect()] == [0.0, 0.0]


def test_as_of_before_the_first_row_is_null(spark):
    d = dt.date
    times = spark.createDataFrame([(1, d(2020, 1, 1)), (1, d(2020, 3, 1)), (2, d(2020, 3, 1))], "k int, t date")
    table = spark.createDataFrame([(1, d(2020, 2, 1), 5.0), (1, d(2020, 3, 1), 6.0)], "k int, d date, x double")
    found = {(r["k"], r["t"]): r["x"] for r in timeseries.as_of_key(times, table, "k").collect()}
    assert found == {(1, d(2020, 1, 1)): None, (1, d(2020, 3, 1)): 6.0, (2, d(2020, 3, 1)): None}


def test_rolling_correlation_counts_and_flat_series(spark):
    rows = [(b, dt.date(2020, 1, k + 1), float((k * (b + 3)) % 7) if b < 2 else 1.0) for b in range(3) for k in range(10)]
    r = spark.createDataFrame(rows, "bank int, d date, r double")
    found = timeseries.rolling_correlation(timeseries.pairs(r), 4, inclusive=True).collect()
    assert len(found) == 3 * (10 - 4 + 1)
    assert all(x["c"] is None or math.isnan(x["c"]) or abs(x["c"]) <= 1 + 1e-9 for x in found)


def test_cusum_of_a_flat_series_is_empty(spark):
    rows = [("x", dt.date(2020, 1, k + 1), 2.0) for k in range(9)]
    assert timeseries.cusum(spark.createDataFrame(rows, "a string, d date, v double"), "v", 1.0, "a").first()["breaks"] == []


def test_binary_segmentation_finds_the_step(spark):
    rows = [("x", dt.date(2020, 1, 1) + dt.timedelta(k), 0.0 if k < 30 else 5.0) for k in range(60)]
    found = timeseries.binary_segmentation(spark.createDataFrame(rows, "a string, d date, v double"), "v", "a").collect()
    assert [r["at"] for r in found] == [30]


def test_walk_forward_without_room():
    with pytest.raises(ValueError):
        timeseries.walk_forward(10, 3, 8, 3, 1)


def test_srisk_is_never_negative(spark):
    df = spark.createDataFrame([(-0.1, 10.0, 1000.0), (0.0, 100.0, 10.0)], "m double, e double, b double")
    assert [r[0] for r in df.select(risk.srisk(F.col("m"), F.col("e"), F.col("b"))).collect()] == [pytest.approx(0.08 * 1000 - 0.92 * 10 * 0.9), 0.0]


def test_auc_of_one_class_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 1, 0.9), ("c", 0, 0.1)], "k string, y long, x double")
    assert {r["k"]: r["auc"] for r in stats.auc(df, "y", "x", ["k"]).collect()} == {"a": 0.0, "b": 0.5, "c": 1.0}


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(500).select((F.col("id") % 10).cast("double").alias("x"))
    r = stats.bootstrap(df, "x", 100).first()
    assert r["low"] < 4.5 < r["high"] and r["replicates"] == 100 and 0.05 < r["se"] < 0.25


def test_distributions():
    assert normal_cdf(1.959963985) == pytest.approx(0.975, abs=1e-6)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert f_upper(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert beta_inc(2, 3, 0.5) == pytest.approx(0.6875)


def state(spark, rows):
    return spark.createDataFrame(rows, "bank long, cet1 double, lcr double, nsfr double, total_assets double, cash double, interbank_assets double")


def test_cascade_runs_to_its_end(spark):
    s = state(spark, [(1, -1.0, 100.0, 100.0, 10.0, 5.0, 9.0), (2, 5.0, 100.0, 100.0, 10.0, 5.0, 9.0), (3, 5.0, 100.0, 100.0, 10.0, 5.0, 9.0), (4, 30.0, 100.0, 100.0, 10.0, 5.0, 9.0)])
    e = spark.createDataFrame([(2, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)], "source long, target long, weight double")
    found = {r["bank"]: r["round"] for r in contagion.cascade(s, e).collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: None}


def test_thresholds_count_as_solvent(spark):
    df = spark.createDataFrame([(4.5, 100.0), (4.4, 99.9), (None, None)], "a double, b double")
    found = [tuple(r) for r in df.select(contagion.solvent(F.col("a")), contagion.liquid(F.col("b"))).collect()]
    assert found == [(True, True), (False, False), (True, True)]


def test_simulation_needs_steps(spark):
    with pytest.raises(ValueError):
        contagion.simulate(None, None, 1, 0)


def test_simulation_repeats_with_its_seed(spark):
    s = state(spark, [(k, 9.0, 130.0, 110.0, 10.0, 5.0, 2.0) for k in range(4)])
    e = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5)], "source long, target long, weight double")
    one, two = (sorted(map(tuple, contagion.simulate(s, e, 3, 4, seed=5).collect())) for _ in range(2))
    assert one == two and len(one) == 12


def test_unknown_regressor():
    with pytest.raises(ValueError):
        learning.regressor("deep", "y")


def test_registered_queries_use_all_banks_and_the_reference_counts(spark, monkeypatch):
    from riskweave.plans import catalog

    data, queries, seen = "/root/testdata/sf0.001", catalog.queries(), {}
    granger, gap_test = learning.granger, spectral.gap_test
    monkeypatch.setattr(learning, "granger", lambda r, lags=2, **k: seen.update(lags=lags, banks=r.select("bank").distinct().count(), all=granger(r, lags, **k)) or seen["all"])
    monkeypatch.setattr(spectral, "gap_test", lambda e, by, ensemble=1000, **k: seen.update(ensemble=ensemble) or gap_test(e, by, ensemble, **k))
    queries["granger_links"](spark, data)
    queries["gap_test"](spark, data)
    banks = v.ret(spark, data).select("bank").distinct().count()
    assert banks > 8 and seen["banks"] == banks and seen["lags"] == 5 and seen["ensemble"] == 1000
    assert queries["bootstrap_mean"](spark, data).first()["replicates"] == 10000


def test_sources_are_chosen_by_name_and_range(spark):
    from riskweave.sources import generated as gen

    banks = spark.createDataFrame([(1,), (2,)], "bank long")
    days = [r["d"].isoweekday() for r in gen.collected(spark, "cds", banks, "1999-01-01", "1999-01-14").select("d").distinct().collect()]
    assert len(days) == 10 and max(days) == 5
    assert gen.indicator(spark, "credit_gap", banks, "1999-01-01", "1999-12-31").count() == 8
    for wrong in (lambda: gen.generated(spark, "nothing", banks), lambda: gen.indicator(spark, "cds", banks)):
        with pytest.raises(ValueError):
            wrong()


def test_scores_of_interactions_fold_in_order(spark):
    from riskweave.operators import decisions as dec

    rows = spark.createDataFrame([("a", "b", 1, 1.0), ("a", "b", 2, -1.0), ("a", "b", 3, 1.0), ("c", "b", 1, 0.5)], "lender string, borrower string, at long, outcome double")
    got = {r["lender"]: r["score"] for r in dec.interaction_scores(rows, 0.5).collect()}
    assert got == {"a": pytest.approx(((0.5 * 0.5) - 0.5) * 0.5 + 0.5), "c": pytest.approx(0.25)}
    with pytest.raises(ValueError):
        dec.interaction_scores(rows, 0.0)


def test_central_nodes_of_a_path(spark):
    from riskweave.operators import paths

    rows = spark.createDataFrame([(0, a, b, 1.0) for a, b in ((0, 1), (1, 2), (2, 3))], "g int, source long, target long, weight double")
    got = {r["node"]: (r["degree"], r["closeness"], r["betweenness"]) for r in paths.centralities(rows, ["g"]).collect()}
    assert got[0] == (pytest.approx(1 / 3), 0.0, 0.0) and got[1][2] == got[2][2] == pytest.approx(2 / 6)
    assert got[3][1] == pytest.approx(3 / 6)
    with pytest.raises(Exception, match="no cluster"):
        paths.cluster_names(spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([(1, 0)], "node long, k long")).collect()


@pytest.mark.parametrize("n,splits,train,test,gap", [(60, 4, 20, 10, 2), (33, 5, 20, 10, 2), (34, 5, 20, 10, 2), (100, 1, 30, 7, 0)])
def test_folds(spark, n, splits, train, test, gap):
    step = max(1, (n - train - gap - test) // splits)
    want = [(k, train + k * step, train + k * step + gap, min(train + k * step + gap + test, n)) for k in range(splits) if train + k * step + gap < n]
    assert sorted(map(tuple, validation.expanding_folds(spark, n, splits, train, test, gap).collect())) == want
    first, last = train + gap, n - test
    starts = [first + (last - first) * k // max(1, splits - 1) for k in range(splits)]
    assert sorted(map(tuple, validation.spaced_folds(spark, n, splits, train, test, gap).collect())) == [(k, s - gap, s, s + test) for k, s in enumerate(starts)]


def test_folds_of_too_few_rows(spark):
    for folds in (validation.expanding_folds, validation.spaced_folds):
        with pytest.raises(ValueError, match="too few"):
            folds(spark, 32, 4, 20, 10, 2)


def test_corrected_interval(spark):
    x = np.random.default_rng(3).exponential(size=40)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    got = validation.corrected_interval(rows, "v", 300).first()
    # a row counts in a resample as often as a Poisson number drawn from the first 32 bits of md5 says
    tail = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    counts = np.array([[(int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) / 2**32 >= tail).sum() for i in range(40)] for b in range(300)])
    means = counts @ x / counts.sum(1)
    left = np.array([np.delete(x, k).mean() for k in range(40)])
    a = ((left.mean() - left) ** 3).sum() / (6 * ((left.mean() - left) ** 2).sum() ** 1.5)
    normal = NormalDist()
    z0 = normal.inv_cdf((means < x.mean()).mean())
    ends = [np.percentile(means, 100 * normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    assert (got.estimate, got.low, got.high, got.se) == pytest.approx((x.mean(), *ends, means.std()))


def test_corrected_interval_of_nothing(spark):
    assert tuple(validation.corrected_interval(spark.createDataFrame([], "i long, v double"), "v", 10).first()) == (None,) * 4


def test_sensitivity_of_a_line(spark):
    bounds = {"p": (0.0, 1.0), "q": (0.0, 2.0), "idle": (0.0, 1.0)}
    run = validation.screening_points(spark, bounds, 50, 0.1).withColumn("y", F.expr("3 * p - q"))
    got = {r.parameter: (r.effect, r.spread) for r in validation.elementary_effects(run.where("p < 0.9 AND q < 1.8"), bounds, "y", 0.1).collect()}
    assert got["p"] == pytest.approx((3, 0), abs=1e-9) and got["q"] == pytest.approx((1, 0), abs=1e-9) and got["idle"] == pytest.approx((0, 0), abs=1e-9)
    run = validation.variance_points(spark, bounds, 2000).withColumn("y", F.expr("3 * p - q"))
    got = {r.parameter: (r.first, r.total) for r in validation.variance_shares(run, "y").collect()}
    assert got["p"] == pytest.approx((9 / 13, 9 / 13), abs=0.03) and got["q"] == pytest.approx((4 / 13, 4 / 13), abs=0.03) and got["idle"] == pytest.approx((0, 0), abs=0.03)
    flat = validation.variance_shares(run.withColumn("y", F.lit(1.0)), "y").collect()
    assert {(r.first, r.total) for r in flat} == {(None, None)}


def test_conversion(spark):
    rates_ = spark.sql("select * from values ('USD', date '2020-01-01', 2e0), ('USD', date '2020-01-04', 4e0), ('GBP', date '2020-01-01', 0.5e0) t(ccy, d, rate)")
    rows = spark.sql("select * from values (1, 'USD', 'EUR', date '2020-01-03', 8e0), (2, 'EUR', 'USD', date '2020-01-04', 8e0), (3, 'GBP', 'USD', date '2020-01-01', 1e0), (4, 'GBP', 'USD', date '2020-01-02', 1e0), (5, 'XXX', 'XXX', date '2020-01-02', 7e0), (6, 'USD', 'EUR', date '2019-12-31', 1e0), (7, null, 'EUR', date '2020-01-01', 1e0) t(id, src, dst, d, amount)")
    got = {r.id: r.value for r in rates.converted(rows, rates_, F.col("amount")).collect()}
    assert got == {1: 4.0, 2: 32.0, 3: 4.0, 4: None, 5: 7.0, 6: None, 7: None}
    assert rates.converted(rows.where("id in (1, 2, 3, 5)"), rates_, F.col("amount"), strict=True).count() == 4
    with pytest.raises(Exception, match="no rate on"):
        rates.converted(rows, rates_, F.col("amount"), strict=True).collect()


def test_rate_cache_expires(spark, tmp_path):
    held = spark.sql("select 'USD' ccy, date '2020-01-01' d, 2e0 rate")
    rates.save(held, str(tmp_path / "r"), F.expr("timestamp '2020-01-02 00:00:00'"))
    assert rates.load(spark, str(tmp_path / "r"), F.expr("timestamp '2020-01-02 23:00:00'")).collect() == held.collect()
    assert rates.load(spark, str(tmp_path / "r"), F.expr("timestamp '2020-01-03 00:00:00'")).count() == 0
    wanted = spark.sql("select explode(array('EUR', 'USD', 'JPY')) ccy")
    assert [r.ccy for r in rates.missing(wanted, held).collect()] == ["JPY"]


def test_diffusion_by_scale(edges, spark):
    a = np.zeros((5, 5))
    for _, i, j, c in EDGES:
        a[i, j] = a[j, i] = c
    lap = np.diag(a.sum(1)) - a
    values, vectors = np.linalg.eigh(lap)

    def heat(m, t):
        out = term = np.eye(5)[0]
        for k in range(1, 80):
            term = -t * m @ term / k
            out = out + term
        return out

    m = spectral.modes(edges, "g", normalised=False)
    hub = spark.createDataFrame([(0, 0)], "g int, node long")
    got = {(r.k, r.t): r for r in coarse.diffusion_by_scale(m, "g", hub, [1, 2, 4], [0.5, 2]).collect()}
    assert len(got) == 6
    for (k, t), r in got.items():
        p, q = heat(lap, t), heat(vectors * np.where(np.arange(5) <= k, values, 0) @ vectors.T, t)
        r2 = 1 - ((p - q) ** 2).sum() / ((p - p.mean()) ** 2).sum()
        want = (np.linalg.norm(p - q) / np.linalg.norm(p), np.corrcoef(p, q)[0, 1], np.sqrt(((p - q) ** 2).mean()), r2)
        assert (r.error, r["corr"], r.rmse, r.r2) == pytest.approx(want, abs=1e-9)
    assert got[4, 2.0].error == pytest.approx(0, abs=1e-9)


def test_best_scale(spark):
    rows = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.95), (0, 3, 0.99), (1, 2, 0.5)], "g int, k long, r2 double")
    assert sorted(map(tuple, coarse.best_scale(rows, "g").collect())) == [(0, 2), (1, 1)]


def test_rescaled_and_spectrum_error(edges):
    m = spectral.modes(edges, "g", normalised=False)
    values = [r[0] for r in m.groupBy("mode").agg(F.max("lambda")).orderBy("mode").select("max(lambda)").collect()]
    w = edges.withColumnRenamed("c", "w")
    assert [r.w for r in coarse.rescaled(w, m, "g", 2).collect()] == pytest.approx([1 / values[2]] * len(EDGES))
    assert {r.w for r in coarse.rescaled(w, m, "g", 0, strict=False).collect()} == {None}
    with pytest.raises(Exception, match="no positive value"):
        coarse.rescaled(w, m, "g", 0).collect()
    half = spectral.modes(edges.withColumn("c", F.col("c") / 2), "g", normalised=False)
    assert coarse.spectrum_error(m, half, "g", 3).first().error == pytest.approx(0.5)
    assert coarse.spectrum_error(m, m, "g", 3).first().error == 0
