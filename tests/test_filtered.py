"""Planar filtering, graphical lasso, thresholds by folds, clusters and renormalisation against brute force."""

import functools
import itertools
import random

import numpy as np
import pytest

from riskweave.operators import filtered, network as net, scales, spectral, thresholds as thr

rnd = random.Random(8)


# planarity by minors (Wagner): exhaustive, for up to seven nodes


@functools.cache
def has_minor(edges):
    nodes = sorted({v for e in edges for v in e})
    joined = lambda a, b: (min(a, b), max(a, b)) in edges
    if any(all(joined(a, b) for a, b in itertools.combinations(five, 2)) for five in itertools.combinations(nodes, 5)):
        return True
    for six in itertools.combinations(nodes, 6):
        if any(all(joined(a, b) for a in three for b in six if b not in three) for three in itertools.combinations(six, 3)):
            return True
    if len(nodes) <= 5:
        return False
    for a, b in edges:
        merged = frozenset((min(x, y), max(x, y)) for x, y in ((a if u == b else u, a if w == b else w) for u, w in edges) if x != y)
        if has_minor(merged):
            return True
    return False


@pytest.mark.parametrize("seed", range(6))
def test_left_right_is_planarity_by_minors(seed):
    r = random.Random(seed)
    graph, kept = filtered.Planar(), set()
    pairs = list(itertools.combinations(range(7), 2))
    r.shuffle(pairs)
    for a, b in pairs:
        planar = not has_minor(frozenset(kept | {(a, b)}))
        assert graph.add(*((a, b) if r.random() < 0.5 else (b, a))) == planar
        if planar:
            kept.add((a, b))
    assert graph.edges == len(kept) == 15  # a maximal planar graph of seven nodes
    assert not graph.add(*min(kept)) and not graph.add(3, 3)


@pytest.mark.parametrize("seed", range(3))
def test_left_right_on_sparse_graphs(seed):
    """Graphs of two blocks and long cycles, where conflicts are merged far up."""
    r = random.Random(100 + seed)
    for _ in range(150):
        edges = [tuple(sorted(e)) for e in r.sample(list(itertools.combinations(range(7), 2)), r.randint(8, 13))]
        near = {v: {} for v in range(7)}
        for a, b in edges:
            near[a][b] = near[b][a] = None
        parts, seen, planar = [], set(), True
        for v in range(7):
            if v not in seen:
                test = filtered._Test(near)
                test.orient(v)
                parts.append(set(test.height))
                seen |= parts[-1]
                planar = planar and test.planar(v)
        assert planar == (not has_minor(frozenset(edges)))


def test_large_planar_graphs_are_taken_and_one_edge_more_is_not():
    grid, n = filtered.Planar(), 12
    for x, y in itertools.product(range(n), range(n)):
        assert x == n - 1 or grid.add((x, y), (x + 1, y))
        assert y == n - 1 or grid.add((x, y), (x, y + 1))
        assert n - 1 in (x, y) or grid.add((x, y), (x + 1, y + 1))
    assert not grid.add((3, 3), (8, 5)) and not grid.add((3, 4), (4, 3)) and grid.add((0, 0), (n - 1, n - 1))


def test_planar_filter_by_snapshot(spark):
    rows = [(d, a, b, round(rnd.uniform(-1, 1), 2)) for d in (1, 2) for a, b in itertools.combinations(range(7), 2)] + [(3, 0, 1, 0.5), (3, 0, 2, None), (4, 0, 1, 0.2)]
    got = filtered.planar_filtered(spark.createDataFrame(rows, "d long, s long, t long, c double"), "d").collect()
    for d in (1, 2):
        want = set()
        for _, a, b, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (r[3], r[1], r[2]), reverse=True):
            if not has_minor(frozenset(want | {(a, b)})):
                want.add((a, b))
        assert {(r["s"], r["t"]) for r in got if r["d"] == d} == want and len(want) == 15
    assert [tuple(r) for r in got if r["d"] > 2] == [(3, 0, 1, 0.5), (4, 0, 1, 0.2)]


# graphical lasso


@pytest.mark.parametrize("penalty", [0.0, 0.05, 0.2, 2.0])
def test_lasso_meets_its_optimality_conditions(penalty):
    x = np.random.default_rng(1).normal(size=(60, 8)) @ np.random.default_rng(2).normal(size=(8, 8))
    s = np.cov(x.T, bias=True) / 8
    p = filtered.lasso(s, penalty)
    w, off = np.linalg.inv(p), ~np.eye(8, dtype=bool)
    assert np.diag(w) == pytest.approx(np.diag(s), abs=1e-6)
    kept = off & (np.abs(p) > 1e-9)
    assert np.abs(w - s - penalty * np.sign(p))[kept].max(initial=0) < 1e-6
    assert np.abs(w - s)[off & ~kept].max(initial=0) <= penalty + 1e-6
    assert np.linalg.eigvalsh(p).min() > 0


def series(k, keys, times, seed=0):
    r = np.random.default_rng(seed)
    common = r.normal(size=times)
    return [(k, b, i, float(0.8 * common[i] * (b < 3) + r.normal())) for b in range(keys) for i in range(times)]


SERIES = "d long, bank long, i long, r double"


def test_fold_covariances_are_those_of_the_rows(spark):
    rows = series(1, 4, 23) + series(2, 3, 10, 5)
    got = filtered.fold_covariances(spark.createDataFrame(rows, SERIES), ["d"], "bank", "r", "i", 4).collect()
    for d, times in ((1, 23), (2, 10)):
        x = {(b, i): r for k, b, i, r in rows if k == d}
        fold = np.array([i * 4 // times for i in range(times)])
        for r in (r for r in got if r["d"] == d):
            a, b = (np.array([x[r[e], i] for i in range(times)]) for e in "st")
            cov = lambda m: ((a[m] - a[m].mean()) * (b[m] - b[m].mean())).mean()  # noqa: E731, B023
            assert r["c"] == pytest.approx(cov(fold != r["fold"]), abs=1e-9)
            assert r["held"] is None if r["fold"] < 0 else r["held"] == pytest.approx(cov(fold == r["fold"]), abs=1e-9)


def test_partial_correlations_choose_the_penalty_by_folds(spark):
    rows = series(1, 5, 60) + series(2, 5, 40, 9) + [(2, 9, i, 1.0) for i in range(40)]  # the last is flat
    shares = [0.1, 0.4, 0.8]
    got = filtered.partial_correlations(spark.createDataFrame(rows, SERIES), "d", "bank", "r", "i", shares, folds=3, threshold=0.02).collect()
    for d, times in ((1, 60), (2, 40)):
        x = np.array([[r for k, b, i, r in rows if k == d and b == c] for c in range(5)])
        fold = np.array([i * 3 // times for i in range(times)])
        cov = lambda m: np.cov(x[:, m], bias=True)  # noqa: E731, B023
        fit = lambda s, share: filtered.lasso(s, share * np.abs(s - np.diag(np.diag(s))).max())
        score = {a: np.mean([np.linalg.slogdet(p := fit(cov(fold != f), a))[1] - (cov(fold == f) * p).sum() for f in range(3)]) for a in shares}
        best = max(shares, key=score.get)
        p = fit(np.cov(x, bias=True), best)
        partial = -p / np.sqrt(np.outer(np.diag(p), np.diag(p)))
        want = {(i, j): partial[i, j] for i, j in itertools.combinations(range(5), 2) if abs(partial[i, j]) >= 0.02}
        mine = {(r["s"], r["t"]): r["partial"] for r in got if r["d"] == d}
        assert set(mine) == set(want) and {r["share"] for r in got if r["d"] == d} == {best}
        assert all(mine[k] == pytest.approx(want[k], abs=1e-6) for k in want)


# thresholds by folds


def test_threshold_folds_against_a_loop(spark):
    rows = series(1, 4, 83) + series(2, 3, 20, 4) + [(1, 0, 500, 0.1)]  # the last time lacks other series
    cuts = [0.1, 0.3, 0.9]
    found = thr.fold_spectra(spark.createDataFrame(rows, SERIES), "d", "bank", "r", "i", cuts)
    got = {(r["fold"], round(r["threshold"], 3)): r for r in found.collect()}
    x, size, want = np.array([[r for k, b, i, r in rows if k == 1 and b == c and i < 83] for c in range(4)]), 83 // 5, {}
    for fold, cut in itertools.product(range(5), cuts):
        a = np.corrcoef(x[:, fold * size : (fold + 1) * size])
        np.fill_diagonal(a, 0)
        a[a < cut] = 0
        root = 1 / np.sqrt(np.where(a.sum(1) == 0, 1, a.sum(1)))
        lam = np.linalg.eigvalsh(np.eye(4) - root[:, None] * a * root)
        want[fold, cut] = (lam[1], lam[2] - lam[1])
    assert set(got) == set(want)  # the second snapshot's folds are too short
    for k, (lam2, gap) in want.items():
        assert (got[k]["lam2"], got[k]["gap"]) == pytest.approx((lam2, gap), abs=1e-7)
    table = {round(r["threshold"], 3): r for r in thr.threshold_stability(found, "d").collect()}
    spread = {c: np.std([want[f, c][1] for f in range(5)]) / max(np.mean([want[f, c][1] for f in range(5)]), 1e-10) for c in cuts}
    for c in cuts:
        assert table[c]["gap_cv"] == pytest.approx(spread[c], abs=1e-6) and table[c]["lam2_mean"] == pytest.approx(np.mean([want[f, c][0] for f in range(5)]))
    assert [c for c in cuts if table[c]["best"]] == [min(cuts, key=spread.get)]


# clusters and scales


def test_k_means_reaches_the_inertia_of_brute_force(spark):
    groups = {1: 3, 2: 2, 3: 9, 4: 1}
    rows = [(d, v, [round(rnd.gauss(4 * (v % k), 0.4), 3), round(rnd.gauss(-3 * (v % k), 0.4), 3)], k) for d, k in groups.items() for v in range(7)]
    got = scales.k_means(spark.createDataFrame(rows, "d long, node long, x array<double>, k long"), "d").collect()
    for d, k in groups.items():
        x = np.array([r[2] for r in rows if r[0] == d])
        best = min(sum(((x[np.array(label) == c] - x[np.array(label) == c].mean(0)) ** 2).sum() for c in set(label)) for label in itertools.product(range(min(k, 3)), repeat=7)) if k < 9 else 0.0
        mine = [r for r in got if r["d"] == d]
        assert mine[0]["inertia"] == pytest.approx(best, abs=1e-6)
        label = [r["cluster"] for r in sorted(mine, key=lambda r: r["node"])]
        assert label[0] == 0 and all(c <= max(label[:i]) + 1 for i, c in enumerate(label) if i)


def test_spectral_clusters_of_planted_blocks(spark):
    rows = [(d, a, b, 1.0 if a % d == b % d else 0.01) for d in (2, 3, 4) for a, b in itertools.combinations(range(12), 2)]
    modes = spectral.modes(spark.createDataFrame(rows, "d long, s long, t long, c double"), "d")
    sizes = spark.createDataFrame([(2, 2), (3, 3), (4, 1)], "d long, k long")
    got = {(r["d"], r["node"]): r["cluster"] for r in scales.spectral_clusters(modes, "d", sizes).collect()}
    assert len(got) == 36
    for d in (2, 3):
        assert len({got[d, v] for v in range(12)}) == d and all(got[d, v] == got[d, v % d] for v in range(12))
    assert {got[4, v] for v in range(12)} == {0}


def test_renormalisation_against_a_loop(spark):
    graphs = {n: {(a, b): round(rnd.uniform(0.2, 1), 3) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.6} | {(k, k + 1): 0.5 for k in range(n - 1)} for n in (2, 3, 6, 13)}
    edges = spark.createDataFrame([(n, a, b, c) for n, es in graphs.items() for (a, b), c in es.items()], "d long, s long, t long, c double")
    told, went = scales.renormalised(edges, "d", starts=4)
    told, went = {(r["d"], r["step"]): r for r in told.collect()}, went.collect()
    steps = 0
    for n, es in graphs.items():
        a = np.zeros((n, n))
        for (i, j), c in es.items():
            a[i, j] = a[j, i] = c
        for step in range(5):
            m = len(a)
            if m <= 2:
                assert (n, step) not in told
                break
            if (a.sum(1) < 1e-10).any():
                a = a + 0.01 * ~np.eye(m, dtype=bool)
            lam = np.linalg.eigvalsh(np.diag(a.sum(1)) - a)
            r = told[n, step]
            assert (r["nodes"], r["edges"], r["density"]) == (m, np.count_nonzero(a) // 2, pytest.approx(np.count_nonzero(a) / m / (m - 1)))
            assert (r["lambda_2"], r["radius"]) == pytest.approx((lam[1], lam[-1]), abs=1e-7)
            label = {x["node"]: x["cluster"] for x in went if x["d"] == n and x["step"] == step}
            assert sorted(label) == list(range(m)) and len(set(label.values())) <= max(2, m // 2)
            h = np.array([[label[i] == c for c in sorted(set(label.values()))] for i in range(m)], float)
            a = h.T @ a @ h
            np.fill_diagonal(a, 0)
            steps += 1
    assert steps > 4


def test_spanning_forest_is_kruskals(spark):
    rows = [(d, a, b, float(rnd.randint(1, 6))) for d, n, p in ((1, 30, 0.2), (2, 12, 0.9), (3, 20, 0.07)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < p]
    rows += [(4, 5, 1, 2.0), (4, 1, 5, 1.0), (4, 3, 3, 0.0), (4, 7, 8, None)]
    edges = spark.createDataFrame(rows, "d long, s long, t long, dist double")
    want = {(d, min(s, t), max(s, t)) for d, s, t, _ in (tuple(r) for r in net.spanning_tree(edges.where("d < 4"), "d").collect())} | {(4, 1, 5)}
    got = net.spanning_forest(edges, "d").collect()
    assert {(r["d"], r["s"], r["t"]) for r in got} == want and len(got) == len(want)
    assert [r["dist"] for r in got if r["d"] == 4] == [1.0]
    assert net.spanning_forest(edges.limit(0), "d").count() == 0
