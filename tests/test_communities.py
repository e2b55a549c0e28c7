"""Communities and spectral features against brute force on small graphs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import communities, graph_features as gf, quadrature as quad

rnd = random.Random(3)
EDGES = "d long, s long, t long, c double"


def quality(edges, label):
    """Modularity of one graph by its definition; edges (s, t, c), loops counting twice."""
    nodes = sorted({x for s, t, _ in edges for x in (s, t)})
    at = {v: k for k, v in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for s, t, c in edges:
        a[at[s], at[t]] += c
        a[at[t], at[s]] += c
    k, m2 = a.sum(1), a.sum()
    same = np.equal.outer([label[v] for v in nodes], [label[v] for v in nodes])
    return ((a - np.outer(k, k) / m2) * same).sum() / m2


def partitions(items):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for p in partitions(rest):
        yield [[first], *p]
        for k in range(len(p)):
            yield [*p[:k], [first, *p[k]], *p[k + 1 :]]


def clique(nodes, c=1.0):
    return [(a, b, c) for a, b in itertools.combinations(nodes, 2)]


GRAPHS = {
    1: clique([1, 2, 3]) + clique([4, 5, 6]) + [(3, 4, 1.0)],
    2: clique(range(5)),
    3: [(0, 1, 1.0), (2, 3, 0.5), (4, 5, 2.0)],
    4: clique([0, 1, 2, 3], 2.0) + clique([4, 5, 6], 3.0) + [(0, 4, 0.5), (1, 5, 0.5), (2, 2, 1.0)],
    5: [(9, 8, 1.0)],
}
BIG = {k: [(a, b, round(rnd.uniform(0.1, 1), 3)) for a, b in itertools.combinations(range(30), 2) if rnd.random() < (0.6 if a % 4 == b % 4 else 0.08)] for k in (10, 11)}


def rows(graphs):
    return [(d, s, t, c) for d, es in graphs.items() for s, t, c in es]


@pytest.fixture(scope="module")
def levels(spark):
    edges = spark.createDataFrame(rows(GRAPHS | BIG) + [(5, 8, 9, 0.25), (5, 7, 8, -1.0), (6, 1, 2, 0.0)], EDGES)
    return communities.louvain(edges, ["d"]).collect()


def test_louvain_finds_the_best_partition_of_small_graphs(levels):
    for d, es in GRAPHS.items():
        es = es + [(8, 9, 0.25)] if d == 5 else es
        nodes = sorted({x for s, t, _ in es for x in (s, t)})
        best = max(quality(es, {v: k for k, part in enumerate(p) for v in part}) for p in partitions(nodes))
        top = max(r["level"] for r in levels if r["d"] == d)
        last = {r["node"]: r["community"] for r in levels if r["d"] == d and r["level"] == top}
        assert set(last) == set(nodes)
        assert quality(es, last) == pytest.approx(best, abs=1e-9), d
    assert not [r for r in levels if r["d"] == 6]


def test_modularity_never_falls_and_no_single_move_gains(levels):
    for d, es in (GRAPHS | BIG).items():
        es = es + [(8, 9, 0.25)] if d == 5 else es
        seen = []
        for level in sorted({r["level"] for r in levels if r["d"] == d}):
            label = {r["node"]: r["community"] for r in levels if r["d"] == d and r["level"] == level}
            told = {round(r["quality"], 9) for r in levels if r["d"] == d and r["level"] == level}
            assert told == {round(quality(es, label), 9)}
            assert all(c == min(v for v in label if label[v] == c) for c in label.values())
            seen.append(told.pop())
        assert seen == sorted(seen)
        if d in BIG:
            first = {r["node"]: r["community"] for r in levels if r["d"] == d and r["level"] == 1}
            for v, c in itertools.product(first, set(first.values())):
                assert quality(es, first | {v: c}) <= quality(es, first) + 1e-9
            assert len(set(label.values())) == 4 and seen[-1] > 0.3


def test_communities_do_not_depend_on_layout(spark):
    edges = spark.createDataFrame(rows(BIG), EDGES)
    one, seven = (sorted(map(tuple, communities.communities(edges.repartition(n), ["d"]).select("d", "node", "community").collect())) for n in (1, 7))
    assert one == seven


# spectra


def dense(es, nodes):
    at = {v: k for k, v in enumerate(nodes)}
    a = np.zeros((len(nodes),) * 2)
    for s, t, c in es:
        a[at[s], at[t]] = a[at[t], at[s]] = c
    root = 1 / np.sqrt(np.where(a.sum(1) == 0, 1, a.sum(1)))
    return a, np.eye(len(nodes)) - root[:, None] * a * root


def test_quadrature_is_exact_for_sums_and_close_for_entropies(spark):
    path = {(k, k + 1): 0.5 for k in range(119)}
    dense_part = {(a, b): rnd.uniform(0.2, 1) for a, b in itertools.combinations(range(120), 2) if rnd.random() < 0.08}
    graph = {1: clique([1, 2, 3, 4]) + [(4, 5, 2.0)], 2: [(a, b, c) for (a, b), c in (path | dense_part).items()]}
    points = quad.quadrature(quad.lanczos(spark.createDataFrame(rows(graph), EDGES), ["d"], probes=12, steps=10), "d")
    got = {r["d"]: r for r in quad.functionals(points, "d").collect()}
    signs = [spark.range(121).select(F.when(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(k)), F.lit(2)) == 0, 1.0).otherwise(-1.0)).toPandas().to_numpy()[:, 0] for k in range(12)]
    for d, es in graph.items():
        nodes = sorted({x for s, t, _ in es for x in (s, t)})
        lap = dense(es, nodes)[1]
        drawn = lambda m: np.mean([x[nodes] @ m @ x[nodes] for x in signs])  # noqa: E731, B023
        assert got[d]["ev_nodes"] == pytest.approx(len(nodes))
        assert got[d]["ev_sum"] == pytest.approx(drawn(lap), abs=1e-7)
        assert got[d]["ev_energy"] == pytest.approx(drawn(lap @ lap), abs=1e-7)
    lam = np.linalg.eigvalsh(dense(graph[2], range(120))[1])
    share = lam[lam > 1e-9] / lam.sum()
    assert got[2]["ev_entropy"] == pytest.approx(-(share * np.log(share)).sum(), rel=0.05)
    assert got[2]["ev_sum"] == pytest.approx(120, rel=0.08)


def test_gauss_rule_of_a_full_run_is_the_spectrum(spark):
    """A probe of signs on a path of two nodes is an eigenvector or splits evenly; on a star all values are met."""
    es = [(0, k, 1.0 + k) for k in range(1, 5)]
    tri = quad.lanczos(spark.createDataFrame([(1, *e) for e in es], EDGES), ["d"], probes=3, steps=9)
    lam = np.linalg.eigvalsh(dense(es, range(5))[1])
    for r in quad.quadrature(tri, "d").collect():
        assert np.abs(lam - r["lambda"]).min() < 1e-6 or r["weight"] < 1e-9


def brute_features(es, nodes):
    n = len(nodes)
    a, lap = dense([(s, t, c) for s, t, c in es], nodes)
    lam, vec = np.linalg.eigh(lap)
    w, k, up = a.sum(1), (a > 0).sum(1).astype(float), a[np.triu_indices(n, 1)]
    c = up[up > 0]
    m = lambda x, p: 0.0 if len(x) < 3 or x.std() < 1e-12 else ((x - x.mean()) ** p).mean() / x.std() ** p - (3 if p == 4 else 0)
    some = c if len(c) else np.zeros(1)
    pos = lam[lam > 1e-10]
    r = np.cbrt(a / a.max()) if a.max() else a
    tri = np.array([(r[i][:, None] * r * r[i][None, :]).sum() / 2 for i in range(n)])
    closed = np.array([((a[i] > 0)[:, None] * (a > 0) * (a[i] > 0)[None, :]).sum() / 2 for i in range(n)])
    pairs = np.where(k > 1, k * (k - 1) / 2, 1)
    seen, sizes = set(), []
    for v in range(n):
        part, todo = set(), [v]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x), part.add(x)
                todo += list(np.nonzero(a[x])[0])
        sizes.append(len(part))
    sizes = sorted((x for x in sizes if x), reverse=True)
    gaps = np.diff(lam)[1 : max(2, n // 2)]
    i, j = np.nonzero(a)
    mix = lambda x: 0.0 if len(i) < 4 or x[i].std() < 1e-12 else np.corrcoef(x[i], x[j])[0, 1]
    return {
        "n": n, "n_edges": len(c), "weight_sum": c.sum(), "corr_mean": some.mean(), "corr_std": some.std(), "corr_q25": np.percentile(some, 25), "corr_q90": np.percentile(some, 90), "corr_skew": m(c, 3), "corr_kurt": m(c, 4),
        "k_avg": k.mean(), "k_std": k.std(), "w_max": w.max(), "w_min": w.min(), "w_std": w.std(), "w_skew": m(w, 3), "w_kurt": m(w, 4), "k_skew": m(k, 3),
        "n_components": len(sizes), "second_component": (sizes[1] if len(sizes) > 1 else 0) / n, "clustering_coeff": np.where(k > 1, closed / pairs, 0).mean(), "weighted_clustering": np.where(k > 1, tri / pairs, 0).mean(),
        "assortativity": mix(k), "strength_assortativity": mix(w) if len(i) > 3 else 0.0, "lam2": lam[1], "lam3": lam[2], "lam4": lam[3], "rho": lam[-1], "gap": gaps.max(),
        "ev_sum": lam.sum(), "ev_energy": (lam**2).sum(), "ev_std": lam.std(), "ev_entropy_raw": -(pos * np.log(pos + 1e-15)).sum(), "ev_entropy": -(pos / pos.sum() * np.log(pos / pos.sum())).sum(),
        "resistance": np.trace(np.linalg.pinv(lap)) / n, "laplacian_energy": np.abs(lam - 2 * len(c) / n).sum(), "density": 2 * len(c) / n / (n - 1),
    }


@pytest.fixture(scope="module")
def feature_rows(spark):
    graphs = {d: [(a, b, round(rnd.uniform(0.3, 1), 4)) for a, b in itertools.combinations(range(9), 2) if rnd.random() < 0.1 * d] for d in range(1, 8)} | {8: [], 9: clique(range(9)), 10: [(0, 1, 0.5), (2, 3, 0.5)]}
    graphs[1] = [(0, 1, 0.9)]
    nodes = spark.createDataFrame([(d, v, rnd.random(), rnd.random(), 0.1, rnd.random(), rnd.random()) for d in graphs for v in range(9)], "d long, node long, vol double, mean double, growth double, beta double, momentum double")
    return graphs, gf.all_features(spark.createDataFrame(rows(graphs), EDGES), nodes)


def test_every_feature_has_its_value(feature_rows):
    graphs, found = feature_rows
    got = {r["d"]: r.asDict() for r in found.collect()}
    assert set(got) == set(graphs)
    for d, es in graphs.items():
        want = brute_features(es, list(range(9)))
        for name, x in want.items():
            tied = name in ("strength_assortativity", "assortativity") and len(es) < 3
            assert tied or got[d][name] == pytest.approx(x, abs=1e-7), (d, name)


def test_feature_sets_are_whole_and_look_back(feature_rows):
    graphs, found = feature_rows
    assert len(gf.walk_features(found).columns) == 37 and len(gf.binary_features(found).columns) == 37
    deep = gf.deep_features(found)
    got = {r["d"]: r for r in deep.collect()}
    assert sorted(got) == [4, 5, 6, 7, 8, 9] and len(deep.columns) >= 60
    base = {r["d"]: r["lam2"] for r in found.collect()}
    for d, r in got.items():
        assert (r["lam2_lag1"], r["lam2_lag3"], r["target_lam2_next"]) == (base[d - 1], base[d - 3], base[d + 1])
        assert r["lam2_rmean5"] == pytest.approx(np.mean([base[k] for k in range(max(1, d - 4), d + 1)]))
    walk = {r["d"]: r for r in gf.walk_features(found).collect()}
    assert walk[1]["lam2_change"] == 0 and walk[5]["lam2_change"] == pytest.approx(base[5] - base[4])
    assert not [c for r in walk.values() for c in r if c is None] and not [c for r in gf.binary_features(found).collect() for c in r if c is None]


def test_noise_fit_against_numpy(spark):
    r = np.random.default_rng(6)
    held, length = {}, 60
    for d, (n, load) in {1: (12, 0.0), 2: (15, 1.5), 3: (3, 0.0), 4: (40, 0.5)}.items():
        x = r.normal(size=(length, n)) + load * r.normal(size=(length, 1))
        held[d] = np.corrcoef(x.T)
    frame = spark.createDataFrame([(d, i, j, float(c[i, j])) for d, c in held.items() for i, j in itertools.combinations(range(len(c)), 2)], EDGES)
    got = {row["d"]: row for row in quad.noise_fit(quad.correlation_spectrum(frame, "d"), "d", length).collect()}
    for d, c in held.items():
        lam, q = np.linalg.eigvalsh(c), (len(c) / length) ** 0.5
        low, high = (1 - q) ** 2, (1 + q) ** 2
        noise = np.sort(lam[lam <= high])
        f, k = np.clip((noise - low) / (high - low), 0, 1), np.arange(1, len(noise) + 1)
        ks = max((k / len(noise) - f).max(), (f - (k - 1) / len(noise)).max()) if len(noise) > 3 else 0.0
        assert (got[d]["n_signal"], got[d]["n_noise"]) == ((lam > high).sum(), len(noise))
        assert (got[d]["lambda_plus"], got[d]["ks"]) == pytest.approx((high, ks)) and 0 <= got[d]["p"] <= 1
    assert got[2]["n_signal"] >= 1 and got[3]["p"] == 1
