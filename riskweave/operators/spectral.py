"""Spectra of networks. A dense eigensolver runs per snapshot; all before and after it is relational.

A snapshot's matrix is as large as its nodes squared, so kernels are for networks of up to
a few thousand nodes; snapshots are spread over tasks by their key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.components import connected_components


def _matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([group["s"].to_numpy(), group["t"].to_numpy()]))
    a = np.zeros((len(nodes), len(nodes)))
    i, j = np.searchsorted(nodes, group["s"].to_numpy()), np.searchsorted(nodes, group["t"].to_numpy())
    a[i, j] = a[j, i] = group["c"].to_numpy()
    return nodes, a


def _laplacian(a: np.ndarray, normalised: bool) -> np.ndarray:
    deg = a.sum(1)
    if not normalised:
        return np.diag(deg) - a
    root = 1 / np.sqrt(np.where(deg == 0, 1.0, deg))
    return np.eye(len(a)) - root[:, None] * a * root


def modes(edges: DataFrame, by: str, normalised: bool = True) -> DataFrame:
    """(by, mode, lambda, node, v): eigenpairs of the Laplacian of each snapshot's undirected edges (s, t, c).

    Values ascend; a vector's component largest in size is positive. Tiny negative values become 0.
    """
    kind = dict(edges.dtypes)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _matrix(group)
        values, vectors = np.linalg.eigh(_laplacian(a, normalised))
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(nodes))] < 0, -1.0, 1.0)
        n = len(nodes)
        return pd.DataFrame({by: group[by].iloc[0], "mode": np.repeat(np.arange(n), n), "lambda": np.repeat(np.where(np.abs(values) < 1e-9, 0.0, values), n), "node": np.tile(nodes, n), "v": vectors.T.ravel()})

    return edges.select(by, "s", "t", "c").groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, mode long, lambda double, node {kind['s']}, v double")


def spectrum(mode_rows: DataFrame, by: str) -> DataFrame:
    """(by, nodes, lambda_2, radius, spectral sum and sum of squares, largest gap after the first value and its place)."""
    values = mode_rows.select(by, "mode", "lambda").distinct()
    w = Window.partitionBy(by).orderBy("mode")
    values = values.withColumn("gap", F.lead("lambda").over(w) - F.col("lambda"))
    inner = F.when(F.col("mode") >= 1, F.struct("gap", -F.col("mode")))
    out = values.groupBy(by).agg(
        F.count(F.lit(1)).alias("nodes"), F.max(F.when(F.col("mode") == 1, F.col("lambda"))).alias("lambda_2"), F.max("lambda").alias("radius"),
        F.sum("lambda").alias("total"), F.sum(F.col("lambda") * F.col("lambda")).alias("squares"), F.max(inner).alias("_widest"),
    )
    return out.select(by, "nodes", "lambda_2", "radius", "total", "squares", F.col("_widest.gap").alias("gap"), (-F.col("_widest.col2")).alias("gap_mode"))


def participation(mode_rows: DataFrame, by: str) -> DataFrame:
    """(by, mode, lambda, participation): (sum v^2)^2 / sum v^4."""
    return mode_rows.groupBy(by, "mode").agg(F.max("lambda").alias("lambda"), (F.pow(F.sum(F.col("v") * F.col("v")), 2) / F.sum(F.pow("v", F.lit(4.0)))).alias("participation"))


def diffusion_distance(mode_rows: DataFrame, by: str, t: float, k: int | None = None) -> DataFrame:
    """(by, a, b, dist): root of the sum over modes 1..k-1 of exp(-2 t lambda) (v_a - v_b)^2."""
    rows = mode_rows.where(F.col("mode") >= 1) if k is None else mode_rows.where(F.col("mode").between(1, k - 1))
    a = rows.select(by, "mode", "lambda", F.col("node").alias("a"), F.col("v").alias("va"))
    b = rows.select(by, "mode", F.col("node").alias("b"), F.col("v").alias("vb"))
    pairs = a.join(b, [by, "mode"]).where("a < b")
    return pairs.groupBy(by, "a", "b").agg(F.sqrt(F.sum(F.exp(-2 * t * F.col("lambda")) * F.pow(F.col("va") - F.col("vb"), 2))).alias("dist"))


def embedding(mode_rows: DataFrame, by: str, dim: int) -> DataFrame:
    """(by, node, coordinates): components of modes 1..dim."""
    rows = mode_rows.where(F.col("mode").between(1, dim))
    return rows.groupBy(by, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("mode", "v"))), lambda x: x["v"]).alias("coordinates"))


def coarse_weights(mode_rows: DataFrame, edges: DataFrame, by: str, k: int) -> DataFrame:
    """(by, s, t, w): weights of the coarse-grained Laplacian of the first ``k`` + 1 modes, on the original edges."""
    rows = mode_rows.where(F.col("mode") <= k)
    a = rows.select(by, "mode", "lambda", F.col("node").alias("s"), F.col("v").alias("vs"))
    b = rows.select(by, "mode", F.col("node").alias("t"), F.col("v").alias("vt"))
    full = a.join(b, [by, "mode"]).where("s < t").groupBy(by, "s", "t").agg((-F.sum(F.col("lambda") * F.col("vs") * F.col("vt"))).alias("w"))
    return full.join(edges.select(by, "s", "t").distinct(), [by, "s", "t"], "left_semi")


def contracted(weights: DataFrame) -> DataFrame:
    """(node, component) of the nodes that negative coarse weights (s, t, w) join."""
    return connected_components(weights.where("w < 0"), "s", "t")


def fiedler_sides(mode_rows: DataFrame, by: str) -> DataFrame:
    """(by, node, side): 1 where the second mode's component is at least 0."""
    return mode_rows.where("mode = 1").select(by, "node", F.when(F.col("v") >= 0, 1).otherwise(0).cast("long").alias("side"))


def heat(mode_rows: DataFrame, by: str, sources: DataFrame, t: float) -> DataFrame:
    """(by, node, p): heat after time t from one unit at the node that ``sources`` (by, node) names for each snapshot."""
    start = mode_rows.join(sources, [by, "node"]).select(by, "mode", F.col("v").alias("v0"))
    return mode_rows.join(start, [by, "mode"]).groupBy(by, "node").agg(F.sum(F.exp(-t * F.col("lambda")) * F.col("v0") * F.col("v")).alias("p"))


def marchenko_pastur(length: int, n: int) -> tuple[float, float]:
    """Bounds of the eigenvalues of a correlation matrix of noise."""
    q = math.sqrt(n / length)
    return (1 - q) ** 2, (1 + q) ** 2


def shrunk(correlations: DataFrame, length: int, n: int) -> DataFrame:
    """``c`` shrunk towards the identity by min(1, n / length)."""
    return correlations.withColumn("c", (1 - min(1.0, n / length)) * F.col("c"))


def denoised(correlations: DataFrame, by: str, length: int) -> DataFrame:
    """(by, s, t, c): eigenvalues up to the noise bound replaced by their mean, diagonal kept at one."""
    kind = dict(correlations.dtypes)

    def clean(group: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _matrix(group)
        np.fill_diagonal(a, 1.0)
        values, vectors = np.linalg.eigh(a)
        noise = values <= marchenko_pastur(length, len(nodes))[1]
        if noise.any():
            values = np.where(noise, values[noise].mean(), values)
        a = vectors * values @ vectors.T
        scale = np.sqrt(np.diag(a))
        a = a / scale[:, None] / scale
        i, j = np.triu_indices(len(nodes), 1)
        return pd.DataFrame({by: group[by].iloc[0], "s": nodes[i], "t": nodes[j], "c": a[i, j]})

    return correlations.select(by, "s", "t", "c").groupBy(by).applyInPandas(clean, f"{by} {kind[by]}, s {kind['s']}, t {kind['t']}, c double")


def gap_test(edges: DataFrame, by: str, ensemble: int = 1000, alpha: float = 0.01, seed: int = 42) -> DataFrame:
    """(by, index, gap, p): the first gap wider than random graphs of the same mean degree have, else the widest.

    Each random edge is drawn in both directions with the same chance; graphs with an isolated node are drawn anew, five times at most.
    """
    kind = dict(edges.dtypes)

    def test(group: pd.DataFrame) -> pd.DataFrame:
        nodes, a = _matrix(group)
        n = len(nodes)
        gaps = np.diff(np.linalg.eigvalsh(_laplacian(a, True)))
        if n < 4:
            return pd.DataFrame({by: [group[by].iloc[0]], "index": [1], "gap": [float(gaps[-1]) if len(gaps) else 0.0], "p": [1.0]})
        chance = float(np.clip((a > 0).sum() / n / (n - 1), 0.05, 0.95))
        rng, drawn = np.random.default_rng(seed), []
        for _ in range(5):
            g = np.triu(rng.random((ensemble, n, n)) < chance, 1) | np.triu(rng.random((ensemble, n, n)) < chance, 1)
            g = (g | g.transpose(0, 2, 1)).astype(float)
            drawn.append(g[(g.sum(2) > 0).all(1)])
            if sum(map(len, drawn)) >= ensemble:
                break
        g = np.concatenate(drawn)[:ensemble]
        upper, best = max(2, n // 2), None
        if len(g) >= 50:
            root = 1 / np.sqrt(g.sum(2))
            null = np.diff(np.linalg.eigvalsh(np.eye(n) - root[:, :, None] * g * root[:, None, :]), axis=1)
            p = (null >= gaps).mean(0)
            best = next(((k, p[k]) for k in range(1, upper) if p[k] < alpha), None)
        k, pk = best or (1 + int(gaps[1:upper].argmax()), 1.0)
        return pd.DataFrame({by: [group[by].iloc[0]], "index": [k], "gap": [float(gaps[k])], "p": [float(pk)]})

    return edges.select(by, "s", "t", "c").groupBy(by).applyInPandas(test, f"{by} {kind[by]}, index long, gap double, p double")
