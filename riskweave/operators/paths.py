"""Shortest-path and eigenvector centralities of each snapshot, and names of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


def _schema(edges: DataFrame, by: list[str], *measures: str) -> StructType:
    return StructType([*(edges.schema[b] for b in by), StructField("node", LongType()), *(StructField(m, DoubleType()) for m in measures)])


def _matrix(g: pd.DataFrame, none: float) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([g["source"], g["target"]]))
    w = np.full((len(nodes),) * 2, none)
    for a, b, x in zip(np.searchsorted(nodes, g["source"]), np.searchsorted(nodes, g["target"]), g["weight"], strict=True):
        w[a, b] = x if not np.isfinite(w[a, b]) or none == 0 and w[a, b] == 0 else min(w[a, b], x)
    return nodes, w


def centralities(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, degree, closeness, betweenness) of (by, source, target, weight); a weight is a distance.

    Degree counts both directions. Closeness is of the distances to a node, scaled by the share of nodes that reach it. All distances of a
    snapshot, which is small, are held by one task.
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _matrix(g, np.inf)
        n = len(nodes)
        degree = (np.isfinite(w).sum(0) + np.isfinite(w).sum(1)) / max(1, n - 1)
        np.fill_diagonal(w, 0)
        dist = w
        for k in range(n):
            dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1, :])
        reach = np.isfinite(dist).sum(0) - 1
        total = np.where(np.isfinite(dist), dist, 0).sum(0)
        closeness = np.where(total > 0, reach * reach / np.maximum(total, 1e-300) / max(1, n - 1), 0)
        # numbers of shortest paths, nearer targets first
        tight = np.isfinite(w) & ~np.eye(n, dtype=bool)
        paths = np.eye(n)
        for s in range(n):
            for t in np.argsort(dist[s], kind="stable"):
                if t != s and np.isfinite(dist[s, t]):
                    last = tight[:, t] & np.isclose(dist[s] + w[:, t], dist[s, t], rtol=1e-12, atol=1e-12)
                    paths[s, t] = paths[s, last].sum()
        between = np.zeros(n)
        for v in range(n):
            on = np.isclose(dist[:, v : v + 1] + dist[v : v + 1, :], dist, rtol=1e-12, atol=1e-12) & np.isfinite(dist) & ~np.eye(n, dtype=bool)
            on[v, :] = on[:, v] = False
            between[v] = (paths[:, v : v + 1] * paths[v : v + 1, :] / np.maximum(paths, 1))[on].sum()
        between /= max(1, (n - 1) * (n - 2))
        return pd.DataFrame({**{b: g[b].iloc[0] for b in by}, "node": nodes, "degree": degree, "closeness": closeness, "betweenness": between})

    return edges.groupBy(*by).applyInPandas(kernel, _schema(edges, by, "degree", "closeness", "betweenness"))


def eigenvector(edges: DataFrame, by: list[str], rounds: int = 100) -> DataFrame:
    """(by, node, eigenvector): the main eigenvector of the weights in both directions, of length 1, after ``rounds`` of the power method with a shift of one."""

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _matrix(g, 0.0)
        x = np.ones(len(nodes))
        for _ in range(rounds):
            x = x + (w + w.T) @ x
            x /= np.sqrt((x * x).sum())
        return pd.DataFrame({**{b: g[b].iloc[0] for b in by}, "node": nodes, "eigenvector": x})

    return edges.groupBy(*by).applyInPandas(kernel, _schema(edges, by, "eigenvector"))


def cluster_names(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, cluster) with the name of each node's cluster (node, k); a node without one is an error."""
    found = nodes.join(clusters, "node", "left")
    name = F.when(F.col("k").isNull(), F.raise_error(F.concat(F.lit("no cluster for node "), F.col("node").cast("string")))).otherwise(F.concat(F.lit("cluster_"), F.col("k").cast("string")))
    return found.select("node", name.cast("string").alias("cluster"))
