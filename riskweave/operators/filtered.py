"""Sparse networks from dense correlations: the planar filtered graph, and partial correlations of a graphical lasso.

A planar graph is grown edge by edge, which can't be parted, so a snapshot is one task and snapshots are spread over tasks. The lasso's
covariances of all snapshots and folds are aggregates in Spark; what is left to a task is one matrix, one fold and one penalty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.sources.scratch import materialise


class Planar:
    """A planar graph that takes an edge only if it stays planar, by the left-right criterion (de Fraysseix and Rosenstiehl; Brandes, 2009).

    An edge between two components is always taken; any other is tested within its own component.
    """

    def __init__(self) -> None:
        self.near: dict = {}
        self.edges = 0

    def _component(self, a) -> set:
        seen, todo = {a}, [a]
        while todo:
            for w in self.near[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    def add(self, a, b) -> bool:
        """Take the edge if the graph stays planar; an edge that is there already, or a loop, is refused."""
        if a == b or b in self.near.setdefault(a, {}):
            return False
        self.near.setdefault(b, {})
        part = self._component(a)
        self.near[a][b] = self.near[b][a] = None
        if b in part and not _left_right(self.near, a, len(part)):
            del self.near[a][b], self.near[b][a]
            return False
        self.edges += 1
        return True


class _Test:
    """One left-right test. Edges are ordered pairs; a conflict pair is [left low, left high, right low, right high] of back edges, None where empty."""

    def __init__(self, near: dict) -> None:
        self.near = near
        self.height: dict = {}
        self.parent: dict = {}
        self.low: dict = {}
        self.low2: dict = {}
        self.out: dict = {}
        self.stack: list = []
        self.ref: dict = {}
        self.back: dict = {}
        self.base: dict = {}

    def orient(self, root) -> None:
        """Depth-first: directs every edge and finds the two lowest heights that return edges reach."""
        self.height[root], self.parent[root], self.out[root] = 0, None, []
        todo = [(root, iter(self.near[root]))]
        while todo:
            v, rest = todo[-1]
            w = next(rest, None)
            if w is None:
                todo.pop()
                e = self.parent[v]
                if e is not None:
                    self._pass_up(e)
                continue
            if (v, w) in self.low or (w, v) in self.low:
                continue
            e = (v, w)
            self.out[v].append(w)
            self.low[e] = self.low2[e] = self.height[v]
            if w in self.height:
                self.low[e] = self.height[w]
                self._pass_up(e)
            else:
                self.height[w], self.parent[w], self.out[w] = self.height[v] + 1, e, []
                todo.append((w, iter(self.near[w])))

    def _pass_up(self, e) -> None:
        up = self.parent[e[0]]
        if up is None:
            return
        if self.low[e] < self.low[up]:
            self.low2[up] = min(self.low[up], self.low2[e])
            self.low[up] = self.low[e]
        elif self.low[e] > self.low[up]:
            self.low2[up] = min(self.low2[up], self.low[e])
        else:
            self.low2[up] = min(self.low2[up], self.low2[e])

    def _nesting(self, e) -> int:
        return 2 * self.low[e] + (self.low2[e] < self.height[e[0]])

    def _conflicts(self, high, e) -> bool:
        return high is not None and self.low[high] > self.low[e]

    def planar(self, root) -> bool:
        """Depth-first again, out-edges by nesting: may all return edges be put left or right?"""
        order = lambda v: iter(sorted(self.out[v], key=lambda w: self._nesting((v, w))))
        todo = [(root, order(root), [])]
        while todo:
            v, rest, first = todo[-1]
            w = next(rest, None)
            if w is None:
                todo.pop()
                e = self.parent[v]
                if e is not None:
                    self._trim(e)
                    if not self._returned(e, todo[-1][2]):
                        return False
                continue
            e = (v, w)
            self.base[e] = len(self.stack)
            if self.parent.get(w) == e:
                todo.append((w, order(w), []))
            else:
                self.back[e] = e
                self.stack.append([None, None, e, e])
                if not self._returned(e, first):
                    return False
        return True

    def _returned(self, e, first: list) -> bool:
        """After edge ``e`` of its tail: its return edges are set against those of the edges before it."""
        v = e[0]
        leading = not first
        first.append(e)
        if self.low[e] >= self.height[v]:
            return True
        up = self.parent[v]
        if leading:
            self.back[up] = self.back[e]
            return True
        return self._constrain(e, up)

    def _constrain(self, e, up) -> bool:
        low, ref, stack = self.low, self.ref, self.stack
        new = [None, None, None, None]
        while True:  # return edges of e go to the right
            q = stack.pop()
            if q[0] is not None:
                q[:] = q[2:] + q[:2]
            if q[0] is not None:
                return False
            if low[q[2]] > low[up]:
                if new[3] is None:
                    new[3] = q[3]
                else:
                    ref[new[2]] = q[3]
                new[2] = q[2]
            else:
                ref[q[2]] = self.back[up]
            if len(stack) == self.base[e]:
                break
        while stack and (self._conflicts(stack[-1][1], e) or self._conflicts(stack[-1][3], e)):  # those of earlier edges that conflict go to the left
            q = stack.pop()
            if self._conflicts(q[3], e):
                q[:] = q[2:] + q[:2]
            if self._conflicts(q[3], e):
                return False
            ref[new[2]] = q[3]
            if q[2] is not None:
                new[2] = q[2]
            if new[1] is None:
                new[1] = q[1]
            else:
                ref[new[0]] = q[1]
            new[0] = q[0]
        if new != [None] * 4:
            stack.append(new)
        return True

    def _trim(self, e) -> None:
        """Return edges that end at the tail of tree edge ``e`` are done with."""
        u, low, ref, stack = e[0], self.low, self.ref, self.stack
        while stack and min(low[x] for x in (stack[-1][0], stack[-1][2]) if x is not None) == self.height[u]:
            stack.pop()
        if stack:
            p = stack[-1]
            for a, b, other in ((0, 1, 2), (2, 3, 0)):
                while p[b] is not None and p[b][1] == u:
                    p[b] = ref.get(p[b])
                if p[b] is None and p[a] is not None:
                    ref[p[a]] = p[other]
                    p[a] = None
        if low[e] < self.height[u]:
            left, right = stack[-1][1], stack[-1][3]
            ref[e] = left if left is not None and (right is None or low[left] > low[right]) else right


def _left_right(near: dict, root, nodes: int) -> bool:
    """Is the component of ``root`` planar?"""
    if nodes < 5:
        return True
    test = _Test(near)
    test.orient(root)
    return len(test.low) <= 3 * nodes - 6 and test.planar(root)


def planar_filtered(correlations: DataFrame, by: str) -> DataFrame:
    """(by, s, t, c): of each snapshot's pairs (s, t, c), from the largest down, those that keep the graph planar, 3 (nodes - 2) at most. Ties go to larger ends; null correlations are left out."""
    rows = correlations.select(by, "s", "t", "c").where("c IS NOT NULL")

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["c", "s", "t"], ascending=False)
        n = len(set(group["s"]) | set(group["t"]))
        graph, kept = Planar(), []
        for k, (s, t) in enumerate(zip(group["s"], group["t"], strict=True)):
            if graph.edges >= max(1, 3 * (n - 2)):
                break
            if graph.add(s, t):
                kept.append(k)
        return group.iloc[kept]

    return rows.groupBy(by).applyInPandas(grow, rows.schema)


# graphical lasso


def cross_products(series: DataFrame, by: list[str], key: str, value: str, time: str) -> DataFrame:
    """(by, s, t, n, x, y, xy): counts, sums and sums of products over the times that both series (by, key, time, value) have, s <= t."""
    a = series.select(*by, time, F.col(key).alias("s"), F.col(value).alias("_x"))
    b = series.select(*by, time, F.col(key).alias("t"), F.col(value).alias("_y"))
    return a.join(b, [*by, time]).where("s <= t").groupBy(*by, "s", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.col("_x") * F.col("_y")).alias("xy"))


def fold_covariances(series: DataFrame, by: list[str], key: str, value: str, time: str, folds: int) -> DataFrame:
    """(by, fold, s, t, c, held): covariances (over n) of all times but those of a fold, and of the fold; fold -1 leaves nothing out.

    Folds are runs of times, as even as can be; products are summed once by fold and what a fold leaves is a difference of sums.
    """
    times = series.select(*by, time).distinct()
    at = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    times = times.withColumn("fold", F.floor((F.row_number().over(at.orderBy(time)) - 1) * folds / F.count(F.lit(1)).over(at)).cast("int"))
    part = materialise(cross_products(series.join(times, [*by, time]), [*by, "fold"], key, value, time))
    names = ("n", "x", "y", "xy")
    total = part.groupBy(*by, "s", "t").agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    cov = lambda n, x, y, xy: F.when(n > 0, xy / n - (x / n) * (y / n))
    left = part.join(total, [*by, "s", "t"]).select(*by, "fold", "s", "t", cov(*(F.col(f"all_{c}") - F.col(c) for c in names)).alias("c"), cov(*map(F.col, names)).alias("held"))
    return left.unionByName(total.select(*by, F.lit(-1).alias("fold"), "s", "t", cov(*(F.col(f"all_{c}") for c in names)).alias("c"), F.lit(None).cast("double").alias("held")))


def lasso(s: np.ndarray, penalty: float, tolerance: float = 1e-9, rounds: int = 2000) -> np.ndarray:
    """The precision matrix that maximises log det P - tr(S P) - penalty * the sum of |P| off the diagonal, by block coordinate descent (Friedman, Hastie and Tibshirani, 2008)."""
    n = len(s)
    w, beta = s.copy(), np.zeros((n, n))
    scale = np.abs(s - np.diag(np.diag(s))).max() if n > 1 else 0.0
    for _ in range(rounds):
        before = w.copy()
        for j in range(n):
            rest = np.delete(np.arange(n), j)
            block, b, target = w[np.ix_(rest, rest)], beta[rest, j], s[rest, j]
            fit = block @ b
            for _ in range(rounds):
                most = 0.0
                for k in range(n - 1):
                    free = target[k] - fit[k] + block[k, k] * b[k]
                    new = np.sign(free) * max(abs(free) - penalty, 0.0) / block[k, k]
                    if new != b[k]:
                        step = new - b[k]
                        fit += block[:, k] * step
                        b[k] = new
                        most = max(most, abs(step) * block[k, k])
                if most <= tolerance * max(scale, 1e-300):
                    break
            beta[rest, j] = b
            w[rest, j] = w[j, rest] = fit
        if np.abs(w - before).max() <= tolerance * max(scale, 1e-300):
            break
    p = np.zeros((n, n))
    for j in range(n):
        rest = np.delete(np.arange(n), j)
        p[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        p[rest, j] = -beta[rest, j] * p[j, j]
    return (p + p.T) / 2


def _square(group: pd.DataFrame, c: str) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([group["s"], group["t"]]))
    out = np.zeros((len(nodes),) * 2)
    i, j = np.searchsorted(nodes, group["s"]), np.searchsorted(nodes, group["t"])
    out[i, j] = out[j, i] = group[c]
    return nodes, out


def precisions(covariances: DataFrame, by: str, penalties: list[float]) -> DataFrame:
    """(by, fold, share, penalty, s, t, p, score): the lasso's precision for each fold and penalty, and the log-likelihood of what the fold held out.

    Penalties are ``penalties`` times the largest covariance off the diagonal, over which a network has no edge. ``covariances`` comes of ``fold_covariances``; a task holds the matrix of one snapshot, fold and penalty.
    """
    kind = dict(covariances.dtypes)
    rows = covariances.select(by, "fold", "s", "t", "c", "held", F.explode(F.array(*map(F.lit, map(float, penalties)))).alias("share"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        nodes, s = _square(group, "c")
        _, held = _square(group, "held")
        share = float(group["share"].iloc[0])
        penalty = share * (np.abs(s - np.diag(np.diag(s))).max() if len(nodes) > 1 else 0.0)
        p = lasso(s, penalty)
        score = np.linalg.slogdet(p)[1] - (held * p).sum() if group["fold"].iloc[0] >= 0 else np.nan
        i, j = np.triu_indices(len(nodes))
        return pd.DataFrame({by: group[by].iloc[0], "fold": group["fold"].iloc[0], "share": share, "penalty": penalty, "s": nodes[i], "t": nodes[j], "p": p[i, j], "score": score})

    return rows.groupBy(by, "fold", "share").applyInPandas(fit, f"{by} {kind[by]}, fold int, share double, penalty double, s {kind['s']}, t {kind['t']}, p double, score double")


def partial_correlations(series: DataFrame, by: str, key: str, value: str, time: str, penalties: list[float], folds: int = 5, threshold: float = 0.1) -> DataFrame:
    """(by, s, t, c, partial, share): edges of the graphical lasso whose penalty does best on folds, ties to the larger; ``c`` is the size of the partial correlation, ``threshold`` at least.

    Series that are flat in a snapshot take no part in it, nor do times at which a series has no value.
    """
    moving = series.groupBy(by, key).agg(F.stddev_pop(value).alias("_sd"), F.count(F.lit(1)).alias("_n")).where("_sd > 0")
    whole = moving.groupBy(by).agg(F.count(F.lit(1)).alias("_keys"))
    live = series.join(moving.select(by, key), [by, key], "left_semi")
    full = live.groupBy(by, time).agg(F.count(F.lit(1)).alias("_here")).join(whole, by).where("_here = _keys").select(by, time)
    fits = materialise(precisions(fold_covariances(live.join(full, [by, time], "left_semi"), [by], key, value, time, folds), by, penalties))
    scores = fits.where("fold >= 0").groupBy(by, "share", "fold").agg(F.first("score").alias("score")).groupBy(by, "share").agg(F.avg("score").alias("score"))
    best = scores.groupBy(by).agg(F.max(F.struct("score", "share")).alias("m")).select(by, F.col("m.share").alias("share"))
    chosen = fits.where("fold = -1").join(best, [by, "share"])
    own = chosen.where("s = t")
    rows = chosen.where("s != t").join(own.select(by, "s", F.col("p").alias("_a")), [by, "s"]).join(own.select(by, "t", F.col("p").alias("_b")), [by, "t"])
    partial = -F.col("p") / F.sqrt(F.col("_a") * F.col("_b"))
    return rows.select(by, "s", "t", F.abs(partial).alias("c"), partial.alias("partial"), "share").where(F.col("c") >= threshold)
