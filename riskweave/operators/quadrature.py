"""Functions of a network's spectrum: exact values of small snapshots, and stochastic Lanczos quadrature over the edge table of large ones.

Quadrature never forms a matrix. Probe vectors of signs come from hashes of node and probe, so nothing is drawn twice; one
step multiplies all probes of all snapshots at once, as a join of links with vectors and a sum by node. What a probe gathers is a small tridiagonal matrix, whose
eigenvalues and first components are nodes and weights of a Gauss rule (Ubaru, Chen and Saad, 2017). Every step is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.spectral import _laplacian, _matrix
from riskweave.sources.scratch import forget, held, materialise

#: Values up to this count as zero.
EPS = 1e-10


def values(edges: DataFrame, nodes: DataFrame, by: str, normalised: bool = True) -> DataFrame:
    """(by, mode, lambda, quartic) of each snapshot's Laplacian, one row a value; ``quartic`` is the sum of fourth powers of the mode's vector.

    ``nodes`` (by, node) adds those without an edge (s, t, c); a snapshot is held by one task, for networks of up to a few thousand nodes.
    """
    kind = dict(edges.dtypes)
    rows = edges.select(by, "s", "t", "c").unionByName(nodes.select(by, F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0.0).alias("c")))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        found, vectors = np.linalg.eigh(_laplacian(_matrix(group)[1], normalised))
        return pd.DataFrame({by: group[by].iloc[0], "mode": np.arange(len(found)), "lambda": np.where(np.abs(found) < 1e-9, 0.0, found), "quartic": (vectors**4).sum(0)})

    return rows.groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, mode long, lambda double, quartic double")


def _norms(by: list[str], rows: DataFrame, probes: int, what) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.sum(what(k)).alias(f"n{k}") for k in range(probes)))


def lanczos(edges: DataFrame, by: list[str], probes: int = 8, steps: int = 16) -> DataFrame:
    """(by, probe, step, alpha, beta, nodes): tridiagonal matrices of the normalised Laplacian of undirected edges (s, t, c), weights over 0, nodes without an edge left out.

    ``beta`` stands after its ``alpha``; it is 0, and all that follows too, where a probe has seen all it can.
    """
    edges = held(edges)
    both = edges.select(*by, "s", "t", "c").unionByName(edges.select(*by, F.col("t").alias("s"), F.col("s").alias("t"), "c"))
    degree = materialise(both.groupBy(*by, "s").agg(F.sum("c").alias("_d")))
    scaled = both.join(degree, [*by, "s"]).join(degree.withColumnsRenamed({"s": "t", "_d": "_e"}), [*by, "t"])
    links = materialise(scaled.select(*by, "s", "t", (-F.col("c") / F.sqrt(F.col("_d") * F.col("_e"))).alias("a")))
    size = materialise(degree.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes")))
    sign = lambda k: F.when(F.pmod(F.xxhash64(F.col("s").cast("string"), F.lit(k)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    start = degree.join(size, by).select(*by, F.col("s").alias("node"), "nodes", *((sign(k) / F.sqrt("nodes")).alias(f"x{k}") for k in range(probes)))
    now = materialise(start.select("*", *(F.lit(0.0).alias(f"p{k}") for k in range(probes)), *(F.lit(0.0).alias(f"b{k}") for k in range(probes))))
    out = None
    for step in range(steps):
        there = now.select(*by, F.col("node").alias("t"), *(f"x{k}" for k in range(probes)))
        passed = links.join(there, [*by, "t"]).groupBy(*by, F.col("s").alias("node")).agg(*(F.sum(F.col("a") * F.col(f"x{k}")).alias(f"w{k}") for k in range(probes)))
        # the diagonal is one
        moved = now.join(passed, [*by, "node"]).withColumns({f"w{k}": F.col(f"w{k}") + F.col(f"x{k}") for k in range(probes)})
        moved = materialise(moved)
        alpha = _norms(by, moved, probes, lambda k: F.col(f"w{k}") * F.col(f"x{k}")).withColumnsRenamed({f"n{k}": f"a{k}" for k in range(probes)})
        rest = moved.join(alpha, by).withColumns({f"w{k}": F.col(f"w{k}") - F.col(f"a{k}") * F.col(f"x{k}") - F.col(f"b{k}") * F.col(f"p{k}") for k in range(probes)})
        rest = materialise(rest)
        beta = _norms(by, rest, probes, lambda k: F.col(f"w{k}") * F.col(f"w{k}"))
        beta = beta.select(*by, *(F.when(F.col(f"n{k}") > EPS * EPS, F.sqrt(f"n{k}")).otherwise(0.0).alias(f"e{k}") for k in range(probes)))
        each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("probe"), F.col(f"a{k}").alias("alpha"), F.col(f"e{k}").alias("beta")) for k in range(probes)))).alias("m")
        told = materialise(alpha.join(beta, by).join(size, by).select(*by, F.lit(step).cast("long").alias("step"), "nodes", each).select(*by, "m.probe", "step", "m.alpha", "m.beta", "nodes"))
        out = told if out is None else out.unionByName(told)
        after = lambda k: F.when(F.col(f"e{k}") > 0, F.col(f"w{k}") / F.col(f"e{k}")).otherwise(0.0)
        nexts = rest.join(beta, by).select(*by, "node", "nodes", *(after(k).alias(f"x{k}") for k in range(probes)), *(F.col(f"x{k}").alias(f"p{k}") for k in range(probes)), *(F.col(f"e{k}").alias(f"b{k}") for k in range(probes)))
        before, now = now, materialise(nexts)
        forget(before, moved, rest)
    forget(now, links, degree, size)
    return out


def quadrature(tridiagonal: DataFrame, by: str) -> DataFrame:
    """(by, lambda, weight): nodes of the Gauss rules of ``lanczos``; weights of a snapshot add up to its number of nodes."""
    kind = dict(tridiagonal.dtypes)

    def rule(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("step")
        beta = rows["beta"].to_numpy()
        # what follows a beta of zero is no part of the matrix
        last = int(np.argmax(beta == 0)) + 1 if (beta == 0).any() else len(rows)
        theta, vectors = np.linalg.eigh(np.diag(rows["alpha"].to_numpy()[:last]) + np.diag(beta[: last - 1], 1) + np.diag(beta[: last - 1], -1))
        return pd.DataFrame({by: rows[by].iloc[0], "lambda": np.where(np.abs(theta) < 1e-9, 0.0, theta), "weight": vectors[0] ** 2 * rows["nodes"].iloc[0]})

    count = tridiagonal.groupBy(by).agg(F.count_distinct("probe").alias("_probes"))
    points = tridiagonal.groupBy(by, "probe").applyInPandas(rule, f"{by} {kind[by]}, lambda double, weight double")
    return points.join(count, by).select(by, "lambda", (F.col("weight") / F.col("_probes")).alias("weight"))


def functionals(points: DataFrame, by: str, centre: DataFrame | None = None) -> DataFrame:
    """Sums over a spectrum given as points (by, lambda, weight): exact values have weight one.

    (by, ev_nodes, ev_sum, ev_energy (of squares), ev_std, ev_entropy_raw, ev_entropy (of the values as shares), resistance (trace of the pseudoinverse by node) and laplacian_energy (mean distance
    from ``centre`` (by, centre), times nodes; from the mean value if none is given)).
    """
    w, x = F.col("weight"), F.col("lambda")
    positive = x > EPS
    if centre is None:
        centre = points.groupBy(by).agg((F.sum(w * x) / F.sum(w)).alias("centre"))
    total = points.groupBy(by).agg(F.sum(F.when(positive, w * x)).alias("_total"))
    share = x / F.col("_total")
    rows = points.join(centre, by).join(total, by)
    mean = F.sum(w * x) / F.sum(w)
    return rows.groupBy(by).agg(
        F.sum(w).alias("ev_nodes"), F.sum(w * x).alias("ev_sum"), F.sum(w * x * x).alias("ev_energy"), F.sqrt(F.greatest(F.sum(w * x * x) / F.sum(w) - mean * mean, F.lit(0.0))).alias("ev_std"),
        F.coalesce(-F.sum(F.when(positive, w * x * F.log(x + 1e-15))), F.lit(0.0)).alias("ev_entropy_raw"), F.coalesce(-F.sum(F.when(positive, w * share * F.log(share + 1e-15))), F.lit(0.0)).alias("ev_entropy"),
        (F.coalesce(F.sum(F.when(positive, w / x)), F.lit(0.0)) / F.sum(w)).alias("resistance"), F.sum(w * F.abs(x - F.col("centre"))).alias("laplacian_energy"),
    )


def places(value_rows: DataFrame, by: str) -> DataFrame:
    """(by, lam2, lam3, lam4, rho, fiedler_localization): single values of exact spectra, 0 where a snapshot is too small."""
    at = lambda k, c="lambda": F.coalesce(F.max(F.when(F.col("mode") == k, F.col(c))), F.lit(0.0))
    return value_rows.groupBy(by).agg(at(1).alias("lam2"), at(2).alias("lam3"), at(3).alias("lam4"), F.max("lambda").alias("rho"), at(1, "quartic").alias("fiedler_localization"))


def widest_gap(value_rows: DataFrame, by: str) -> DataFrame:
    """(by, gap, gap_index): the widest gap from the second value on, in the lower half of the spectrum; ties to the lower, the first gap of a spectrum of up to three values."""
    w = Window.partitionBy(by).orderBy("mode")
    rows = value_rows.withColumn("_gap", F.lead("lambda").over(w) - F.col("lambda")).withColumn("_half", F.expr(f"count(1) over (partition by {by}) div 2"))
    inside = (F.col("mode") >= 1) & (F.col("mode") < F.greatest("_half", F.lit(2)))
    out = rows.groupBy(by).agg(F.min(F.when(inside & F.col("_gap").isNotNull(), F.struct((-F.col("_gap")).alias("less"), "mode"))).alias("m"))
    return out.select(by, F.coalesce(-F.col("m.less"), F.lit(0.0)).alias("gap"), F.coalesce("m.mode", F.lit(1)).cast("long").alias("gap_index"))


def correlation_spectrum(correlations: DataFrame, by: str) -> DataFrame:
    """(by, mode, lambda): eigenvalues of each snapshot's correlation matrix (s, t, c), its diagonal one; a null correlation counts as 0. A snapshot is held by one task."""
    kind = dict(correlations.dtypes)[by]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        a = _matrix(group)[1]
        np.fill_diagonal(a, 1.0)
        found = np.linalg.eigvalsh(a)
        return pd.DataFrame({by: group[by].iloc[0], "mode": np.arange(len(found)), "lambda": found})

    return correlations.select(by, "s", "t", F.coalesce("c", F.lit(0.0)).alias("c")).groupBy(by).applyInPandas(solve, f"{by} {kind}, mode long, lambda double")


def noise_fit(values_: DataFrame, by: str, length: int) -> DataFrame:
    """(by, n_signal, n_noise, lambda_plus, ks, p): how many eigenvalues of a correlation matrix of ``length`` times stand out of noise, and how far the others are from even between the bounds of noise.

    Bounds are (1 ± sqrt(nodes / length)) ** 2. With up to three values of noise ``ks`` is 0 and ``p`` 1; ``p`` is the asymptotic one, with Stephens' correction for short samples.
    """
    n = values_.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    q = F.sqrt(F.col("_n") / length)
    rows = values_.join(n, by).withColumns({"_low": F.pow(1 - q, F.lit(2)), "_high": F.pow(1 + q, F.lit(2))})
    rows = rows.withColumn("_noise", F.col("lambda") <= F.col("_high"))
    place = F.row_number().over(Window.partitionBy(by, "_noise").orderBy("lambda"))
    count = F.count(F.lit(1)).over(Window.partitionBy(by, "_noise"))
    f = F.least(F.greatest((F.col("lambda") - F.col("_low")) / (F.col("_high") - F.col("_low")), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumn("_away", F.when(F.col("_noise"), F.greatest(place / count - f, f - (place - 1) / count)))
    out = rows.groupBy(by).agg(F.count_if(~F.col("_noise")).alias("n_signal"), F.count_if("_noise").alias("n_noise"), F.max("_high").alias("lambda_plus"), F.max("_away").alias("_ks"))
    ks = F.when(F.col("n_noise") > 3, F.col("_ks")).otherwise(0.0)
    t = (F.sqrt("n_noise") + 0.12 + 0.11 / F.sqrt("n_noise")) * F.col("_ks")
    tail = sum(((-1) ** (k - 1) * 2 * F.exp(-2.0 * k * k * t * t) for k in range(1, 40)), F.lit(0.0))
    return out.select(by, "n_signal", "n_noise", "lambda_plus", ks.alias("ks"), F.when(F.col("n_noise") > 3, F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("p"))
