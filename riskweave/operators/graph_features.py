"""Features of network snapshots for learners: topology, weights, markets, spectra and how they change.

A snapshot is given by its undirected edges (d, s, t, c), weights over 0, and its nodes (d, node, vol, mean, growth, beta, momentum); nodes without an edge
count in every mean. All but the spectrum are aggregates over the two tables; what a set needs of earlier snapshots comes by windows over the one row that each has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators import network as net, quadrature as quad, spectral
from riskweave.operators.components import connected_components
from riskweave.sources.scratch import materialise

BY = "d"


def _or0(c: Column) -> Column:
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))


def _moment(kind, c: str) -> Column:
    """Skewness or kurtosis, 0 up to two values or without spread."""
    return F.when((F.count(c) > 2) & (F.stddev_pop(c) > 0), kind(c)).otherwise(0.0)


def weights(edges: DataFrame) -> DataFrame:
    """Sums and moments of the weights of each snapshot that has an edge."""
    at = lambda q: F.percentile("c", q)
    return edges.groupBy(BY).agg(
        F.count(F.lit(1)).cast("double").alias("n_edges"), F.sum("c").alias("weight_sum"), F.avg("c").alias("corr_mean"), F.stddev_pop("c").alias("corr_std"), F.max("c").alias("corr_max"),
        at(0.25).alias("corr_q25"), at(0.5).alias("corr_q50"), at(0.75).alias("corr_q75"), at(0.9).alias("corr_q90"), _moment(F.skewness, "c").alias("corr_skew"), _moment(F.kurtosis, "c").alias("corr_kurt"),
    )


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Moments of the numbers of neighbours (k) and of strengths (w) over all nodes."""
    found = net.degrees(net.mirrored(edges.select(BY, "s", "t", "c")), [BY])
    rows = nodes.select(BY, "node").join(found, [BY, "node"], "left").select(BY, F.coalesce(F.col("k").cast("double"), F.lit(0.0)).alias("k"), F.coalesce("strength", F.lit(0.0)).alias("w"))
    each = [f(c).alias(f"{c}_{name}") for c in "kw" for name, f in (("avg", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop), ("skew", lambda c: _moment(F.skewness, c)), ("kurt", lambda c: _moment(F.kurtosis, c)))]
    return rows.groupBy(BY).agg(F.count(F.lit(1)).cast("double").alias("n"), *each)


def markets(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(BY).agg(
        F.avg("vol").alias("avg_vol"), F.stddev_pop("vol").alias("std_vol"), _moment(F.skewness, "vol").alias("vol_skew"), (F.max("vol") - F.min("vol")).alias("vol_dispersion"),
        F.avg("mean").alias("avg_return"), F.stddev_pop("mean").alias("std_return"), F.avg("beta").alias("avg_beta"), F.avg("momentum").alias("avg_momentum"),
    )


def weighted_clustering(edges: DataFrame) -> DataFrame:
    """(d, node, cc): over pairs of neighbours, the cube root of the product of a triangle's weights, each over the snapshot's largest (Onnela et al., 2005)."""
    top = edges.groupBy(BY).agg(F.max("c").alias("_top"))
    up = edges.join(top, BY).select(BY, F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t"), F.cbrt(F.col("c") / F.col("_top")).alias("r"))
    tri = up.toDF(BY, "a", "b", "r1").join(up.toDF(BY, "b", "c", "r2"), [BY, "b"]).join(up.toDF(BY, "a", "c", "r3"), [BY, "a", "c"])
    seen = tri.select(BY, F.explode(F.array("a", "b", "c")).alias("node"), (F.col("r1") * F.col("r2") * F.col("r3")).alias("r")).groupBy(BY, "node").agg(F.sum("r").alias("r"))
    k = net.degrees(net.mirrored(edges.select(BY, "s", "t", "c")), [BY])
    return k.join(seen, [BY, "node"], "left").select(BY, "node", F.when(F.col("k") < 2, 0.0).otherwise(2 * F.coalesce("r", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).alias("cc"))


def strength_assortativity(edges: DataFrame) -> DataFrame:
    """(d, strength_assortativity): correlation of the strengths at the two ends of each edge, in both directions; null without spread."""
    both = net.mirrored(edges.select(BY, "s", "t", "c"))
    at = lambda end, name: net.degrees(both, [BY]).select(BY, F.col("node").alias(end), F.col("strength").alias(name))
    rows = both.join(at("s", "x"), [BY, "s"]).join(at("t", "y"), [BY, "t"])
    return rows.groupBy(BY).agg(net.correlation("x", "y").alias("strength_assortativity"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(d, n_components, second_component): how many there are and the share of nodes in the second largest. Snapshots are parts of one graph, with the date in the node's name."""
    name = lambda c: F.concat_ws("/", F.col(BY).cast("string"), F.lpad(F.col(c).cast("string"), 20, "0"))
    found = connected_components(edges.select(name("s").alias("source"), name("t").alias("target")))
    rows = nodes.select(BY, name("node").alias("node")).join(found, "node", "left").select(BY, F.coalesce("component", "node").alias("component"))
    sizes = rows.groupBy(BY, "component").agg(F.count(F.lit(1)).alias("n"))
    ranked = sizes.withColumn("place", F.row_number().over(Window.partitionBy(BY).orderBy(F.desc("n"), "component")))
    return ranked.groupBy(BY).agg(F.count(F.lit(1)).cast("double").alias("n_components"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("second_component"))


def spectra(edges: DataFrame, nodes: DataFrame, mean_degree: DataFrame) -> DataFrame:
    """Single values and sums of each snapshot's normalised spectrum, exact, and its gaps: the widest, and the first that random graphs rarely have (``spectral.gap_test``); ``mean_degree`` (d, centre) is what energy is taken from."""
    rows = materialise(quad.values(edges, nodes, BY))
    points = rows.select(BY, "lambda", F.lit(1.0).alias("weight"))
    alone = nodes.select(BY, F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0.0).alias("c"))
    tested = spectral.gap_test(edges.unionByName(alone), BY).select(BY, F.col("index").alias("tested_index"), F.col("gap").alias("tested_gap"))
    return quad.places(rows, BY).join(quad.widest_gap(rows, BY), BY).join(quad.functionals(points, BY, mean_degree), BY).join(tested, BY)


def all_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a snapshot with every feature that rests on it alone; numbers about edges are 0 where there are none."""
    edges, nodes = materialise(edges.select(BY, "s", "t", "c")), materialise(nodes)
    base = degrees(edges, nodes).join(weights(edges), BY, "left").na.fill(0.0)
    mean_degree = base.select(BY, (2 * F.col("n_edges") / F.col("n")).alias("centre"))
    plain = net.clustering(net.mirrored(edges), [BY]).groupBy(BY).agg(F.sum("cc").alias("_cc"))
    weighted = weighted_clustering(edges).groupBy(BY).agg(F.sum("cc").alias("_wcc"))
    mixing = net.assortativity(net.mirrored(edges), [BY]).join(strength_assortativity(edges), BY)
    out = base.join(plain, BY, "left").join(weighted, BY, "left").join(mixing, BY, "left").na.fill(0.0).join(components(edges, nodes), BY).join(markets(nodes), BY).join(spectra(edges, nodes, mean_degree), BY)
    positive = lambda c: F.col(c) > quad.EPS
    return materialise(
        out.withColumns(
            {
                "density": F.when(F.col("n") > 1, 2 * F.col("n_edges") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0),
                "clustering_coeff": F.col("_cc") / F.col("n"), "weighted_clustering": F.col("_wcc") / F.col("n"),
                "scg_risk": F.when(positive("rho"), 1 - F.col("lam2") / F.col("rho")).otherwise(1.0), "norm_ratio": F.when(positive("rho"), F.col("lam2") / F.col("rho")).otherwise(0.0),
                "ev_ratio_12": F.when(positive("lam3"), F.col("lam2") / F.col("lam3")).otherwise(0.0), "lam_ratio_23": F.col("lam3") / F.greatest("lam2", F.lit(quad.EPS)),
                "resilience": F.when(F.col("gap") > 0, F.col("lam2") * F.col("gap")).otherwise(0.0), "fiedler_ratio": F.when(positive("ev_sum"), F.col("lam2") / F.col("ev_sum")).otherwise(0.0),
            }
        ).drop("_cc", "_wcc", "centre")
    )


def _change(c: str) -> Column:
    """Against the snapshot before; there is one row a snapshot, so the window is as long as there are snapshots."""
    return F.coalesce(F.col(c) - F.lag(c).over(Window.orderBy(BY)), F.lit(0.0))


def walk_features(rows: DataFrame) -> DataFrame:
    """The 36 features of the walk-forward learners, from ``all_features``."""
    return rows.select(
        BY, "n_edges", "density", F.col("k_avg").alias("avg_degree"), F.col("k_std").alias("std_degree"), F.col("k_max").alias("max_degree"), "clustering_coeff", "assortativity", "n_components",
        "corr_mean", "corr_std", "corr_q25", "corr_q75", "corr_skew", "corr_kurt", "avg_vol", "std_vol", "avg_return", "std_return", "avg_beta", "avg_momentum",
        "lam2", "gap", "rho", "ev_entropy", "ev_ratio_12", "ev_sum", "ev_std", "scg_risk", F.col("resilience").alias("spectral_resilience"), "fiedler_ratio",
        _change("lam2").alias("lam2_change"), _change("gap").alias("gap_change"), _change("rho").alias("rho_change"), F.abs(_change("n_edges")).alias("edge_change_abs"), _change("avg_vol").alias("vol_change"), _change("corr_mean").alias("corr_mean_change"),
    )


def binary_features(rows: DataFrame) -> DataFrame:
    """The 36 features of the classifiers; numbers about weights are 0 up to two edges, clustering up to a mean of one neighbour."""
    some = lambda c: F.when(F.col("n_edges") > 2, F.col(c)).otherwise(0.0).alias(c)
    return rows.select(
        BY, "lam2", F.col("tested_gap").alias("gap"), "rho", "scg_risk", "ev_entropy", F.col("norm_ratio").alias("spectral_norm_ratio"),
        F.col("k_avg").alias("avg_degree"), F.col("k_std").alias("std_degree"), F.col("k_max").alias("max_degree"), F.col("k_min").alias("min_degree"), F.col("k_skew").alias("degree_skew"),
        "density", "n_edges", F.when(F.col("k_avg") > 1, F.col("weighted_clustering")).otherwise(0.0).alias("clustering_coeff"),
        *map(some, ("corr_mean", "corr_std", "corr_skew", "corr_kurt", "corr_q25", "corr_q50", "corr_q75", "corr_max")), "avg_vol", F.col("std_vol").alias("vol_std"), "vol_skew",
        _change("lam2").alias("lam2_change"), _change("rho").alias("rho_change"), _change("density").alias("density_change"), F.abs(_change("n_edges")).alias("edge_change_abs"), _change("avg_vol").alias("vol_change"),
        F.col("tested_gap").alias("modularity_proxy"), F.col("strength_assortativity").alias("assortativity"), F.col("second_component").alias("second_largest_component"),
        F.col("resistance").alias("effective_resistance_approx"), "laplacian_energy", F.col("norm_ratio").alias("algebraic_connectivity_ratio"),
    )


def deep_features(rows: DataFrame) -> DataFrame:
    """The features of the boosted learners, with those of earlier snapshots and ``target_lam2_next``; the first three snapshots and the last have no row."""
    order = Window.orderBy(BY)
    lag = lambda c, k: F.lag(c, k).over(order)
    frame = lambda n: order.rowsBetween(1 - n, 0)
    rolled = {f"{c}_r{kind}{n}": f(c).over(frame(n)) if kind == "mean" else F.coalesce(f(c).over(frame(n)), F.lit(0.0)) for c in ("lam2", "gap", "density") for n in (5, 10) for kind, f in (("mean", F.avg), ("std", F.stddev_samp))}
    out = rows.select(
        BY, F.row_number().over(order).alias("_place"), "density", "n_edges", F.col("w_avg").alias("avg_degree"), F.col("w_max").alias("max_degree"), F.col("w_min").alias("min_degree"), F.col("w_std").alias("std_degree"),
        F.col("w_skew").alias("degree_skew"), F.col("w_kurt").alias("degree_kurtosis"), F.col("corr_mean").alias("avg_weight"), F.col("corr_std").alias("std_weight"), F.col("corr_max").alias("max_weight"), "weight_sum",
        "corr_mean", "corr_std", "corr_q25", "corr_q50", "corr_q75", "corr_q90", "corr_skew", (F.col("corr_q75") - F.col("corr_q25")).alias("corr_iqr"),
        "lam2", "gap", "rho", "lam3", "lam4", "lam_ratio_23", F.col("ev_entropy_raw").alias("ev_entropy"), "ev_energy", "ev_sum", "fiedler_localization",
        "avg_vol", "std_vol", F.col("avg_return").alias("avg_ret"), "avg_beta", "avg_momentum", "vol_dispersion", F.col("tested_index").alias("scg_k"), (F.col("tested_index") / F.col("n")).alias("scg_ratio"),
        (F.col("corr_std") * F.col("avg_vol")).alias("corr_std_x_avg_vol"), (F.col("density") * F.col("avg_vol")).alias("density_x_avg_vol"), (F.col("lam2") * F.col("avg_vol")).alias("lam2_x_avg_vol"),
        *(lag("lam2", k).alias(f"lam2_lag{k}") for k in (1, 2, 3)), lag("gap", 1).alias("gap_lag1"), lag("rho", 1).alias("rho_lag1"), *(c.alias(name) for name, c in rolled.items()),
        (F.col("lam2") - lag("lam2", 5)).alias("lam2_diff5"), (F.col("density") - lag("density", 5)).alias("density_diff5"), F.lead("lam2").over(order).alias("target_lam2_next"),
    )
    return out.where("_place > 3 AND target_lam2_next IS NOT NULL").drop("_place")
