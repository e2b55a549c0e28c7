"""Queries over the structure of every snapshot: communities, spectral features, filtered networks, thresholds and scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.columns import rounded
from riskweave.operators import communities as com, filtered, graph_features as gf, network as net, quadrature as quad, scales, spectral, thresholds as thr, timeseries as ts
from riskweave.plans.catalog import register
from riskweave.plans.graphs import edges
from riskweave.sources import views as v
from riskweave.sources.scratch import materialise
from riskweave.sources.views import oracle


def snapshots(s, d):
    """Edges and nodes of every month that has a whole window."""
    nodes = ts.node_features(v.ret(s, d), v.WINDOW).withColumnRenamed("bank", "node")
    return edges(s, d), nodes


def dense(s, d):
    """Correlations of all pairs, by month."""
    return ts.rolling_correlation(ts.pairs(v.ret(s, d)), v.WINDOW)


@register("communities")
def communities(s, d):
    return rounded(com.communities(edges(s, d), ["d"]), "quality")


@register("community_levels")
def community_levels(s, d):
    """Exposure networks by quarter: communities and modularity of each level."""
    rows = com.louvain(v.exposure(s, d).select("d", F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").alias("c")), ["d"])
    return rounded(rows.groupBy("d", "level").agg(F.count_distinct("community").alias("communities"), F.max("quality").alias("quality")), "quality")


@register("region_modularity", oracle("exposure", "").rstrip() + """, e as (select d, source s, target t, weight w from exposure union all select d, target, source, weight from exposure), k as (select d, s node, sum(w) k from e group by 1, 2),
    m as (select d, sum(k) m from k group by 1), c as (select k.d, n_regionkey c, sum(k) k from k join nation on n_nationkey = node group by 1, 2), a as (select e.d, sum(w) w from e join nation x on x.n_nationkey = s join nation y on y.n_nationkey = t where x.n_regionkey = y.n_regionkey group by 1)
    select m.d, round(coalesce(max(a.w), 0) / max(m) - sum(c.k * c.k) / (max(m) * max(m)), 6) + 0e0 quality from m join c on c.d = m.d left join a on a.d = m.d group by 1""")
def region_modularity(s, d):
    """Regions as communities of the exposure networks, by quarter."""
    e = v.exposure(s, d).select("d", F.col("source").alias("s"), F.col("target").alias("t"), F.col("weight").alias("c"))
    region = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("community"))
    labels = e.select("d").distinct().join(F.broadcast(region))
    return rounded(com.modularity(e, labels, ["d"]), "quality")


_SKEWED = "case when count({0}) > 2 and stddev_pop({0}) > 0 then (avg({0} * {0} * {0}) - 3 * avg({0}) * avg({0} * {0}) + 2 * pow(avg({0}), 3)) / pow(stddev_pop({0}), 3) else 0 end"


@register("features_topology", oracle("edge twin degree ret", "").rstrip() + f""", held as (select d, bank node from (select bank, d, count(*) over (partition by bank order by d rows between {v.WINDOW} preceding and 1 preceding) n from ret) where n = {v.WINDOW}),
    g as (select h.d, coalesce(g.k, 0)::double k, coalesce(g.deg, 0) w from held h left join degree g on g.d = h.d and g.node = h.node),
    w as (select d, count(*)::double n_edges, sum(c) weight_sum, avg(c) corr_mean, stddev_pop(c) corr_std, quantile_cont(c, 0.25) corr_q25, quantile_cont(c, 0.9) corr_q90, {_SKEWED.format("c")} corr_skew from edge group by 1)
    select g.d, count(*)::double n, round(avg(k), 6) + 0e0 k_avg, max(k) k_max, min(k) k_min, round(stddev_pop(k), 6) + 0e0 k_std, round(avg(g.w), 6) + 0e0 w_avg, round(max(g.w), 6) + 0e0 w_max, round(stddev_pop(g.w), 6) + 0e0 w_std, round({_SKEWED.format("g.w")}, 5) + 0e0 w_skew,
    {", ".join(f"round(coalesce(max({c}), 0), {6 if c != 'corr_skew' else 5}) + 0e0 {c}" for c in ("n_edges", "weight_sum", "corr_mean", "corr_std", "corr_q25", "corr_q90", "corr_skew"))}, round(case when count(*) > 1 then 2 * coalesce(max(n_edges), 0) / (count(*) * (count(*) - 1)) else 0 end, 6) + 0e0 density
    from g left join w on w.d = g.d group by 1""")
def features_topology(s, d):
    """Moments of degrees, strengths and weights of every month's network, over all nodes."""
    e, nodes = map(materialise, snapshots(s, d))
    rows = gf.degrees(e, nodes).join(gf.weights(e), "d", "left").na.fill(0.0)
    rows = rows.withColumn("density", F.when(F.col("n") > 1, 2 * F.col("n_edges") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
    names = ("k_avg", "k_std", "w_avg", "w_max", "w_std", "n_edges", "weight_sum", "corr_mean", "corr_std", "corr_q25", "corr_q90", "density")
    return rounded(rounded(rows.select("d", "n", "k_max", "k_min", "w_skew", "corr_skew", *names), *names), "w_skew", "corr_skew", digits=5)


def _all(frame):
    return rounded(frame, *(c for c, kind in frame.dtypes if kind == "double"))


@register("features_walk")
def features_walk(s, d):
    return _all(gf.walk_features(gf.all_features(*snapshots(s, d))))


@register("features_binary")
def features_binary(s, d):
    return _all(gf.binary_features(gf.all_features(*snapshots(s, d))))


@register("features_deep")
def features_deep(s, d):
    return _all(gf.deep_features(gf.all_features(*snapshots(s, d))))


@register("spectral_quadrature")
def spectral_quadrature(s, d):
    """Sums over the spectra of all exposure networks, without a matrix."""
    e = v.exposure(s, d).select("d", F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t"), "weight").groupBy("d", "s", "t").agg(F.sum("weight").alias("c"))
    return _all(quad.functionals(quad.quadrature(quad.lanczos(e, ["d"], probes=8, steps=12), "d"), "d"))


@register("noise_fit")
def noise_fit(s, d):
    """Eigenvalues of each month's correlations against the bounds of noise."""
    return rounded(quad.noise_fit(quad.correlation_spectrum(dense(s, d), "d"), "d", v.WINDOW), "lambda_plus", "ks", "p", digits=5)


@register("planar_filter")
def planar_filter(s, d):
    return rounded(filtered.planar_filtered(dense(s, d).withColumn("c", F.round("c", 10)), "d"), "c")


def _windows(s, d):
    """(d, bank, i, r): the returns of the window before each third month."""
    r = v.ret(s, d)
    ends = ts.node_features(r, v.WINDOW).select("d").distinct().where("month(d) % 3 = 0")
    times = r.select(F.col("d").alias("i")).distinct()
    held = ends.join(times, F.col("i") < F.col("d")).where(F.col("i") >= F.add_months("d", -v.WINDOW))
    return held.join(r.select(F.col("d").alias("i"), "bank", "r"), "i")


_SHARES = [0.2, 0.3, 0.45, 0.65, 0.9]


@register("partial_correlations")
def partial_correlations(s, d):
    """Graphical lasso of every quarter's window, its penalty chosen by three folds."""
    found = filtered.partial_correlations(_windows(s, d), "d", "bank", "r", "i", _SHARES, folds=3, threshold=0.05)
    return rounded(found, "c", "partial", digits=4)


_SERIES = "series as (select n_regionkey::bigint region, bank, d, r from ret join nation on n_nationkey = bank)"


@register("fold_correlations", oracle("ret", "").rstrip() + f""", {_SERIES}, p as (select a.region, a.bank s, b.bank t, a.r x, b.r y, row_number() over (partition by a.region, a.bank, b.bank order by a.d) i, count(*) over (partition by a.region, a.bank, b.bank) n from series a join series b on a.region = b.region and a.d = b.d and a.bank < b.bank)
    select region, ((i - 1) // (n // 5))::int fold, s, t, count(*) n, round(case when stddev_pop(x) > 1e-9 and stddev_pop(y) > 1e-9 then corr(x, y) end, 5) + 0e0 c from p where n >= 5 and i <= n // 5 * 5 group by all""")
def fold_correlations(s, d):
    """Correlations within five runs of months, of the banks of each region, from one pass of cumulated sums."""
    return rounded(thr.fold_correlations(_regions(s, d), ["region"], "bank", "r", "d", 5), "c", digits=5)


@register("fold_covariances", oracle("ret", "").rstrip() + f""", {_SERIES}, times as (select region, d, ((row_number() over (partition by region order by d) - 1) * 4 // count(*) over (partition by region))::int fold from (select distinct region, d from series)),
    p as (select a.region, fold, a.bank s, b.bank t, a.r x, b.r y from series a join series b on a.region = b.region and a.d = b.d and a.bank <= b.bank join times u on u.region = a.region and u.d = a.d), f as (select distinct region, fold, s, t from p)
    select f.region, f.fold, f.s, f.t, round(covar_pop(x, y) filter (p.fold <> f.fold), 5) + 0e0 c, round(covar_pop(x, y) filter (p.fold = f.fold), 5) + 0e0 held from f join p on p.region = f.region and p.s = f.s and p.t = f.t group by all
    union all select region, -1, s, t, round(covar_pop(x, y), 5) + 0e0, null from p group by all""")
def fold_covariances(s, d):
    """Covariances of the banks of each region without and within each of four runs of months."""
    return rounded(filtered.fold_covariances(_regions(s, d), ["region"], "bank", "r", "d", 4), "c", "held", digits=5)


_CUTS = [0.1 + 0.6 * k / 14 for k in range(15)]


def _regions(s, d):
    region = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("bank"), F.col("n_regionkey").cast("long").alias("region"))
    return v.ret(s, d).join(F.broadcast(region), "bank")


@register("threshold_folds")
def threshold_folds(s, d):
    """Each region's banks as a network: the threshold whose spectral gap is the steadiest over five runs of months."""
    rows = thr.threshold_stability(thr.fold_spectra(_regions(s, d), "region", "bank", "r", "d", _CUTS), "region")
    return rounded(rows, "threshold", "gap_mean", "gap_cv", "lam2_mean", "lam2_cv")


def _gaps(s, d, modes):
    """(d, k): one cluster more than the place of the first gap that random graphs rarely have."""
    return spectral.gap_test(edges(s, d), "d").select("d", (F.col("index") + 1).alias("k"))


@register("spectral_clusters")
def spectral_clusters(s, d):
    modes = materialise(spectral.modes(edges(s, d), "d"))
    return scales.spectral_clusters(modes, "d", _gaps(s, d, modes))


@register("renormalisation")
def renormalisation(s, d):
    return rounded(scales.renormalised(edges(s, d), "d")[0], "lambda_2", "radius", "density")


@register("spanning_forest")
def spanning_forest(s, d):
    """The strongest ties that join each quarter's exposure network."""
    e = v.exposure(s, d).select("d", F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t"), "weight").groupBy("d", "s", "t").agg((-F.round(F.sum("weight"), 2)).alias("dist"))
    return rounded(net.spanning_forest(e, "d"), "dist", digits=2)


@register("network_kinds")
def network_kinds(s, d):
    """Networks of each quarter by threshold, spanning tree, planar filter and graphical lasso: edges, density, connectivity and gap."""
    when = F.month("d") % 3 == 0
    pairs = materialise(dense(s, d).where(when).withColumn("c", F.round("c", 10)))
    tree = net.spanning_tree(net.distances(pairs), "d").join(pairs, ["d", "s", "t"]).select("d", "s", "t", "c")
    kinds = {"threshold": pairs.where("c >= 0.3"), "tree": tree, "planar": filtered.planar_filtered(pairs, "d"), "partial": filtered.partial_correlations(_windows(s, d), "d", "bank", "r", "i", _SHARES, folds=3, threshold=0.05)}
    cell = lambda kind: F.concat_ws("|", F.col("d").cast("string"), F.lit(kind)).alias("cell")
    rows = None
    for kind, e in kinds.items():
        # of negative weights no Laplacian is made
        each = e.where("c > 0").select(cell(kind), "s", "t", "c")
        rows = each if rows is None else rows.unionByName(each)
    rows = materialise(rows)
    nodes = pairs.select("d", F.explode(F.array("s", "t")).alias("node")).distinct()
    cells = nodes.select("d", "node", F.explode(F.array(*map(F.lit, kinds))).alias("method")).withColumn("cell", F.concat_ws("|", F.col("d").cast("string"), "method"))
    found = materialise(quad.values(rows, cells.select("cell", "node"), "cell"))
    n = F.col("nodes") * (F.col("nodes") - 1) / 2
    out = cells.groupBy("cell", "d", "method").agg(F.count(F.lit(1)).alias("nodes")).join(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("edges")), "cell", "left")
    out = out.join(quad.places(found, "cell"), "cell").join(quad.widest_gap(found, "cell"), "cell")
    out = out.select("d", "method", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) / n).alias("density"), F.col("lam2").alias("lambda_2"), F.col("gap").alias("spectral_gap"))
    return rounded(out, "density", "lambda_2", "spectral_gap")
