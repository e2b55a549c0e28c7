"""Queries over networks and their spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.columns import clip, rnd, rounded
from riskweave.operators import network as net, spectral, timeseries as ts
from riskweave.operators.components import connected_components
from riskweave.plans.catalog import register
from riskweave.plans.series import sql
from riskweave.sources import views as v
from riskweave.sources.views import oracle


def edges(s, d, threshold: float = 0.3):
    return ts.rolling_correlation(ts.pairs(v.ret(s, d)), v.WINDOW).where(F.col("c") >= threshold)


def both(s, d):
    return net.mirrored(edges(s, d))


def correlations(s, d):
    return ts.latest_correlation(v.ret(s, d), 36)


_CORR = "corr36 as (select a.bank s, b.bank t, corr(a.r, b.r) c from (select *, row_number() over (partition by bank order by d desc) k from ret) a join (select *, row_number() over (partition by bank order by d desc) k from ret) b on a.d = b.d and a.bank < b.bank where a.k <= 36 and b.k <= 36 group by 1, 2)"


@register("exposure_degree", sql("exposure", "d | source | target | weight=weight / sqrt(sum(weight) over (partition by d, source)) / sqrt(sum(weight) over (partition by d, target))", "from exposure"))
def exposure_degree(s, d):
    return rounded(net.degree_normalised(v.exposure(s, d), ["d"]), "weight")


@register("exposure_dense", oracle("latest", "select s.source, t.target, round(coalesce(l.weight, 0), 4) + 0e0 weight from (select distinct source from latest) s cross join (select distinct target from latest) t left join latest l on l.source = s.source and l.target = t.target"))
def exposure_dense(s, d):
    one = v.latest_exposure(s, d).withColumn("g", F.lit(1))
    return rounded(net.densified(one, ["g"]).drop("g"), "weight", digits=4)


@register("exposure_standardised", sql("exposure", "d | source | target | weight=(weight - avg(weight) over (partition by d)) / case when stddev_pop(weight) over (partition by d) = 0 then 1 else stddev_pop(weight) over (partition by d) end", "from exposure"))
def exposure_standardised(s, d):
    return rounded(net.standardised(v.exposure(s, d), ["d"]), "weight")


@register("exposure_over", oracle("latest", "select source, target from latest where weight > 0.4"))
def exposure_over(s, d):
    return net.over(v.latest_exposure(s, d), 0.4).select("source", "target")


@register("exposure_cut", oracle("latest", "select source, target, round(case when abs(weight) < 0.3 then 0 else weight end, 4) + 0e0 weight from latest"))
def exposure_cut(s, d):
    return rounded(net.cut(v.latest_exposure(s, d), 0.3), "weight", digits=4)


@register("correlation_degrees", sql("degree", "d | node | k | strength=deg", "from degree"))
def correlation_degrees(s, d):
    return rounded(net.degrees(both(s, d), ["d"]), "strength")


@register("density", oracle("edge", "select d, count(*) edges, round(count(*) / 300.0, 6) + 0e0 density, round(avg(c), 6) + 0e0 mean_c from edge group by 1"))
def density(s, d):
    return rounded(net.density(edges(s, d), ["d"], 25), "density", "mean_c")


_LAP = """, lap as (select b.d, s i, t j, -c / sqrt(x.deg * y.deg) v from twin b join degree x on b.d = x.d and b.s = x.node join degree y on b.d = y.d and b.t = y.node union all select d, node, node, 1e0 from degree)"""


@register("laplacian", oracle("degree", "").rstrip() + _LAP + " select d, i, j, round(v, 6) + 0e0 v from lap")
def laplacian(s, d):
    return rounded(net.laplacian(both(s, d), ["d"]), "v")


@register("laplacian_row_sums", oracle("degree", "select d, node i, 0e0 total from degree"))
def laplacian_row_sums(s, d):
    return net.laplacian(both(s, d), ["d"], normalised=False).groupBy("d", "i").agg(rnd(F.sum("v")).alias("total"))


@register("spectrum_invariants", oracle("degree", "").rstrip() + _LAP + " select d, count(*) filter (i = j) nodes, round(sum(v) filter (i = j), 6) + 0e0 total, round(sum(v * v), 5) + 0e0 squares from lap group by 1")
def spectrum_invariants(s, d):
    return spectral.spectrum(spectral.modes(edges(s, d), "d"), "d").select("d", "nodes", rnd("total").alias("total"), rnd("squares", 5).alias("squares"))


@register("spectrum")
def spectrum(s, d):
    return rounded(spectral.spectrum(spectral.modes(edges(s, d), "d"), "d"), "lambda_2", "radius", "total", "squares", "gap")


@register("eigen_residual", oracle("edge", "select d, 0e0 residual from edge group by 1"))
def eigen_residual(s, d):
    m = spectral.modes(edges(s, d), "d")
    lap = net.laplacian(both(s, d), ["d"])
    left = lap.join(m.select("d", F.col("node").alias("j"), "mode", F.col("v").alias("vj")), ["d", "j"]).groupBy("d", "mode", F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("vj")).alias("lv"))
    return left.join(m, ["d", "mode", "node"]).groupBy("d").agg(rnd(F.max(F.abs(F.col("lv") - F.col("lambda") * F.col("v"))), 8).alias("residual"))


@register("eigenvectors_orthonormal", oracle("degree", "select d, count(*) modes, 1e0 norm from degree group by 1"))
def eigenvectors_orthonormal(s, d):
    m = spectral.modes(edges(s, d), "d").groupBy("d", "mode").agg(F.sum(F.col("v") * F.col("v")).alias("norm"))
    return m.groupBy("d").agg(F.count(F.lit(1)).alias("modes"), rnd(F.max("norm"), 8).alias("norm"))


@register("diffusion_zero_time", oracle("degree", "select d, count(*) pairs, round(sum(case when a.deg + b.deg > 0 then 1 else 0 end), 0) + 0e0 positive from degree a join degree b using (d) where a.node < b.node group by 1"))
def diffusion_zero_time(s, d):
    dist = spectral.diffusion_distance(spectral.modes(edges(s, d), "d"), "d", 0.0)
    return dist.groupBy("d").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("dist") >= 0).cast("double")).alias("positive"))


@register("participation")
def participation(s, d):
    return rounded(spectral.participation(spectral.modes(edges(s, d), "d"), "d"), "lambda", "participation")


@register("embedding")
def embedding(s, d):
    return spectral.embedding(spectral.modes(edges(s, d), "d"), "d", 2)


@register("coarse_graining")
def coarse_graining(s, d):
    e = correlations(s, d).where("c >= 0.1").withColumn("d", F.lit(0))
    w = spectral.coarse_weights(spectral.modes(e, "d", normalised=False), e, "d", 3)
    return spectral.contracted(w)


@register("fiedler_sides")
def fiedler_sides(s, d):
    return spectral.fiedler_sides(spectral.modes(edges(s, d), "d"), "d")


@register("heat_mass", oracle("degree", "select d, count(*) nodes, 1e0 mass from degree group by 1"))
def heat_mass(s, d):
    m = spectral.modes(edges(s, d), "d", normalised=False)
    p = spectral.heat(m, "d", m.groupBy("d").agg(F.min("node").alias("node")), 0.7)
    return p.groupBy("d").agg(F.count(F.lit(1)).alias("nodes"), rnd(F.sum("p"), 8).alias("mass"))


@register("noise_shrinkage", oracle("ret", "").rstrip() + f", {_CORR} select s, t, round((1 - least(1, 25 / 36.0)) * c, 6) + 0e0 c from corr36")
def noise_shrinkage(s, d):
    return rounded(spectral.shrunk(correlations(s, d), 36, 25), "c")


@register("noise_cleaned")
def noise_cleaned(s, d):
    return rounded(spectral.denoised(correlations(s, d).withColumn("g", F.lit(0)), "g", 36), "c")


@register("gap_test")
def gap_test(s, d):
    return rounded(spectral.gap_test(edges(s, d), "d"), "gap", "p")


_TRI = "select a.d, a.s, count(*) tri from twin a join twin b on a.d = b.d and a.t = b.s join twin e on e.d = a.d and e.s = b.t and e.t = a.s group by 1, 2"


@register("clustering", oracle("degree", f"select g.d, g.node, round(case when k < 2 then 0 else coalesce(tri, 0) / (k * (k - 1)) end, 6) + 0e0 cc from degree g left join ({_TRI}) x on x.d = g.d and x.s = g.node"))
def clustering(s, d):
    return rounded(net.clustering(both(s, d), ["d"]), "cc")


@register("assortativity", oracle("degree", "select b.d, round(case when count(*) < 4 or stddev_pop(x.k) < 1e-12 then 0 else corr(x.k, y.k) end, 6) + 0e0 assortativity from twin b join degree x on b.d = x.d and b.s = x.node join degree y on b.d = y.d and b.t = y.node group by 1"))
def assortativity(s, d):
    return rounded(net.assortativity(both(s, d), ["d"]), "assortativity")


@register("components", oracle("latest", "").replace("with ", "with recursive ", 1).rstrip() + ", e as (select source a, target b from latest where weight > 0.6 union select target, source from latest where weight > 0.6), reach as (select a node, a r from e union select e.b, reach.r from reach join e on e.a = reach.node) select node, min(r) component from reach group by 1")
def components(s, d):
    return connected_components(net.over(v.latest_exposure(s, d), 0.6))


_THR = "(select unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0]) thr)"


@register("threshold_grid", oracle("ret", "").rstrip() + f", {_CORR} select thr, count(*) filter (abs(c) >= thr) edges, round(count(*) filter (abs(c) >= thr) / 300.0, 6) + 0e0 density, round(count(*) filter (abs(c) >= thr) * ln(25) + sum(case when abs(c) >= thr then 0 else 2 * c * c end), 6) + 0e0 mdl from corr36 cross join {_THR} group by 1")
def threshold_grid(s, d):
    grid = s.createDataFrame([(x / 10,) for x in range(1, 6)], "thr double")
    return rounded(net.threshold_grid(correlations(s, d), grid, 25, []), "density", "mdl")


@register("distance_matrix", oracle("ret", "").rstrip() + f", {_CORR} select s, t, round(sqrt(2 * (1 - c)), 6) + 0e0 dist from corr36")
def distance_matrix(s, d):
    return rounded(net.distances(correlations(s, d)), "dist").drop("c")


@register("spanning_tree", oracle("ret", "").replace("with ", "with recursive ", 1).rstrip() + f""", {_CORR}, w as (select s, t, sqrt(2 * (1 - c)) x from corr36), u as (select s a, t b, x from w union all select t, s, x from w),
    nodes as (select distinct a from u), grow as (select 0 step, [min(a)] seen, cast(null as bigint) s, cast(null as bigint) t from nodes union all
    select step + 1, list_append(seen, (select arg_min(b, x) from u where list_contains(seen, a) and not list_contains(seen, b))), (select arg_min(a, x) from u where list_contains(seen, a) and not list_contains(seen, b)), (select arg_min(b, x) from u where list_contains(seen, a) and not list_contains(seen, b)) from grow where step < 24)
    select least(s, t) s, greatest(s, t) t from grow where step > 0""")
def spanning_tree(s, d):
    return net.spanning_tree(net.distances(correlations(s, d)).withColumn("g", F.lit(0)), "g").select("s", "t")


@register("edge_stability", oracle("edge", "select d, coalesce(kept, 0) kept, before, round(coalesce(kept, 0) / before, 6) + 0e0 stability from (select distinct d, lag(d) over (order by d) p from (select distinct d from edge)) z join (select d p, count(*) before from edge group by 1) using (p) left join (select a.d, count(*) kept from edge a join (select d, lag(d) over (order by d) p from (select distinct d from edge)) y on a.d = y.d join edge b on b.d = y.p and a.s = b.s and a.t = b.t group by 1) using (d)"))
def edge_stability(s, d):
    return rounded(net.stability(edges(s, d)), "stability")


@register("edge_changes", oracle("edge", "select d, s, t, round(coalesce(a.c, 0) - coalesce(b.c, 0), 6) + 0e0 delta from edge a full join (select n d, s, t, c from edge join (select d, lead(d) over (order by d) n from (select distinct d from edge)) using (d) where n is not null) b using (d, s, t) where d > (select min(d) from edge)"))
def edge_changes(s, d):
    return rounded(net.weight_changes(edges(s, d)), "delta")


@register("quotient_graph", oracle("latest", "select a.n_regionkey cs, b.n_regionkey ct, round(sum(weight), 4) + 0e0 weight from latest join nation a on a.n_nationkey = source join nation b on b.n_nationkey = target where a.n_regionkey <> b.n_regionkey group by 1, 2"))
def quotient_graph(s, d):
    cluster = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("cluster"))
    return rounded(net.quotient(v.latest_exposure(s, d), cluster), "weight", digits=4)


def _pagerank_sql(rounds: int = 60) -> str:
    steps = [", nodes as (select source node from latest union select target from latest), share as (select source, target, weight / sum(weight) over (partition by source) share from latest), r0 as (select node, 1e0 / (select count(*) from nodes) r from nodes)"]
    for k in range(1, rounds + 1):
        p = f"r{k - 1}"
        steps.append(f""", r{k} as materialized (select n.node, 0.15 / (select count(*) from nodes) + 0.85 * (coalesce(g.got, 0) + (select coalesce(sum(r), 0) from {p} where node not in (select source from share)) / (select count(*) from nodes)) r
            from nodes n left join (select target, sum(share * r) got from share join {p} on source = node group by 1) g on g.target = n.node)""")
    return oracle("latest", "").rstrip() + "".join(steps) + f" select node, round(r, 6) + 0e0 as rank from r{rounds}"


@register("pagerank", _pagerank_sql())
def pagerank(s, d):
    return rounded(net.pagerank(v.latest_exposure(s, d)), "rank")


_SKEW = "(sum(c * c * c) / count(*) - 3 * avg(c) * sum(c * c) / count(*) + 2 * pow(avg(c), 3)) / pow(stddev_pop(c), 3)"


@register("graph_features", oracle("edge", f"select d, count(*) edges, round(count(*) / 300.0, 6) + 0e0 density, round(avg(c), 6) + 0e0 mean, round(stddev_pop(c), 6) + 0e0 sd, round(case when count(*) > 2 and stddev_pop(c) > 0 then {_SKEW} else 0 end, 5) + 0e0 skew, round(quantile_cont(c, 0.75), 6) + 0e0 p75, round(max(c), 6) + 0e0 top from edge group by 1"))
def graph_features(s, d):
    skew = F.when((F.count(F.lit(1)) > 2) & (F.stddev_pop("c") > 0), F.skewness("c")).otherwise(0.0)
    return edges(s, d).groupBy("d").agg(
        F.count(F.lit(1)).alias("edges"), rnd(F.count(F.lit(1)) / 300).alias("density"), rnd(F.avg("c")).alias("mean"), rnd(F.stddev_pop("c")).alias("sd"),
        rnd(skew, 5).alias("skew"), rnd(F.percentile("c", 0.75)).alias("p75"), rnd(F.max("c")).alias("top"),
    )


@register("edge_ranking", oracle("edge", "select d, s, t from (select d, s, t, row_number() over (partition by d order by c desc, s desc, t desc) k from edge) where k <= 3"))
def edge_ranking(s, d):
    w = Window.partitionBy("d").orderBy(F.desc("c"), F.desc("s"), F.desc("t"))
    return edges(s, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("d", "s", "t")


@register("exposure_concentration", oracle("exposure", "select d, source, round(sum(pow(weight / total, 2)), 6) + 0e0 hhi from (select d, source, weight, sum(weight) over (partition by d, source) total from exposure) group by 1, 2"))
def exposure_concentration(s, d):
    w = Window.partitionBy("d", "source")
    return v.exposure(s, d).withColumn("p", F.col("weight") / F.sum("weight").over(w)).groupBy("d", "source").agg(rnd(F.sum(F.col("p") * F.col("p"))).alias("hhi"))


@register("embedding_network", """with e as (select vec_id, label, embedding v from embeddings) select a.label, count(*) links, round(avg(list_cosine_similarity(cast(a.v as double[]), cast(b.v as double[]))), 5) + 0e0 mean
    from e a join e b on a.label = b.label and a.vec_id < b.vec_id group by 1""")
def embedding_network(s, d):
    e = v.table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(net.mean_cosine(e, "label", "vec_id", "v"), "mean", digits=5)


@register("spectral_risk")
def spectral_risk(s, d):
    rows = spectral.spectrum(spectral.modes(edges(s, d), "d"), "d")
    return rows.select("d", rnd(clip(1 - F.col("lambda_2") / F.col("radius"), 0.0, 1.0)).alias("risk"))
