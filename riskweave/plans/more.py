"""Queries over generated sources, decisions and dynamics of banks, shortest paths, resampling intervals and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.columns import rnd, rounded
from riskweave.operators import contagion as con, decisions as dec, paths, resampling, stats, timeseries as ts
from riskweave.operators.components import connected_components
from riskweave.plans.catalog import register
from riskweave.plans.graphs import _CORR, correlations
from riskweave.plans.scores import _FORE, _forecasts, _prefixed
from riskweave.sources import generated as gen, views as v
from riskweave.sources.scratch import own_path
from riskweave.sources.views import oracle


def _banks(s, d):
    return v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("bank"))


def _source(name: str) -> None:
    @register(f"source_{name}", gen.sql(name))
    def query(s, d):
        if name.endswith("_gap"):
            rows = gen.indicator(s, name, _banks(s, d))
        else:
            rows = gen.collected(s, name, _banks(s, d))
        return rounded(rows, *gen.SOURCES[name][2])


for _name in gen.SOURCES:
    _source(_name)


@register("source_equity", f"""with recursive r as (select d, bank, row_number() over (partition by bank order by d) k, {gen.DRIFT}e0 + {gen.SPREAD}e0 * {gen.noise(12)} r, cast(1000000 * (1 + 0.2e0 * abs({gen.noise(13)})) as double) volume
    from (select d, cast(n_nationkey as bigint) bank, cast(date_diff('day', date '1970-01-01', d) as bigint) as days from (select cast(unnest(generate_series(date '{gen.START}', date '1995-06-30', interval 1 day)) as date) d) cross join nation where isodow(d) < 6)),
    w as (select bank, cast(0 as bigint) k, cast(20 + 3 * n_nationkey as double) p from (select cast(n_nationkey as bigint) bank, n_nationkey from nation) union all select w.bank, r.k, greatest({gen.FLOOR}e0, w.p * (1 + r.r)) from w join r on r.bank = w.bank and r.k = w.k + 1)
    select r.d, r.bank, round(w.p, 6) + 0e0 price, round(r.volume, 2) + 0e0 volume from w join r on r.bank = w.bank and r.k = w.k""")
def source_equity(s, d):
    return rounded(rounded(gen.equity(s, _banks(s, d)), "price"), "volume", digits=2)


@register("source_scan", f"select * from ({gen.sql('liquidity')}) where d between date '1997-01-01' and date '1998-12-31' and bank < 10")
def source_scan(s, d):
    """A source written out and scanned again, by range of dates and banks."""
    path = own_path(s, "liquidity")
    banks = _banks(s, d)
    gen.generated(s, "liquidity", banks).write.mode("overwrite").parquet(path)
    rows = gen.collected(s, "liquidity", banks.where("bank < 10"), "1997-01-01", "1998-12-31", path)
    return rounded(rows, *gen.SOURCES["liquidity"][2]).select("d", "bank", *gen.SOURCES["liquidity"][2])


@register("universe", "select cast(n_nationkey as bigint) id, 'B' || lpad(cast(n_nationkey as varchar), 3, '0') ticker, n_name as name, case when r_name = 'EUROPE' then 'EUR' else 'USD' end currency, r_name region from nation join region on n_regionkey = r_regionkey")
def universe(s, d):
    n = v.table(s, d, "nation").join(F.broadcast(v.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    ticker = F.concat(F.lit("B"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), ticker.alias("ticker"), F.col("n_name").alias("name"), F.when(F.col("r_name") == "EUROPE", "EUR").otherwise("USD").alias("currency"), F.col("r_name").alias("region"))


@register("universes", "select r_name as name, count(*) banks, string_agg(n_name, ',' order by n_name) members from nation join region on n_regionkey = r_regionkey group by 1")
def universes(s, d):
    return universe(s, d).groupBy(F.col("region").alias("name")).agg(F.count(F.lit(1)).alias("banks"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))


@register("graph_export", oracle("exposure", "select source node, count(*) edges, round(sum(weight) / 1e6, 4) + 0e0 weight from exposure group by 1"))
def graph_export(s, d):
    """The edge table written out by quarter, as a graph learner would load it, and read again."""
    path = own_path(s, "edges")
    v.exposure(s, d).write.mode("overwrite").partitionBy("d").parquet(path)
    return s.read.parquet(path).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("edges"), rnd(F.sum("weight") / 1e6, 4).alias("weight"))


# --- decisions and dynamics ----------------------------------------------------------------------------

_SHOCK = "sh as (select bank, (cet1 - 12) / 4 d_cet1, (lcr - 130) / 2 d_lcr, total_assets from bank_state)"


def _shocks(s, d):
    return v.bank_state(s, d).select("bank", ((F.col("cet1") - 12) / 4).alias("d_cet1"), ((F.col("lcr") - 130) / 2).alias("d_lcr"), "total_assets")


for _stressed in (False, True):
    _times = "least(1e0, {} * 1.5)" if _stressed else "{}"

    @register(
        "shock_response_stressed" if _stressed else "shock_response",
        _prefixed("bank_state", _SHOCK, f"select bank, round(case when d_cet1 < 0 then {_times.format('least(0.8e0, abs(d_cet1) / 10)')} end, 6) + 0e0 capital_cut, round(case when d_lcr < 0 then {_times.format('least(0.9e0, abs(d_lcr) / 50)')} end, 6) + 0e0 liquidity_cut, round(case when d_lcr < 0 then total_assets * 0.05 end, 6) + 0e0 sought from sh"),
    )
    def _response(s, d, stressed=_stressed):
        return rounded(dec.shock_response(_shocks(s, d), stressed).select("bank", "capital_cut", "liquidity_cut", "sought"), "capital_cut", "liquidity_cut", "sought")


_OFFER = """offer as (select l.source lender, l.target borrower, 0.1 * a.total_assets * (1 + greatest(0, a.lcr - 100) / 100) * (1 + greatest(0, a.cet1 - 8) / 4) * 0.6 * 0.1 * (1 + 2 * l.weight) * least(1, b.cet1 / 15) offer
    from latest l join bank_state a on a.bank = l.source join bank_state b on b.bank = l.target where a.lcr >= 100 and b.cet1 >= 6)"""
_OUTCOME = "outcome as (select source lender, target borrower, d as seen, case when weight > 2e6 then 1e0 else -1e0 end outcome from exposure)"


def _offers(s, d):
    return con.lending_offers(v.bank_state(s, d), v.latest_exposure(s, d), 0.6)


def _outcomes(s, d):
    return v.exposure(s, d).select(F.col("source").alias("lender"), F.col("target").alias("borrower"), F.col("d").alias("at"), F.when(F.col("weight") > 2e6, 1.0).otherwise(-1.0).alias("outcome"))


@register("stressed_offers", _prefixed("bank_state latest", _OFFER, "select lender, borrower, round(offer * 0.6, 6) + 0e0 offer from offer"))
def stressed_offers(s, d):
    calm, low = dec.stressed_offers(_offers(s, d), 0.6), dec.stressed_offers(_offers(s, d), 0.2)
    return rounded(calm.unionByName(low), "offer")


_SCORES = _OUTCOME + ", score as (select lender, borrower, sum(0.1 * pow(0.9, n) * outcome) score from (select *, row_number() over (partition by lender, borrower order by seen desc) - 1 n from outcome) group by 1, 2)"


@register("interaction_scores", _prefixed("exposure", _SCORES, "select lender, borrower, round(score, 6) + 0e0 score from score"))
def interaction_scores(s, d):
    return rounded(dec.interaction_scores(_outcomes(s, d)), "score")


@register("learned_offers", _prefixed("bank_state latest", f"{_OFFER}, {_SCORES}", "select lender, borrower, round(offer * (1 + coalesce(score, 0)), 6) + 0e0 offer from offer left join score using (lender, borrower) where offer * (1 + coalesce(score, 0)) > 0"))
def learned_offers(s, d):
    return rounded(dec.learned_offers(_offers(s, d), dec.interaction_scores(_outcomes(s, d))), "offer")


@register("updated_connections", _prefixed("bank_state latest", _OFFER, "select l.source, l.target, round(coalesce(o.offer, l.weight), 6) + 0e0 weight from latest l left join offer o on o.lender = l.source and o.borrower = l.target and o.offer > 1"))
def updated_connections(s, d):
    lent = _offers(s, d).where("offer > 1").withColumnRenamed("offer", "amount")
    return rounded(dec.with_connections(v.latest_exposure(s, d), lent), "weight")


@register("connection_strength", oracle("latest", "select cast(a.n_nationkey as bigint) source, cast(b.n_nationkey as bigint) target, round(coalesce(weight, 0), 6) + 0e0 weight from nation a join nation b on b.n_nationkey = (a.n_nationkey * 7 + 1) % 25 left join latest l on l.source = a.n_nationkey and l.target = b.n_nationkey"))
def connection_strength(s, d):
    pairs = _banks(s, d).select(F.col("bank").alias("source"), ((F.col("bank") * 7 + 1) % 25).alias("target"))
    return rounded(dec.connection_strength(pairs, v.latest_exposure(s, d)), "weight").select("source", "target", "weight")


@register("frozen_banks", oracle("bank_state", "select bank, cet1 < 8 frozen from bank_state"))
def frozen_banks(s, d):
    state = v.bank_state(s, d)
    return dec.frozen(state, state.where("cet1 < 8")).select("bank", "frozen")


@register("state_memory", oracle("ret", "select bank, d, n, round(s, 6) + 0e0 total from (select bank, d, count(*) over w n, sum(r) over w s from ret window w as (partition by bank order by d rows between 9 preceding and current row))"))
def state_memory(s, d):
    rows = dec.remembered(v.ret(s, d), "bank", "d", "r")
    return rows.select("bank", "d", F.size("memory").cast("long").alias("n"), rnd(F.aggregate("memory", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_Z = "(({} * 37 + 11) % 101) / 50e0 - 1"
_U = "(({} * 53 + 7) % 97) / 97e0"
_JUMPS = "case when u <= exp(-l) then 0 when u <= exp(-l) * (1 + l) then 1 when u <= exp(-l) * (1 + l + l * l / 2) then 2 when u <= exp(-l) * (1 + l + l * l / 2 + l * l * l / 6) then 3 else 4 end"


@register("dynamics_steps", oracle("bank_state", f"""select bank, jumps, round(least(greatest(cet1 + 0.05 * (12 - cet1) + 0.25 * z - 0.8 * jumps, 0), 30), 6) + 0e0 jumped, regime, round(least(greatest(cet1 + case when regime = 0 then 0.08 else 0.02 end * (12 - cet1) + case when regime = 0 then 0.15 else 0.6 end * z, 0), 30), 6) + 0e0 switched,
    round(least(greatest(cet1 + case when cet1 < 8 then 0.05 * (0.3 + 0.7 * (1 - (8 - cet1) / 8)) else 0.05 end * 0.75 * (12 - cet1) + 0.25 * z, 0), 30), 6) + 0e0 slowed
    from (select *, {_JUMPS} jumps, case when bank % 2 = 0 then case when u < 0.01 * 2.5 then 1 else 0 end else case when u < 0.05 * 0.75 then 0 else 1 end end regime from (select *, {_Z.format('bank')} z, {_U.format('bank')} u, 0.4e0 * 2 l from bank_state))"""))
def dynamics_steps(s, d):
    """One step of each process, at a stress of one half, with given noise."""
    rows = v.bank_state(s, d).select("bank", "cet1", F.expr(_Z.format("bank")).alias("z"), F.expr(_U.format("bank")).alias("u"), (F.col("bank") % 2).alias("was"))
    mean = F.lit(12.0)
    rows = rows.withColumns({"jumps": F.least(dec.poisson(F.col("u"), F.lit(0.4) * (1 + 2 * 0.5)), F.lit(4)), "regime": dec.next_regime(F.col("was"), F.col("u"), 0.5)})
    x, z = F.col("cet1"), F.col("z")
    return rows.select(
        "bank", "jumps", rnd(dec.jump_step(x, mean, z, -0.8 * F.col("jumps"))).alias("jumped"), "regime",
        rnd(dec.regime_step(x, mean, z, F.col("regime"))).alias("switched"), rnd(dec.slowed_step(x, mean, z, 0.5)).alias("slowed"),
    )


# --- networks ------------------------------------------------------------------------------------------


def _paths_sql(body: str) -> str:
    """All shortest distances of the latest exposures, by six doublings of min-plus products."""
    steps = ["node as (select source n from latest union select target from latest)", "w as (select source, target, min(weight) x from latest group by 1, 2)", "p0 as (select source a, target b, x from w union all select n, n, 0e0 from node)"]
    for k in range(1, 6):
        steps.append(f"p{k} as materialized (select l.a, r.b, min(l.x + r.x) x from p{k - 1} l join p{k - 1} r on l.b = r.a group by 1, 2)")
    return _prefixed("latest", ", ".join(steps), body)


@register("path_centralities", _paths_sql("""select n as node, round((select count(*) from w where source = n or target = n) / ((select count(*) from node) - 1), 6) + 0e0 degree,
    round(coalesce((select (count(*) - 1) / sum(x) * (count(*) - 1) / ((select count(*) from node) - 1) from p5 where b = n having sum(x) > 0), 0), 6) + 0e0 closeness,
    round((select count(*) from p5 s join p5 t on s.b = t.a join p5 st on st.a = s.a and st.b = t.b where s.b = n and s.a <> n and t.b <> n and s.a <> t.b and abs(s.x + t.x - st.x) <= 1e-12 * (1 + st.x)) / (((select count(*) from node) - 1) * ((select count(*) from node) - 2)), 6) + 0e0 betweenness from node"""))
def path_centralities(s, d):
    return rounded(paths.centralities(v.latest_exposure(s, d).withColumn("g", F.lit(1)), ["g"]).drop("g"), "degree", "closeness", "betweenness")


def _eigen_sql(rounds: int) -> str:
    steps = ["sym as (select source a, target b, weight x from latest union all select target, source, weight from latest)", "e0 as (select distinct a n, 1e0 x from sym)"]
    for k in range(1, rounds + 1):
        steps.append(f"f{k} as materialized (select n, o.x + coalesce(sum(sym.x * p.x), 0) x from e{k - 1} o join sym on sym.a = n join (select n m, x from e{k - 1}) p on p.m = sym.b group by n, o.x), e{k} as materialized (select n, x / (select sqrt(sum(x * x)) from f{k}) x from f{k})")
    return _prefixed("latest", ", ".join(steps), f"select n as node, round(x, 5) + 0e0 eigenvector from e{rounds}")


@register("eigenvector_centrality", _eigen_sql(40))
def eigenvector_centrality(s, d):
    return rounded(paths.eigenvector(v.latest_exposure(s, d).withColumn("g", F.lit(1)), ["g"], 40).drop("g"), "eigenvector", digits=5)


_GRID = [round(0.05 + 0.05 * k, 2) for k in range(16)]


@register("percolation", _prefixed("ret", _CORR, ", nodes as (select distinct bank n from ret), grid as (select unnest([" + ", ".join(f"{t}e0" for t in _GRID) + "]) t), twin36 as (select s, t, c from corr36 union all select t, s, c from corr36)").replace("with ", "with recursive ", 1)
    + ", reach as (select g.t, n a, n b from grid g, nodes union select r.t, r.a, w.t from reach r join twin36 w on w.s = r.b and abs(w.c) >= r.t), comp as (select t, a, min(b) root from reach group by 1, 2), sizes as (select t, root, count(*) n from comp group by 1, 2) select t threshold, count(*) components, max(n) largest, round(max(n) / sum(n), 6) + 0e0 fraction from sizes group by 1")
def percolation(s, d):
    """Components of the latest correlation network at each threshold; all thresholds are one graph, whose nodes stand once for each."""
    c = correlations(s, d)
    grid = F.explode(F.array(*(F.lit(t) for t in _GRID))).alias("threshold")
    place = F.round(F.col("threshold") * 100).cast("long") * 1_000_000
    edges = c.select("s", "t", "c", grid).where("abs(c) >= threshold").select((place + F.col("s")).alias("source"), (place + F.col("t")).alias("target"))
    nodes = v.ret(s, d).select("bank").distinct().select("bank", grid).withColumn("node", place + F.col("bank"))
    found = nodes.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("component", "node"))
    sizes = found.groupBy("threshold", "root").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("threshold").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), rnd(F.max("n") / F.sum("n")).alias("fraction"))


@register("network_comparison", _prefixed("ret", _CORR, "select 'above ' || x as method, count(*) filter (abs(c) >= cut) edges, round(count(*) filter (abs(c) >= cut) / 300e0, 6) + 0e0 density, round(avg(c) filter (abs(c) >= cut), 6) + 0e0 strength from corr36, (values ('0.2', 0.2e0), ('0.3', 0.3e0), ('0.5', 0.5e0)) g(x, cut) group by x"))
def network_comparison(s, d):
    c = correlations(s, d).select("c", F.explode(F.array(F.lit("0.2"), F.lit("0.3"), F.lit("0.5"))).alias("x"))
    kept = F.abs("c") >= F.col("x").cast("double")
    return c.groupBy("x").agg(F.count_if(kept).alias("edges"), rnd(F.avg(F.when(kept, F.col("c")))).alias("strength")).select(F.concat(F.lit("above "), "x").alias("method"), "edges", rnd(F.col("edges") / 300).alias("density"), "strength")


@register("node_clusters", _prefixed("ret", _CORR, "select cast(n_nationkey as bigint) node, 'cluster_' || (n_nationkey % 4) cluster from nation"))
def node_clusters(s, d):
    """Nodes by the name of their cluster."""
    clusters = _banks(s, d).select(F.col("bank").alias("node"), (F.col("bank") % 4).alias("k"))
    return paths.cluster_names(_banks(s, d).select(F.col("bank").alias("node")), clusters)


@register("top_pairs", oracle("latest", "select source, target, round(weight, 6) + 0e0 weight from latest where source <> target and weight > 0 order by weight desc, source, target limit 10"))
def top_pairs(s, d):
    return rounded(v.latest_exposure(s, d).where("source != target AND weight > 0").orderBy(F.desc("weight"), "source", "target").limit(10), "weight")


# --- series and comparisons ----------------------------------------------------------------------------


@register("spectral_momentum", oracle("market", "select d, round(case when n < 6 or w < 5 or s is null or s = 0 then 0 else (m - a) / s end, 5) + 0e0 z from (select d, m, count(*) over () n, count(*) over f w, avg(m) over f a, stddev_pop(m) over f s from market window f as (order by d rows between 5 preceding and 1 preceding))"))
def spectral_momentum(s, d):
    return rounded(ts.momentum(ts.market(v.ret(s, d)), "m", "d", 5), "z", digits=5).select("d", "z")


@register("conditional_risk", oracle("vol", "select d, round(abs(m) / max(abs(m)) over () * (v / max(v) over ()), 6) + 0e0 risk, round(abs(m) / pow(1 + sqrt(25 / 36e0), 2), 6) + 0e0 relative from vol"))
def conditional_risk(s, d):
    w = Window.orderBy("d").rowsBetween(-5, 0)
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(w)).withColumn("x", F.abs("m"))
    most = F.broadcast(rows.agg(F.max("x").alias("mx"), F.max("v").alias("mv")))
    rows = rows.join(most).withColumn("risk", F.col("x") / F.col("mx") * (F.col("v") / F.col("mv")))
    return rounded(rows.select("d", "risk", (F.col("x") / ts.noise_edge(36, 25)).alias("relative")), "risk", "relative")


_RISK = ("m", "v", "edges", "strength")


@register("risk_decomposition", _prefixed("vol degree", "day as (select vol.d, m, v, sum(k) / 2 edges, sum(deg) / 2 strength from vol join degree on degree.d = vol.d group by 1, 2, 3)", " union all ".join(f"select '{a}' x, '{b}' y, round(corr({a}, {b}), 6) + 0e0 c from day" for i, a in enumerate(_RISK) for b in _RISK[i + 1 :])))
def risk_decomposition(s, d):
    from riskweave.operators import network as net
    from riskweave.plans.graphs import both

    w = Window.orderBy("d").rowsBetween(-5, 0)
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(w))
    degree = net.degrees(both(s, d), ["d"]).groupBy("d").agg((F.sum("k") / 2).alias("edges"), (F.sum("strength") / 2).alias("strength"))
    return rounded(stats.correlation_pairs(rows.join(degree, "d"), _RISK), "c")


_ERR = _FORE + ", err as (select 'ma' model, pow(v - ma, 2) e from fore union all select 'last', pow(v - last, 2) from fore union all select 'zero', v * v from fore)"


@register("model_comparison", _prefixed("asset", _ERR, "select model, round(m, 5) + 0e0 mean, round(s, 5) + 0e0 sd, round(q, 5) + 0e0 median, n, round((m - bm) / sqrt(vr / n + bv / bn), 5) + 0e0 t from (select model, avg(e) m, stddev_pop(e) s, median(e) q, count(*) n, var_samp(e) vr from err group by 1), (select avg(e) bm, var_samp(e) bv, count(*) bn from err where model = 'last')"))
def model_comparison(s, d):
    rows = _forecasts(s, d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("model"), e.alias("e")) for n, e in (("ma", F.pow(F.col("v") - F.col("ma"), F.lit(2))), ("last", F.pow(F.col("v") - F.col("last"), F.lit(2))), ("zero", F.col("v") * F.col("v")))))).alias("x")).select("x.*")
    return rounded(stats.compared(rows, "model", "e", "last"), "mean", "sd", "median", "t", digits=5)


# --- resampling ----------------------------------------------------------------------------------------

_DRAWN = "('0x' || substr(md5(b || ':' || i), 1, 8))::bigint"
_COUNT = " + ".join(f"({_DRAWN} >= {t})::int" for t in resampling.TAIL)
_PAIRS = "x as (select row_number() over (order by a, d) - 1 i, v, ma from fore), b as (select unnest(range(200)) b)"


@register("bootstrap_intervals", _prefixed("asset", f"{_FORE}, {_PAIRS}, take as materialized (select b, v, ma, {_COUNT} w from b, x)", """select round(quantile_cont(m, 0.025), 5) + 0e0 mean_low, round(quantile_cont(m, 0.975), 5) + 0e0 mean_high, round(quantile_cont(r2, 0.025), 5) + 0e0 r2_low, round(quantile_cont(r2, 0.975), 5) + 0e0 r2_high, round(quantile_cont(c, 0.025), 5) + 0e0 corr_low, round(quantile_cont(c, 0.975), 5) + 0e0 corr_high
    from (select b, m, 1 - e / (vv - m * m) r2, (vp - m * p) / sqrt((vv - m * m) * (pp - p * p)) c from (select b, sum(w * v) / sum(w) m, sum(w * ma) / sum(w) p, sum(w * v * v) / sum(w) vv, sum(w * ma * ma) / sum(w) pp, sum(w * v * ma) / sum(w) vp, sum(w * pow(v - ma, 2)) / sum(w) e from take group by b))"""))
def bootstrap_intervals(s, d):
    """Percentile intervals of the mean, of R2 and of the correlation over the same resamples."""
    rows = resampling.numbered(_forecasts(s, d).select("a", "d", "v", "ma"), ["a", "d"])
    v_ = resampling.weighted("v")
    error = resampling.weighted(F.pow(F.col("v") - F.col("ma"), F.lit(2)))["mean"]
    each = resampling.resampled(rows, 200).groupBy("b").agg(v_["mean"].alias("m"), (1 - error / v_["variance"]).alias("r2"), resampling.weighted_correlation("v", "ma").alias("c"))
    return rounded(resampling.intervals(each, {"mean": "m", "r2": "r2", "corr": "c"}), *(f"{n}_{e}" for n in ("mean", "r2", "corr") for e in ("low", "high")), digits=5)


@register("block_bootstrap", _prefixed("market", "x as (select row_number() over (order by d) - 1 i, m from market), n as (select count(*) n, ceil(pow(3 * count(*), 1 / 3e0)) k from x), b as (select unnest(range(200)) b), s as (select b, unnest(range(cast(ceil(n / k) as bigint))) i, n, k from b, n), take as (select b, " + _DRAWN + " % cast(n - k + 1 as bigint) + unnest(range(cast(k as bigint))) j, i * k + unnest(range(cast(k as bigint))) place, n from s)", "select round(quantile_cont(q, 0.025), 6) + 0e0 low, round(quantile_cont(q, 0.975), 6) + 0e0 high from (select b, avg(m) q from take join x on x.i = j where place < n group by b)"))
def block_bootstrap(s, d):
    """Interval of a mean from blocks of neighbouring rows, about (3 n)^(1/3) long."""
    rows = resampling.numbered(ts.market(v.ret(s, d)), ["d"])
    each = resampling.blocks(rows, 200).groupBy("b").agg(F.avg("m").alias("q"))
    return rounded(resampling.intervals(each, {"": "q"}), "low", "high")
