"""Queries over exchange rates, walk-forward validation, sensitivity of stress losses, channels and reconstructions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.columns import rounded
from riskweave.operators import coarse, network as net, rates, resampling, spectral, validation as val
from riskweave.plans.catalog import register
from riskweave.plans.graphs import edges
from riskweave.plans.scores import _FORE, _forecasts, _prefixed
from riskweave.sources import views as v
from riskweave.sources.scratch import own_path

# --- exchange rates ------------------------------------------------------------------------------------

_RATE = "rate as (select 'C' || (bank % 5) ccy, d, avg(price) / 100000 rate from price group by 1, 2)"


def _rates(s, d):
    return v.price(s, d).groupBy(F.concat(F.lit("C"), (F.col("bank") % 5).cast("string")).alias("ccy"), "d").agg((F.avg("price") / 100000).alias("rate"))


def _asof(side: str) -> str:
    return f"asof left join rate {side}r on {side}r.ccy = o.{side} and {side}r.d <= o.d left join ends {side}e on {side}e.ccy = o.{side} and o.d <= {side}e.most"


def _of(side: str) -> str:
    return f"case when o.{side} = 'EUR' then 1e0 when {side}e.ccy is not null then {side}r.rate end"


@register("converted_amounts", _prefixed("price", f"{_RATE}, ends as (select ccy, max(d) most from rate group by 1), o as (select 'C' || (o_custkey % 5) src, case when o_orderkey % 3 = 0 then 'EUR' else 'C' || (o_orderkey % 5) end dst, cast(o_orderdate as date) d, o_totalprice amount from orders)", f"select src, dst, count(*) n, count(value) known, round(sum(value) / 1e6, 4) + 0e0 total from (select o.src, o.dst, case when o.src = o.dst then amount else amount / ({_of('src')}) * ({_of('dst')}) end as value from o {_asof('src')} {_asof('dst')}) group by 1, 2"))
def converted_amounts(s, d):
    """Orders in other currencies; the days after a currency's last rate have no value."""
    code = lambda c: F.concat(F.lit("C"), (F.col(c) % 5).cast("string"))
    o = v.table(s, d, "orders").select(code("o_custkey").alias("src"), F.when(F.col("o_orderkey") % 3 == 0, "EUR").otherwise(code("o_orderkey")).alias("dst"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    out = rates.converted(o, _rates(s, d), F.col("o_totalprice")).groupBy("src", "dst")
    return rounded(out.agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), (F.sum("value") / 1e6).alias("total")), "total", digits=4)


@register("daily_rates", _prefixed("price", f"{_RATE}, days as (select ccy, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from rate group by ccy)", "select days.ccy, days.d, round(rate, 6) + 0e0 rate from days asof join rate on rate.ccy = days.ccy and rate.d <= days.d"))
def daily_rates(s, d):
    return rounded(rates.daily(_rates(s, d)), "rate")


@register("cached_rates", _prefixed("price", _RATE, "select ccy, count(*) n, round(avg(rate), 6) + 0e0 rate from rate where ccy <> 'C4' group by 1 union all select 'C4', 0, null"))
def cached_rates(s, d):
    """Rates kept in a cache, and the currencies of the banks that it has none of."""
    path = own_path(s, "rates")
    wanted = _rates(s, d)
    rates.save(wanted.where("ccy != 'C4'"), path)
    held = rates.load(s, path)
    known = held.groupBy("ccy").agg(F.count(F.lit(1)).alias("n"), F.avg("rate").alias("rate"))
    lacking = rates.missing(wanted, held).select("ccy", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("rate"))
    return rounded(known.unionByName(lacking), "rate")


# --- walk-forward validation ---------------------------------------------------------------------------

_ROWS = f"{_FORE}, x as (select row_number() over (order by d, a) - 1 i, v, ma from fore), n as (select count(*) n from x)"
_EVEN = "fold as (select fold, 20 + fold * greatest(1, (n - 20 - 2 - 10) // 4) train_end, 20 + fold * greatest(1, (n - 20 - 2 - 10) // 4) + 2 test_start, least(20 + fold * greatest(1, (n - 20 - 2 - 10) // 4) + 2 + 10, n) test_end from (select unnest(range(4)) fold), n)"
_LAST = "fold as (select fold, 20 + ((n - 10 - 22) * fold) // 3 train_end, 22 + ((n - 10 - 22) * fold) // 3 test_start, least(22 + ((n - 10 - 22) * fold) // 3 + 10, n) test_end from (select unnest(range(4)) fold), n)"
_SCORE = "fit as (select fold, regr_slope(v, ma) slope, regr_intercept(v, ma) base from x join fold on i < train_end group by 1), score as (select fold, train_end, test_start, count(*) n, 1 - sum(pow(v - base - slope * ma, 2)) / (var_pop(v) * count(*)) r2, avg(pow(v - base - slope * ma, 2)) mse from x join fold on i >= test_start and i < test_end join fit using (fold) group by 1, 2, 3)"

for _name, _folds, _fold_sql in (("even", val.expanding_folds, _EVEN), ("last", val.spaced_folds, _LAST)):

    def _scores(s, d, folds=_folds):
        rows = resampling.numbered(_forecasts(s, d).select("a", "d", "v", "ma"), ["d", "a"])
        found = folds(s, rows.count(), 4, 20, 10, 2)
        return val.walk_forward(rows, found, "ma", "v").join(found.select("fold", "train_end", "test_start"), "fold")

    @register(f"walk_forward_{_name}", _prefixed("asset", f"{_ROWS}, {_fold_sql}, {_SCORE}", "select fold, train_end, test_start, n, round(r2, 5) + 0e0 r2, round(mse, 4) + 0e0 mse from score"))
    def _walk(s, d, scores=_scores):
        return rounded(rounded(scores(s, d), "r2", digits=5), "mse", digits=4)

    @register(f"walk_forward_{_name}_summary", _prefixed("asset", f"{_ROWS}, {_fold_sql}, {_SCORE}", "select round(avg(r2), 5) + 0e0 mean_r2, round(stddev_pop(r2), 5) + 0e0 sd_r2, round(median(r2), 5) + 0e0 median_r2, round(avg(mse), 4) + 0e0 mse from score"))
    def _summary(s, d, scores=_scores):
        return rounded(rounded(val.fold_summary(scores(s, d)), "mean_r2", "sd_r2", "median_r2", digits=5), "mse", digits=4)


_R2 = "count(*) n, round(1 - sum(pow(v - ma, 2)) / (var_pop(v) * count(*)), 5) + 0e0 r2, round(avg(pow(v - ma, 2)), 4) + 0e0 mse"


@register("fit_by_target", _prefixed("asset", _FORE, f"select a target, {_R2} from fore group by 1 union all select 'all', {_R2} from fore"))
def fit_by_target(s, d):
    rows = _forecasts(s, d)
    each = val.fits(rows, "v", "ma", "a").withColumnRenamed("a", "target")
    pooled = val.fits(rows.withColumn("target", F.lit("all")), "v", "ma", "target")
    return rounded(rounded(each.unionByName(pooled), "r2", digits=5), "mse", digits=4)


@register("corrected_interval")
def corrected_interval(s, d):
    rows = resampling.numbered(_forecasts(s, d).select("a", "d", "v"), ["a", "d"])
    return rounded(val.corrected_interval(rows, "v", 500), "estimate", "low", "high", "se", digits=5)


@register("reconstruction", """with e as (select label, cast(embedding as double[]) x, list_transform(cast(embedding as double[]), lambda p: floor(p * 10) / 10) y from embeddings)
    select label, count(*) n, round(avg(m), 6) + 0e0 mse, round(sqrt(avg(m)), 6) + 0e0 rmse, round(avg(l), 6) + 0e0 mae, round(avg(c), 6) + 0e0 cosine, round(max(m), 6) + 0e0 worst
    from (select label, pow(list_distance(x, y), 2) / len(x) m, list_avg(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) l, list_cosine_similarity(x, y) c from e) group by 1""")
def reconstruction(s, d):
    """Errors of embeddings that are cut to one decimal; ``worst`` is the highest anomaly score of a row."""
    x = F.col("embedding").cast("array<double>")
    rows = v.table(s, d, "embeddings").select("label", x.alias("x")).withColumn("y", F.transform("x", lambda p: F.floor(p * 10) / 10))
    rows = rows.select("label", *(c.alias(n) for n, c in val.reconstruction(F.col("x"), F.col("y")).items()))
    out = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"), F.avg("cosine").alias("cosine"), F.max("mse").alias("worst"))
    return rounded(out, "mse", "rmse", "mae", "cosine", "worst")


# --- sensitivity of stress losses ----------------------------------------------------------------------

_POINTS = 1024
_BOUNDS = {"shock": (0.1, 0.9), "severity": (0.2, 0.8), "haircut": (0.0, 0.6)}
_LOSS = "greatest(0, shock * severity * interbank_assets + haircut * cash - 0.25 * cet1 / 100 * total_assets)"
_RUN = f"y as (select run, moved, sum({_LOSS}) y from point cross join bank_state group by 1, 2)"


def _shortfall(s, d, points):
    """Capital that banks lack at each of ``points``, which are few by their parameter and are sent to the banks."""
    return v.bank_state(s, d).join(F.broadcast(points)).groupBy("run", "moved").agg(F.sum(F.expr(_LOSS)).alias("y"))


def _place(prime: int, name: str) -> str:
    lo, hi = _BOUNDS[name]
    x = f"((run + 0.5e0) * sqrt({prime}e0))"
    return f"{lo}e0 + {hi - lo}e0 * ({x} - floor({x}))"


def _points(kinds: dict[str, dict[str, str]]) -> str:
    return f"r as (select unnest(range({_POINTS})) run), point as (" + " union all ".join(f"select run, '{k}' moved, " + ", ".join(f"{c} {n}" for n, c in x.items()) + " from r" for k, x in kinds.items()) + ")"


_A = {n: _place(p, n) for n, p in zip(_BOUNDS, (2, 3, 5), strict=True)}
_B = {n: _place(p, n) for n, p in zip(_BOUNDS, (7, 11, 13), strict=True)}
_MOVED = {"": _A} | {n: _A | {n: f"least({hi}e0, {_A[n]} + {0.5 * (hi - lo)}e0)"} for n, (lo, hi) in _BOUNDS.items()}
_WIDTH = "case moved " + " ".join(f"when '{n}' then {0.5 * (hi - lo)}e0" for n, (lo, hi) in _BOUNDS.items()) + " end"


@register("parameter_screening", _prefixed("bank_state", f"{_points(_MOVED)}, {_RUN}", f"select moved as parameter, round(avg(abs(e)), 5) + 0e0 effect, round(stddev_pop(e), 5) + 0e0 spread from (select m.moved, (m.y - b.y) / {_WIDTH.replace('moved', 'm.moved', 1)} e from y m join y b on b.run = m.run and b.moved = '' where m.moved <> '') group by 1"))
def parameter_screening(s, d):
    found = val.elementary_effects(_shortfall(s, d, val.screening_points(s, _BOUNDS, _POINTS)), _BOUNDS, "y")
    return rounded(found, "effect", "spread", digits=5)


@register("variance_shares", _prefixed("bank_state", f"{_points({' a': _A, ' b': _B} | {n: _A | {n: _B[n]} for n in _BOUNDS})}, {_RUN}", "select m.moved as parameter, round(avg(b.y * (m.y - a.y)) / (select var_pop(y) from y where moved in (' a', ' b')), 5) + 0e0 as first, round(avg(pow(a.y - m.y, 2)) / 2 / (select var_pop(y) from y where moved in (' a', ' b')), 5) + 0e0 total from y m join y a on a.run = m.run and a.moved = ' a' join y b on b.run = m.run and b.moved = ' b' where m.moved not in (' a', ' b') group by 1"))
def variance_shares(s, d):
    return rounded(val.variance_shares(_shortfall(s, d, val.variance_points(s, _BOUNDS, _POINTS)), "y"), "first", "total", digits=5)


_CHANNELS = {"all": (1, 1), "no_funding": (0, 1), "no_firesale": (1, 0), "credit_only": (0, 0)}
_DEFAULT = "shock * (0.6 * interbank_assets + funding * 0.3 * interbank_liabilities + firesale * 0.5 * cash) > 0.25 * cet1 / 100 * total_assets"


@register("channel_ablation", _prefixed("bank_state", "c(config, funding, firesale) as (values " + ", ".join(f"('{n}', {a}, {b})" for n, (a, b) in _CHANNELS.items()) + f"), run as (select run, (run + 1) / 33e0 shock from (select unnest(range(32)) run)), each as (select config, run, count(*) filter ({_DEFAULT}) n from bank_state cross join run cross join c group by 1, 2)", "select config, round(avg(n), 6) + 0e0 mean, round(stddev_pop(n), 6) + 0e0 sd, max(n) most, round(avg(case when n > 0 then 1e0 else 0e0 end), 6) + 0e0 rate from each group by 1"))
def channel_ablation(s, d):
    """Defaults over growing shocks with channels of contagion left out."""
    configs = F.array(*(F.struct(F.lit(n).alias("config"), F.lit(a).alias("funding"), F.lit(b).alias("firesale")) for n, (a, b) in _CHANNELS.items()))
    points = s.range(32).select(F.col("id").alias("run"), ((F.col("id") + 1) / 33).alias("shock"), F.explode(configs).alias("c")).select("run", "shock", "c.*")
    each = v.bank_state(s, d).join(F.broadcast(points)).groupBy("config", "run").agg(F.count_if(F.expr(_DEFAULT)).alias("n"))
    out = each.groupBy("config").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max("n").alias("most"), F.avg(F.when(F.col("n") > 0, 1.0).otherwise(0.0)).alias("rate"))
    return rounded(out, "mean", "sd", "rate")


# --- coarse graining -----------------------------------------------------------------------------------


def _coarse(s, d):
    e = edges(s, d)
    return e, spectral.modes(e, "d", normalised=False)


def _hubs(e):
    """The node of each snapshot that has the most edges, by smallest number."""
    degree = net.degrees(net.mirrored(e), ["d"])
    return degree.groupBy("d").agg(F.min_by("node", F.struct(-F.col("k"), "node")).alias("node"))


@register("coarse_rescaled")
def coarse_rescaled(s, d):
    """Coarse weights over the value of their last mode, null for a snapshot of too many parts."""
    e, modes = _coarse(s, d)
    return rounded(coarse.rescaled(spectral.coarse_weights(modes, e, "d", 3), modes, "d", 3, strict=False), "w")


@register("coarse_spectrum_error")
def coarse_spectrum_error(s, d):
    """The values of the network against those of its coarse-grained weights."""
    e, modes = _coarse(s, d)
    other = spectral.modes(spectral.coarse_weights(modes, e, "d", 3).withColumnRenamed("w", "c"), "d", normalised=False)
    return rounded(coarse.spectrum_error(modes, other, "d", 3), "error", digits=5)


def _diffusion(s, d):
    e, modes = _coarse(s, d)
    return coarse.diffusion_by_scale(modes, "d", _hubs(e), list(range(1, 13)), list(range(1, 11)))


@register("diffusion_by_scale")
def diffusion_by_scale(s, d):
    return rounded(_diffusion(s, d), "error", "corr", "rmse", "r2", digits=5)


@register("best_scale")
def best_scale(s, d):
    return coarse.best_scale(_diffusion(s, d), "d")
