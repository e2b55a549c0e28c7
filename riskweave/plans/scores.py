"""Queries over tests, scores, back-tests, contagion and forecasting baselines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.functions.columns import correlation, rnd, rounded
from riskweave.operators import contagion as con, learning, stats, timeseries as ts
from riskweave.plans.catalog import register
from riskweave.sources import views as v
from riskweave.sources.scratch import materialise
from riskweave.sources.views import oracle


def _prefixed(views: str, more: str, body: str) -> str:
    head = oracle(views, "").rstrip()
    return f"{head}{',' if head else 'with'} {more} {body}"


@register("welch_test", "with g as (select avg(value) filter (event_type = 'click') m1, avg(value) filter (event_type = 'view') m2, var_samp(value) filter (event_type = 'click') v1, var_samp(value) filter (event_type = 'view') v2, count(*) filter (event_type = 'click') n1, count(*) filter (event_type = 'view') n2 from events) select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0e0 t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) + 0e0 dof, round((m1 - m2) / sqrt((v1 + v2) / 2), 6) + 0e0 cohen_d, round(m1 - m2 - 1.96 * sqrt(v1 / n1 + v2 / n2), 6) + 0e0 low, round(m1 - m2 + 1.96 * sqrt(v1 / n1 + v2 / n2), 6) + 0e0 high from g")
def welch_test(s, d):
    out = stats.welch(v.table(s, d, "events"), "event_type", "value", "click", "view").drop("p")
    return rounded(rounded(out, "t", "cohen_d", "low", "high"), "dof", digits=4)


def _forecasts(s, d):
    rows = learning.persistence(learning.moving_average(v.asset(s, d), "v", "a", 5).withColumnRenamed("forecast", "ma"), "v", "a")
    return rows.where("ma IS NOT NULL AND forecast IS NOT NULL").select("a", "d", "v", "ma", F.col("forecast").alias("last"))


_FORE = "fore as (select * from (select a, d, v, avg(v) over (partition by a order by d rows between 5 preceding and 1 preceding) ma, lag(v) over (partition by a order by d) last from asset) where ma is not null and last is not null)"


@register("moving_average_forecast", _prefixed("asset", _FORE, "select a, d, round(ma, 6) + 0e0 ma, round(last, 6) + 0e0 last from fore"))
def moving_average_forecast(s, d):
    return rounded(_forecasts(s, d).drop("v"), "ma", "last")


@register("diebold_mariano_h1", _prefixed("asset", _FORE, "select round(avg(x), 5) + 0e0 mean, round(var_samp(x) / count(x), 4) + 0e0 as var, round(avg(x) / sqrt(var_samp(x) / count(x)), 6) + 0e0 dm from (select pow(v - ma, 2) - pow(v - last, 2) x from fore where a = 'click')"))
def diebold_mariano_h1(s, d):
    e = _forecasts(s, d).where("a = 'click'").select("d", (F.col("v") - F.col("ma")).alias("e1"), (F.col("v") - F.col("last")).alias("e2"))
    return stats.diebold_mariano(e, "e1", "e2", "d").select(rnd("mean", 5).alias("mean"), rnd("var", 4).alias("var"), rnd("dm").alias("dm"))


@register("diebold_mariano_h3", _prefixed("asset", _FORE, "select round(avg(x), 5) + 0e0 mean, round(greatest((var_samp(x) + 2 * covar_samp(x, l1) + 2 * covar_samp(x, l2)) / count(x), 1e-15), 4) + 0e0 as var from (select x, lag(x) over (order by d) l1, lag(x, 2) over (order by d) l2 from (select d, pow(v - ma, 2) - pow(v - last, 2) x from fore where a = 'view'))"))
def diebold_mariano_h3(s, d):
    e = _forecasts(s, d).where("a = 'view'").select("d", (F.col("v") - F.col("ma")).alias("e1"), (F.col("v") - F.col("last")).alias("e2"))
    return stats.diebold_mariano(e, "e1", "e2", "d", 3).select(rnd("mean", 5).alias("mean"), rnd("var", 4).alias("var"))


@register("corrected_p", oracle("ret", """select bank, round(least(1, p * n), 6) + 0e0 bonferroni, round(least(1, max((n - k + 1) * p) over (order by p, bank)), 6) + 0e0 holm, round(least(1, min(n / k * p) over (order by p desc, bank desc)), 6) + 0e0 bh from (
    select bank, p, row_number() over (order by p, bank) k, count(*) over () n from (select bank, exp(-abs(avg(r) / stddev_samp(r) * sqrt(count(*)))) p from ret group by 1))"""))
def corrected_p(s, d):
    p = v.ret(s, d).groupBy("bank").agg(F.exp(-F.abs(F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count(F.lit(1))))).alias("p"))
    return rounded(stats.corrected(p, "p", ["bank"]), "bonferroni", "holm", "bh").drop("p")


_CONF = """conf as (select a, d, v, last, last - w low, last + w high from fore, (select quantile_cont(abs(v - last), least(ceil(0.9 * (count(*) + 1)) / count(*), 1)) w from fore where extract(day from d) < 20) where extract(day from d) >= 20)"""


@register("conformal_interval", _prefixed("asset", _FORE + ", cal as (select list_sort(list(abs(v - last))) r, count(*) n, least(ceil(0.9 * (count(*) + 1)) / count(*), 1) q from fore where extract(day from d) < 20), wid as (select r[cast(floor(q * (n - 1)) as int) + 1] + (r[cast(ceil(q * (n - 1)) as int) + 1] - r[cast(floor(q * (n - 1)) as int) + 1]) * (q * (n - 1) - floor(q * (n - 1))) w from cal)", "select a, d, round(last - w, 5) + 0e0 low, round(last + w, 5) + 0e0 high from fore, wid where extract(day from d) >= 20"))
def conformal_interval(s, d):
    rows = _forecasts(s, d)
    return rounded(stats.conformal(rows.where("day(d) < 20"), rows.where("day(d) >= 20"), "v", "last").select("a", "d", "low", "high"), "low", "high", digits=5)


@register("calibration_scores", _prefixed("asset", _FORE, "select round(p, 6) + 0e0 picp, round(w, 6) + 0e0 mpiw, round(case when p < 0.95 then w * exp(-50 * (p - 0.95)) else w end, 4) + 0e0 cwc from (select avg(case when v between last - 12 and last + 12 then 1e0 else 0e0 end) p, avg(24e0) w from fore)"))
def calibration_scores(s, d):
    out = stats.calibration(_forecasts(s, d).select("v", (F.col("last") - 12).alias("low"), (F.col("last") + 12).alias("high")), "v", "low", "high")
    return rounded(rounded(out, "picp", "mpiw"), "cwc", digits=4)


@register("pinball_loss", _prefixed("asset", _FORE, "select a, round(avg(greatest(0.9 * (v - ma), -0.1 * (v - ma))), 6) + 0e0 loss from fore group by 1"))
def pinball_loss(s, d):
    return _forecasts(s, d).groupBy("a").agg(rnd(stats.pinball(None, "v", "ma", 0.9)).alias("loss"))


@register("regression_scores", _prefixed("asset", _FORE, "select round(mse, 6) + 0e0 mse, round(sqrt(mse), 6) + 0e0 rmse, round(mae, 6) + 0e0 mae, round(1 - mse / vp, 6) + 0e0 r2, round(mape, 6) + 0e0 mape from (select avg(pow(v - ma, 2)) mse, avg(abs(v - ma)) mae, avg(abs((v - ma) / v)) filter (v <> 0) mape, var_pop(v) vp from fore)"))
def regression_scores(s, d):
    return rounded(stats.regression(_forecasts(s, d), "v", "ma"), "mse", "rmse", "mae", "r2", "mape")


@register("auc", "select event_type a, round(case when sum(y) = 0 or sum(y) = count(*) then 0 else (sum(y * k) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) end, 6) + 0e0 auc from (select event_type, y, rank() over (partition by event_type order by x) + (count(*) over (partition by event_type, x) - 1) / 2.0 k from (select event_type, floor(value) x, case when user_id % 3 = 0 then 1 else 0 end y from events)) group by 1")
def auc(s, d):
    rows = v.table(s, d, "events").select(F.col("event_type").alias("a"), F.floor("value").alias("x"), (F.col("user_id") % 3 == 0).cast("long").alias("y"))
    return rounded(stats.auc(rows, "y", "x", ["a"]), "auc")


@register("ar1_forecast", oracle("asset", "select a, round(c * (1 - pow(b, 5)) / (1 - b) + pow(b, 5) * l, 5) + 0e0 forecast from (select a, regr_slope(v, x) b, regr_intercept(v, x) c, arg_max(v, d) l from (select a, d, v, lag(v) over (partition by a order by d) x from asset) where x is not null group by 1)"))
def ar1_forecast(s, d):
    rows = v.asset(s, d)
    fitted = stats.ar1(rows, "v", "a").join(rows.groupBy("a").agg(F.max_by("v", "d").alias("l")), "a")
    return fitted.select("a", rnd(learning.ar1_path(F.col("slope"), F.col("intercept"), F.col("l"), 5), 5).alias("forecast"))


@register("ks_uniform", "select round(max(greatest(k / n - f, f - (k - 1) / n)), 6) + 0e0 ks from (select least(greatest(value / 100, 0), 1) f, row_number() over (order by value) k, count(*) over () n from events)")
def ks_uniform(s, d):
    return rounded(stats.ks_uniform(v.table(s, d, "events"), "value", 0.0, 100.0), "ks")


@register("bootstrap_mean")
def bootstrap_mean(s, d):
    return stats.bootstrap(v.ret(s, d), "r", 10000, key=["bank", "d"])


@register("sign_flip")
def sign_flip(s, d):
    e = _forecasts(s, d).select("a", "d", (F.col("v") - F.col("ma")).alias("x"), (F.col("v") - F.col("last")).alias("y"))
    return stats.sign_flip_test(e, "x", "y", 10000, key=["a", "d"])


@register("volatility_regression", oracle("vol", "select d, round(m - (b * v + c), 6) + 0e0 residual, round(q, 6) + 0e0 r2 from vol, (select regr_slope(m, v) b, regr_intercept(m, v) c, regr_r2(m, v) q from vol)"))
def volatility_regression(s, d):
    w = Window.orderBy("d").rowsBetween(-5, 0)
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(w))
    fitted = rows.agg(F.regr_slope("m", "v").alias("b"), F.regr_intercept("m", "v").alias("c"), F.regr_r2("m", "v").alias("q"))
    return rows.join(F.broadcast(fitted)).select("d", rnd(F.col("m") - (F.col("b") * F.col("v") + F.col("c"))).alias("residual"), rnd("q").alias("r2"))


def _predictive(s, d):
    order = Window.orderBy("d")
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(order.rowsBetween(-5, 0)))
    rows = rows.withColumn("signal", F.avg("m").over(order.rowsBetween(-3, -1)))
    return rows.select("d", "v", "signal", *(F.lead("v", h).over(order).alias(f"h{h}") for h in (1, 2, 5, 10)))


_PRED = "pred as (select d, v, avg(m) over (order by d rows between 3 preceding and 1 preceding) signal, lead(v) over (order by d) h1, lead(v, 2) over (order by d) h2, lead(v, 5) over (order by d) h5, lead(v, 10) over (order by d) h10 from vol)"


@register("predictive_correlation", _prefixed("vol", _PRED, "select round(corr(signal, h1), 6) + 0e0 h1, round(corr(signal, h2), 6) + 0e0 h2, round(corr(signal, h5), 6) + 0e0 h5, round(corr(signal, h10), 6) + 0e0 h10 from pred"))
def predictive_correlation(s, d):
    return _predictive(s, d).agg(*(rnd(F.corr("signal", f"h{h}")).alias(f"h{h}") for h in (1, 2, 5, 10)))


@register("hit_rate", _prefixed("vol", _PRED, "select round(avg(case when h1 > v then 1e0 else 0e0 end), 6) + 0e0 rate, count(*) n from pred where h1 is not null and signal >= (select quantile_cont(signal, 0.75) from pred)"))
def hit_rate(s, d):
    rows = _predictive(s, d)
    level = rows.agg(F.percentile("signal", 0.75).alias("p"))
    hits = rows.join(F.broadcast(level)).where("h1 IS NOT NULL AND signal >= p")
    return hits.agg(rnd(F.avg((F.col("h1") > F.col("v")).cast("double"))).alias("rate"), F.count(F.lit(1)).alias("n"))


@register("rolling_backtest", _prefixed("vol", "o as (select d, v, row_number() over (order by d) k from vol)", "select a.d, round(a.v, 6) + 0e0 now, round(coalesce(b.v, (select arg_max(v, k) from o)), 6) + 0e0 later, b.d is null clamped from o a left join o b on b.k = a.k + 4 where a.k > 12"))
def rolling_backtest(s, d):
    order = Window.orderBy("d")
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(order.rowsBetween(-5, 0)))
    rows = rows.select("d", F.col("v").alias("now"), F.lead("v", 4).over(order).alias("ahead"), F.last("v").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("end"), F.row_number().over(order).alias("k"))
    return rounded(rows.where("k > 12").select("d", "now", F.coalesce("ahead", "end").alias("later"), F.col("ahead").isNull().alias("clamped")), "now", "later")


@register("high_vol_label", oracle("vol", "select d, cast(case when f > p then 1 else 0 end as bigint) label from (select d, avg(v) over (order by d rows between 1 following and 3 following) f, (select quantile_cont(v, 0.75) from (select v, row_number() over (order by d) k, count(*) over () n from vol) where k <= 0.8 * n) p from vol) where f is not null"))
def high_vol_label(s, d):
    order = Window.orderBy("d")
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(order.rowsBetween(-5, 0))).withColumn("k", F.row_number().over(order))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    level = rows.join(F.broadcast(n)).where("k <= 0.8 * n").agg(F.percentile("v", 0.75).alias("p"))
    rows = rows.withColumn("f", F.avg("v").over(order.rowsBetween(1, 3))).where("f IS NOT NULL").join(F.broadcast(level))
    return rows.select("d", (F.col("f") > F.col("p")).cast("long").alias("label"))


@register("regime_flags", oracle("vol", "select d, cast(v > quantile_cont(v, 0.5) over w as boolean) high, count(*) over w n from vol window w as (order by d rows between 11 preceding and current row)"))
def regime_flags(s, d):
    order = Window.orderBy("d")
    rows = ts.market(v.ret(s, d)).withColumn("v", F.stddev_pop("m").over(order.rowsBetween(-5, 0)))
    w = order.rowsBetween(-11, 0)
    return rows.select("d", (F.col("v") > F.percentile("v", 0.5).over(w)).alias("high"), F.count(F.lit(1)).over(w).alias("n"))


@register("correlation_table", oracle("asset", "select x.a as a, y.a as b, round(corr(x.v, y.v), 6) + 0e0 c from asset x join asset y using (d) group by 1, 2"))
def correlation_table(s, d):
    x = v.asset(s, d)
    return x.select("d", "a", F.col("v").alias("x")).join(x.select("d", F.col("a").alias("b"), F.col("v").alias("y")), "d").groupBy("a", "b").agg(rnd(correlation("x", "y")).alias("c"))


_CAP = "cap as (select bank, 0.1 * total_assets * (1 + greatest(0, lcr - 100) / 100) * (1 + greatest(0, cet1 - 8) / 4) capacity from bank_state)"
_OFFER = _CAP + ", offer as (select source lender, target borrower, capacity * 0.7 * 0.1 * (1 + 2 * weight) * least(1, b.cet1 / 15) offer from latest join cap on cap.bank = source join bank_state a on a.bank = source and a.lcr >= 100 join bank_state b on b.bank = target and b.cet1 >= 6)"
_ASK = "ask as (select source lender, target borrower, (120 - b.lcr) * b.total_assets * 0.1 / 100 * 1.3 * 0.2 * (1 + weight) * least(1, a.lcr / 150) request from latest join bank_state a on a.bank = source and a.lcr >= 110 join bank_state b on b.bank = target and b.lcr <= 120)"


@register("lending_capacity", _prefixed("bank_state", _CAP, "select bank, round(capacity, 5) + 0e0 capacity from cap"))
def lending_capacity(s, d):
    return con.lending_capacity(v.bank_state(s, d)).select("bank", rnd("capacity", 5).alias("capacity"))


@register("lending_offers", _prefixed("bank_state latest", _OFFER, "select lender, borrower, round(offer, 5) + 0e0 offer from offer"))
def lending_offers(s, d):
    return rounded(con.lending_offers(v.bank_state(s, d), v.latest_exposure(s, d), 0.7), "offer", digits=5)


@register("borrowing_requests", _prefixed("bank_state latest", _ASK, "select lender, borrower, round(request, 5) + 0e0 request from ask"))
def borrowing_requests(s, d):
    return rounded(con.borrowing_requests(v.bank_state(s, d), v.latest_exposure(s, d), 0.7), "request", digits=5)


@register("lending_match", _prefixed("bank_state latest", _OFFER + ", " + _ASK, "select lender, borrower, round(amount, 4) + 0e0 amount from (select lender, borrower, greatest(0, least(want, cash - coalesce(sum(want) over (partition by lender order by borrower rows between unbounded preceding and 1 preceding), 0))) amount from (select o.lender, o.borrower, least(offer, request) want, cash from offer o join ask using (lender, borrower) join bank_state on bank = o.lender)) where amount > 0"))
def lending_match(s, d):
    state, links = v.bank_state(s, d), v.latest_exposure(s, d)
    return rounded(con.matched(con.lending_offers(state, links, 0.7), con.borrowing_requests(state, links, 0.7), state), "amount", digits=4)


_SHOCK = ((1, -2.0, -30.0), (7, -9.0, 0.0), (99, -1.0, -1.0))


@register("shock", oracle("bank_state", "select bank, round(cet1 + coalesce(a, 0), 6) + 0e0 cet1, round(lcr + coalesce(b, 0), 6) + 0e0 lcr from bank_state left join (values (1, -2e0, -30e0), (7, -9e0, 0e0), (99, -1e0, -1e0)) z(k, a, b) on k = bank"))
def shock(s, d):
    out = con.shocked(v.bank_state(s, d), s.createDataFrame(list(_SHOCK), "bank long, d_cet1 double, d_lcr double"))
    return rounded(out.select("bank", "cet1", "lcr"), "cet1", "lcr")


_DEAD = (3, 8, 11)


@register("credit_loss_round", oracle("bank_state latest", "select bank, round(cet1 - loss / (0.35 * total_assets) * 100, 5) + 0e0 cet1, round(cash - 0.1 * loss, 5) + 0e0 cash, round(interbank_assets - loss, 5) + 0e0 interbank_assets from (select b.*, least(coalesce(l, 0), interbank_assets) loss from bank_state b left join (select source, sum(weight * 0.4) l from latest where target in (3, 8, 11) group by 1) on source = bank)"))
def credit_loss_round(s, d):
    out = con.credit_losses(v.bank_state(s, d), v.latest_exposure(s, d), s.createDataFrame([(k,) for k in _DEAD], "bank long"))
    return rounded(out.select("bank", "cet1", "cash", "interbank_assets"), "cet1", "cash", "interbank_assets", digits=5)


@register("fire_sale_round", oracle("bank_state latest", "select bank, round(h, 6) + 0e0 haircut, round(total_assets * (1 - h), 4) + 0e0 total_assets from (select b.*, least(0.15, coalesce(l, 0) * 0.02 * (1 + 2 * 0.5 / 24)) h from bank_state b left join (select source, sum(weight) l from latest where target in (3, 8, 11) group by 1) on source = bank)"))
def fire_sale_round(s, d):
    out = con.fire_sale(v.bank_state(s, d), v.latest_exposure(s, d), s.createDataFrame([(k,) for k in _DEAD], "bank long"), 25)
    return out.select("bank", rnd("haircut").alias("haircut"), rnd("total_assets", 4).alias("total_assets"))


def _cascade_sql(rounds: int = 6) -> str:
    steps = ["big as (select source, target, weight * 60 weight from latest)", "c0 as (select bank, cet1 - 3 cet1, cash, interbank_assets, total_assets, case when cet1 - 3 < 0 or cash < 0 then 0 end round from bank_state)"]
    for k in range(1, rounds + 1):
        p = f"c{k - 1}"
        steps.append(f"""c{k} as materialized (select bank, cet1, cash, interbank_assets, total_assets, case when round is null and (cet1 < 0 or cash < 0) then {k} else round end round from (
            select bank, cet1 - loss / (0.35 * total_assets) * 100 cet1, cash - 0.1 * loss cash, interbank_assets - loss interbank_assets, total_assets, round from (
            select {p}.*, least(coalesce(l, 0), interbank_assets) loss from {p} left join (select source, sum(weight * 0.4) l from big where target in (select bank from {p} where round = {k - 1}) group by 1) on source = bank)))""")
    return _prefixed("bank_state latest", ", ".join(steps), f'select bank, round, round(cet1, 4) + 0e0 cet1, round is not null defaulted from c{rounds}')


@register("default_cascade", _cascade_sql())
def default_cascade(s, d):
    state = v.bank_state(s, d).withColumn("cet1", F.col("cet1") - 3)
    out = con.cascade(state, v.latest_exposure(s, d).withColumn("weight", F.col("weight") * 60))
    return out.select("bank", "round", rnd("cet1", 4).alias("cet1"), "defaulted")


@register("mean_reversion", oracle("bank_state", "select bank, round(least(greatest(9 + (cet1 - 9) * pow(0.95, 12), 0), 30), 6) + 0e0 cet1, round(least(greatest(120 + (lcr - 120) * pow(0.96, 12), 20), 300), 6) + 0e0 lcr from bank_state"))
def mean_reversion(s, d):
    return v.bank_state(s, d).select("bank", rnd(con.reverting(F.col("cet1"), F.lit(9.0), "cet1", 12)).alias("cet1"), rnd(con.reverting(F.col("lcr"), F.lit(120.0), "lcr", 12)).alias("lcr"))


@register("monte_carlo")
def monte_carlo(s, d):
    runs = con.simulate(v.bank_state(s, d), v.latest_exposure(s, d), 32, 12, shock=2.0)
    return runs.groupBy("step").agg(F.avg("defaults").alias("defaults"), F.stddev_pop("defaults").alias("sd"), F.avg("mean_cet1").alias("mean_cet1"))


@register("one_at_a_time")
def one_at_a_time(s, d):
    state, loans, out = materialise(v.bank_state(s, d)), materialise(v.latest_exposure(s, d)), None
    for shock_ in (0.0, 2.0, 4.0):
        one = con.simulate(state, loans, 8, 6, shock=shock_).where("step = 5").agg(F.avg("defaults").alias("mean"), F.stddev_pop("defaults").alias("sd"), F.percentile("defaults", 0.1).alias("p10"), F.percentile("defaults", 0.9).alias("p90")).withColumn("shock", F.lit(shock_))
        out = one if out is None else out.unionByName(one)
    return out


@register("solvency_flags", oracle("bank_state", "select bank, coalesce(cet1 >= 4.5, true) solvent, coalesce(lcr >= 100, true) liquid from bank_state"))
def solvency_flags(s, d):
    return v.bank_state(s, d).select("bank", con.solvent(F.col("cet1")).alias("solvent"), con.liquid(F.col("lcr")).alias("liquid"))


@register("region_rollup", "select r_name, n_name, count(*) n, round(sum(c_acctbal), 2) + 0e0 balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def region_rollup(s, d):
    c = v.table(s, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    rows = c.join(F.broadcast(v.table(s, d, "nation")), "n_nationkey").join(F.broadcast(v.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("c_acctbal"), 2).alias("balance"))


@register("json_properties", "select event_type, cast(json_extract_string(props, '$.k') as bigint) // 10 bucket, count(*) n from events group by 1, 2")
def json_properties(s, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return v.table(s, d, "events").groupBy("event_type", F.floor(k / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@register("top_customers", "select o_custkey, round(sum(o_totalprice), 2) + 0e0 total from orders group by 1 order by sum(o_totalprice) desc, o_custkey limit 10")
def top_customers(s, d):
    rows = v.table(s, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    return rows.orderBy(F.desc("t"), "o_custkey").limit(10).select("o_custkey", rnd("t", 2).alias("total"))


@register("override_merge", oracle("bank_state", "select bank, round(coalesce(nullif(a, 0), cet1), 6) + 0e0 cet1 from bank_state left join (values (1, 11e0), (2, 0e0), (5, null)) z(k, a) on k = bank"))
def override_merge(s, d):
    more = s.createDataFrame([(1, 11.0), (2, 0.0), (5, None)], "bank long, a double")
    return v.bank_state(s, d).join(more, "bank", "left").select("bank", rnd(F.coalesce(F.nullif(F.col("a"), F.lit(0.0)), "cet1")).alias("cet1"))


@register("unknown_counterparties", oracle("latest", "select distinct target node from latest where target not in (select source from latest)"))
def unknown_counterparties(s, d):
    e = v.latest_exposure(s, d)
    return e.select(F.col("target").alias("node")).distinct().join(e.select(F.col("source").alias("node")).distinct(), "node", "left_anti")


@register("universe_filter", "select n_nationkey, n_name from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')")
def universe_filter(s, d):
    region = v.table(s, d, "region").where("r_name LIKE 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return v.table(s, d, "nation").join(F.broadcast(region), "n_regionkey", "left_semi").select("n_nationkey", "n_name")


@register("tornado", oracle("bank_state", "select param, round(abs(hi - lo), 5) + 0e0 swing from (select 'cet1' param, avg(capacity) filter (cet1 >= (select median(cet1) from bank_state)) hi, avg(capacity) filter (cet1 < (select median(cet1) from bank_state)) lo from x union all select 'lcr', avg(capacity) filter (lcr >= (select median(lcr) from bank_state)), avg(capacity) filter (lcr < (select median(lcr) from bank_state)) from x)").replace(" select param", f", {_CAP}, x as (select * from bank_state join cap using (bank)) select param", 1))
def tornado(s, d):
    rows = con.lending_capacity(v.bank_state(s, d))
    mid = rows.agg(F.median("cet1").alias("mc"), F.median("lcr").alias("ml"))
    out = rows.join(F.broadcast(mid)).agg(*(F.avg(F.when(test, F.col("capacity"))).alias(n) for n, test in (("c1", F.col("cet1") >= F.col("mc")), ("c0", F.col("cet1") < F.col("mc")), ("l1", F.col("lcr") >= F.col("ml")), ("l0", F.col("lcr") < F.col("ml")))))
    swing = lambda p, a, b: F.struct(F.lit(p).alias("param"), rnd(F.abs(F.col(a) - F.col(b)), 5).alias("swing"))
    return out.select(F.explode(F.array(swing("cet1", "c1", "c0"), swing("lcr", "l1", "l0"))).alias("x")).select("x.*")


@register("node_tensor", oracle("bank_state", "select bank, round(coalesce(x, (select median(x) from (select case when bank % 5 = 0 then null else cet1 end x from bank_state))), 6) + 0e0 cet1, dense_rank() over (order by n_regionkey) - 1 country from (select bank, case when bank % 5 = 0 then null else cet1 end x from bank_state) join nation on n_nationkey = bank"))
def node_tensor(s, d):
    rows = v.bank_state(s, d).select("bank", F.when(F.col("bank") % 5 != 0, F.col("cet1")).alias("x"))
    codes = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("bank"), (F.dense_rank().over(Window.orderBy("n_regionkey")) - 1).cast("long").alias("country"))
    return rows.join(F.broadcast(rows.agg(F.median("x").alias("m")))).join(codes, "bank").select("bank", rnd(F.coalesce("x", "m")).alias("cet1"), "country")


@register("granger_links")
def granger_links(s, d):
    return learning.granger(v.ret(s, d), lags=5).where("weight > 0")


@register("forecast_boosted")
def forecast_boosted(s, d):
    rows = ts.lag_features(v.asset(s, d), "v", "a").where("target IS NOT NULL AND diff5 IS NOT NULL")
    out = learning.fit(learning.chronological(rows, ["d"]), ["lag1", "lag2", "lag3", "mean5", "sd5"], learning.regressor("boosted", "target", maxIter=5, seed=1))
    return stats.regression(out.where("NOT train"), "target", "forecast")


@register("stress_classifier")
def stress_classifier(s, d):
    rows = ts.flat_features(v.price(s, d), "price", 6, "bank").withColumn("d", F.col("d"))
    rows = ts.stress_labels(rows.withColumnRenamed("last", "price"), "price", 3, key="bank")
    out = learning.probability(learning.fit(learning.chronological(rows, ["d"]), ["mean", "sd", "trend"], learning.classifier("high")))
    return stats.auc(out.where("NOT train").withColumn("g", F.lit(0)), "high", "probability", ["g"])


@register("embedding_clusters")
def embedding_clusters(s, d):
    return learning.clusters(v.table(s, d, "embeddings"), "embedding", 10).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
