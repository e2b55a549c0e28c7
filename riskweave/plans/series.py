"""Queries over time series, risk and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.functions.columns import clip, rnd, rounded
from riskweave.operators import risk, timeseries as ts
from riskweave.plans.catalog import register
from riskweave.sources import views as v
from riskweave.sources.views import oracle

R = "round({}, 6) + 0e0"


def sql(views: str, columns: str, rest: str) -> str:
    """``columns``: plain ones, and ``name=expression`` for rounded ones, parted by `` | ``."""
    out = []
    for c in columns.split(" | "):
        name, _, what = c.partition("=")
        out.append(f"{R.format(what)} as {name}" if what else name)
    return oracle(views, f"select {', '.join(out)} {rest}")


@register("returns", sql("ret", "bank | d | r=r", "from ret"))
def returns(s, d):
    return rounded(ts.simple_returns(v.price(s, d)), "r")


@register("price_drawdown", sql("price", "bank | d | drawdown=price / max(price) over (partition by bank order by d) - 1", "from price"))
def price_drawdown(s, d):
    return rounded(ts.drawdown(v.price(s, d), "price", "bank"), "drawdown").drop("price")


@register("rolling_corr_before", sql("edge", "d | s | t | c=c", "from edge"))
def rolling_corr_before(s, d):
    return rounded(ts.rolling_correlation(ts.pairs(v.ret(s, d)), v.WINDOW).where("c >= 0.3"), "c")


@register("rolling_corr_upto", sql("pair", "d | s | t | c=c", "from (select d, s, t, corr(x, y) over f c, count(*) over f n from pair window f as (partition by s, t order by d rows between 11 preceding and current row)) where n = 12 and abs(c) > 0.5"))
def rolling_corr_upto(s, d):
    return rounded(ts.rolling_correlation(ts.pairs(v.ret(s, d)), 12, inclusive=True).where("abs(c) > 0.5"), "c")


@register("latest_correlation", oracle("ret", "select a.bank s, b.bank t, round(corr(a.r, b.r), 6) + 0e0 c from (select *, row_number() over (partition by bank order by d desc) k from ret) a join (select *, row_number() over (partition by bank order by d desc) k from ret) b on a.d = b.d and a.bank < b.bank where a.k <= 36 and b.k <= 36 group by 1, 2"))
def latest_correlation(s, d):
    return rounded(ts.latest_correlation(v.ret(s, d), 36), "c")


@register("market_return", sql("market", "d | m=m", "from market"))
def market_return(s, d):
    return rounded(ts.market(v.ret(s, d)), "m")


@register("complete_periods", oracle("ret", "select bank, d, round(r, 6) + 0e0 r from ret where d in (select d from ret group by 1 having count(*) = 25)"))
def complete_periods(s, d):
    return rounded(ts.complete_periods(v.ret(s, d), 25), "r")


_FRAME = "window w as (partition by bank order by d rows between 24 preceding and 1 preceding), x as (partition by bank order by d rows between 6 preceding and 1 preceding)"


@register("node_features", oracle("market", f"""select d, bank, round(vol, 6) + 0e0 vol, round(mean, 6) + 0e0 mean, round(growth, 6) + 0e0 growth, round(beta, 6) + 0e0 beta, round(momentum, 6) + 0e0 momentum from (
    select ret.d, bank, count(*) over w n, stddev_pop(r) over w * sqrt(12) vol, avg(r) over w * 12 mean, ln(greatest(exp(sum(ln(1 + r)) over w), 0.01)) growth,
    case when var_pop(m) over w <= 1e-10 then 1 else covar_samp(r, m) over w / var_pop(m) over w end beta, sum(r) over x momentum from ret join market using (d) {_FRAME}) where n = 24"""))
def node_features(s, d):
    return rounded(ts.node_features(v.ret(s, d), v.WINDOW), "vol", "mean", "growth", "beta", "momentum")


@register("asof_table", oracle("price exposure", "select t, d, count(*) edges, round(sum(weight), 2) + 0e0 weight from (select distinct d t from price) join (select distinct d from exposure) e on true join exposure using (d) where d = (select max(d) from exposure x where x.d <= t) group by 1, 2"))
def asof_table(s, d):
    out = ts.as_of_table(v.price(s, d).select(F.col("d").alias("t")), v.exposure(s, d))
    return out.groupBy("t", "d").agg(F.count(F.lit(1)).alias("edges"), rnd(F.sum("weight"), 2).alias("weight"))


@register("asof_per_key", oracle("price exposure", "select e.bank, e.t, p.d, round(ln(p.price), 6) + 0e0 price from (select distinct source bank, d + interval 20 day t0, cast(d + interval 20 day as date) t from exposure) e asof left join price p on e.bank = p.bank and p.d <= e.t"))
def asof_per_key(s, d):
    times = v.exposure(s, d).select(F.col("source").alias("bank"), F.date_add("d", 20).alias("t")).distinct()
    return ts.as_of_key(times, v.price(s, d), "bank").withColumn("price", rnd(F.log("price")))


@register("rate_conversion", oracle("price exposure", """select e.source, e.target, e.t, round(1000 / a.price * b.price, 4) + 0e0 amount from (select distinct source, target, cast(d + interval 20 day as date) t from exposure) e
    asof join price a on e.source = a.bank and a.d <= e.t asof join price b on e.target = b.bank and b.d <= e.t"""))
def rate_conversion(s, d):
    rates = v.price(s, d)
    legs = v.exposure(s, d).select("source", "target", F.date_add("d", 20).alias("t")).distinct()
    one = lambda k: ts.as_of_key(legs.select(F.col(k).alias("bank"), "t").distinct(), rates, "bank").select(F.col("bank").alias(k), "t", F.col("price").alias(f"rate_{k}"))
    both = legs.join(one("source"), ["source", "t"]).join(one("target"), ["target", "t"]).where("rate_source IS NOT NULL AND rate_target IS NOT NULL")
    return both.select("source", "target", "t", rnd(ts.rate_of(F.lit(1000.0), F.col("rate_source"), F.col("rate_target")), 4).alias("amount"))


_GAPPY = "(select a, d, v from asset where extract(day from d) % 3 <> 0)"


@register("calendar_fill", oracle("asset", f"""select k.a, k.d, round(last_value(g.v ignore nulls) over (partition by k.a order by k.d), 6) + 0e0 v from
    (select a, cast(unnest(generate_series(min(d), max(d), interval 1 day)) as date) d from {_GAPPY} group by a) k left join {_GAPPY} g on k.a = g.a and k.d = g.d"""))
def calendar_fill(s, d):
    return rounded(ts.forward_fill(v.asset(s, d).where("day(d) % 3 != 0"), "a", "d", "v"), "v")


@register("limited_fill", oracle("asset", "select a, d, round(last_value(case when v < 100 then null else v end ignore nulls) over (partition by a order by d rows between 2 preceding and current row), 6) + 0e0 v from asset"))
def limited_fill(s, d):
    gaps = v.asset(s, d).withColumn("v", F.when(F.col("v") >= 100, F.col("v")))
    return rounded(ts.limited_fill(gaps, "a", "d", "v", 2), "v")


def _two(s, d):
    a = v.asset(s, d)
    return {"x": a.where("a = 'click' AND day(d) % 2 = 0").select("d", "v"), "y": a.where("a = 'view' AND day(d) > 4 AND day(d) % 3 = 0").select("d", "v")}


_TWO = "x as (select d, v from asset where a = 'click' and extract(day from d) % 2 = 0), y as (select d, v from asset where a = 'view' and extract(day from d) > 4 and extract(day from d) % 3 = 0), u as (select d from x union select d from y)"
_ALIGNED = "select u.d, 'x' as name, last_value(x.v ignore nulls) over (order by u.d) v from u left join x on u.d = x.d union all select u.d, 'y', last_value(y.v ignore nulls) over (order by u.d) from u left join y on u.d = y.d"


@register("align_union", oracle("asset", "").rstrip() + f", {_TWO} select d, name, round(v, 6) + 0e0 v from ({_ALIGNED})")
def align_union(s, d):
    return rounded(ts.align_union(_two(s, d)), "v")


@register("align_intersection", oracle("asset", "").rstrip() + f", {_TWO} select d, name, round(v, 6) + 0e0 v from ({_ALIGNED}) where d between (select greatest((select min(d) from x), (select min(d) from y))) and (select least((select max(d) from x), (select max(d) from y)))")
def align_intersection(s, d):
    return rounded(ts.align_intersection(_two(s, d)), "v")


@register("crisis_intervals", oracle("ret crisis", "select name, bank, count(*) n, round(avg(r), 6) + 0e0 mean from ret join crisis on d between start_d and end_d group by 1, 2"))
def crisis_intervals(s, d):
    return ts.interval_join(v.ret(s, d), v.crisis(s)).groupBy("name", "bank").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("r")).alias("mean"))


_CHANGE = """select d, m, delta, case when k > 6 and sd > 1e-10 then (delta - mean) / sd else 0 end z from (
    select d, m, delta, row_number() over (order by d) k, avg(delta) over p mean, stddev_pop(delta) over p sd from (select d, m, coalesce(m - lag(m) over (order by d), 0) delta from market)
    window p as (order by d rows between 6 preceding and 1 preceding))"""


@register("change_z", sql("market", "d | delta=delta | z=z | abs(z) > 2 alert", f"from ({_CHANGE})"))
def change_z(s, d):
    return rounded(ts.change_z(ts.market(v.ret(s, d)), "m", 6), "delta", "z").drop("m")


@register("cusum", """with recursive asset as (select event_type a, cast(ts as date) d, avg(value) v from events group by 1, 2), z as (select a, row_number() over (partition by a order by d) - 1 i, (v - avg(v) over (partition by a)) / stddev_pop(v) over (partition by a) z from asset),
    run as (select a, cast(0 as bigint) i, 0e0 up, 0e0 down, false hit from z where i = 0 union all
    select z.a, z.i, case when h then 0 else u end, case when h then 0 else w end, h from (select z.a, z.i, greatest(0, up + z) u, greatest(0, down - z) w, greatest(0, up + z) > 2 or greatest(0, down - z) > 2 h from run join z on run.a = z.a and z.i = run.i + 1) z)
    select a, i as at from run where hit""")
def cusum(s, d):
    return ts.cusum(v.asset(s, d), "v", 2.0, "a").select("a", F.explode("breaks").alias("at")).withColumn("at", F.col("at").cast("long"))


@register("binary_segmentation")
def binary_segmentation(s, d):
    return ts.binary_segmentation(v.price(s, d), "price", "bank", least=10)


@register("lag_features", oracle("asset", """select a, d, round(v, 6) + 0e0 v, round(lag1, 6) + 0e0 lag1, round(lag2, 6) + 0e0 lag2, round(lag3, 6) + 0e0 lag3, round(mean5, 6) + 0e0 mean5, round(sd5, 6) + 0e0 sd5, round(diff5, 6) + 0e0 diff5, round(target, 6) + 0e0 target from (
    select a, d, v, row_number() over w k, lag(v) over w lag1, lag(v, 2) over w lag2, lag(v, 3) over w lag3, avg(v) over n mean5, coalesce(stddev_samp(v) over n, 0) sd5, v - lag(v, 5) over w diff5, lead(v) over w target
    from asset window w as (partition by a order by d), n as (partition by a order by d rows between 4 preceding and current row)) where k > 3"""))
def lag_features(s, d):
    return rounded(ts.lag_features(v.asset(s, d), "v", "a"), "v", "lag1", "lag2", "lag3", "mean5", "sd5", "diff5", "target")


@register("future_mean", sql("market", "d | future=avg(m) over (order by d rows between 1 following and 3 following)", "from market"))
def future_mean(s, d):
    return rounded(ts.future_mean(ts.market(v.ret(s, d)), "m", 3), "future").drop("m")


@register("stress_labels", oracle("price", """select bank, d, cast(case when k > n - 3 or not (price - lo > sd) then 0 else 1 end as bigint) "drop", cast(case when k > n - 3 or not (hi - price > sd) then 0 else 1 end as bigint) rise, cast(case when k > n - 3 or not (mean > p) then 0 else 1 end as bigint) high from (
    select *, quantile_cont(case when k <= floor(n * 0.8) then price end, 0.75) over (partition by bank) p from (
    select bank, d, price, row_number() over w k, count(*) over (partition by bank) n, stddev_pop(price) over (partition by bank) sd, min(price) over f lo, max(price) over f hi, avg(price) over f mean from price
    window w as (partition by bank order by d), f as (partition by bank order by d rows between 1 following and 3 following)))"""))
def stress_labels(s, d):
    return ts.stress_labels(v.price(s, d), "price", 3, key="bank").drop("price")


@register("sequence_windows", oracle("market", "select d, round(a, 6) + 0e0 first, round(b, 6) + 0e0 last, n from (select d, first_value(m) over w a, last_value(m) over w b, count(*) over w n from market window w as (order by d rows between 8 preceding and 1 preceding)) where n = 8"))
def sequence_windows(s, d):
    rows = ts.sequences(ts.market(v.ret(s, d)), ["m"], 8)
    return rows.select("d", rnd(F.col("window")[0]["m"]).alias("first"), rnd(F.col("window")[7]["m"]).alias("last"), F.size("window").cast("long").alias("n"))


@register("flat_features", oracle("asset", "select a, d, round(v, 6) + 0e0 last, round(m, 6) + 0e0 mean, round(s, 6) + 0e0 sd, round(v - f, 6) + 0e0 trend from (select a, d, v, avg(v) over w m, stddev_pop(v) over w s, first_value(v) over w f, count(*) over w n from asset window w as (partition by a order by d rows between 5 preceding and current row)) where n = 6"))
def flat_features(s, d):
    return rounded(ts.flat_features(v.asset(s, d), "v", 6, "a"), "last", "mean", "sd", "trend")


@register("walk_forward_folds", oracle("market", "select k fold, train, test from (select k, 40 + k * greatest(1, (n - 40 - 2 - 6) // 5) train, 40 + k * greatest(1, (n - 40 - 2 - 6) // 5) + 2 test, n from (select count(*) n from market), (select unnest(range(5)) k)) where test + 6 <= n"))
def walk_forward_folds(s, d):
    n = ts.market(v.ret(s, d)).count()
    return s.createDataFrame([(k, a, b) for k, a, b, _ in ts.walk_forward(n, 5, 40, 6, 2)], "fold long, train long, test long")


@register("sentiment", sql("system_day", "d | mood=(1 - ciss) * (1 - funding)", "from system_day"))
def sentiment(s, d):
    return v.system_day(s, d).select("d", rnd(ts.sentiment(F.col("ciss"), F.col("funding"))).alias("mood"))


@register("value_at_risk", oracle("ret", "select bank, round(quantile_cont(r, 0.05), 6) + 0e0 as var from ret group by 1"))
def value_at_risk(s, d):
    return rounded(risk.value_at_risk(v.ret(s, d)), "var")


_RISK = """, lv as (select quantile_cont(m, 0.05) sv, median(m) sm from market), bd as (select greatest(quantile_cont(abs(m - sm), 0.1), 1e-10) sb from market, lv),
    j as (select bank, r, m, m <= sv low, abs(m - sm) <= sb calm from ret join market using (d), lv, bd),
    g as (select bank, quantile_cont(r, 0.05) v, median(r) mid, count(*) filter (low) nl, count(*) filter (calm) nc, quantile_cont(r, 0.05) filter (low) cl, quantile_cont(r, 0.05) filter (calm) cc, avg(r) filter (low) mes from j group by 1),
    k as (select bank, v, case when nl < 3 then v else cl end covar, case when nc < 3 then mid else cc end base, mes from g)"""


@register("risk_table", oracle("market", "").rstrip() + _RISK + " select bank, round(v, 6) + 0e0 as var, round(covar, 6) + 0e0 covar, round(covar - base, 6) + 0e0 delta_covar, round(mes, 6) + 0e0 mes from k")
def risk_table(s, d):
    return rounded(risk.risk_table(v.ret(s, d)), "var", "covar", "delta_covar", "mes")


@register("srisk", oracle("market bank_state", "").rstrip() + _RISK + " select bank, round(greatest(0, 0.08 * total_assets * 0.9 - 0.92 * total_assets * 0.1 * (1 + mes)), 4) + 0e0 srisk from k join bank_state using (bank)")
def srisk(s, d):
    rows = risk.risk_table(v.ret(s, d)).join(v.bank_state(s, d), "bank")
    return rows.select("bank", rnd(risk.srisk(F.col("mes"), F.col("total_assets") * 0.1, F.col("total_assets") * 0.9), 4).alias("srisk"))


@register("bank_metrics", oracle("bank_state", "select round(avg(cet1), 6) + 0e0 mean_cet1, round(min(cet1), 6) + 0e0 min_cet1, count(*) filter (cet1 < 8) stressed, count(*) filter (cet1 < 4.5) insolvent, round(avg(lcr), 6) + 0e0 mean_lcr from bank_state"))
def bank_metrics(s, d):
    return rounded(risk.bank_metrics(v.bank_state(s, d)), "mean_cet1", "min_cet1", "mean_lcr")


@register("volatility_ar", oracle("ret", "select bank, round(regr_slope(r, x), 6) + 0e0 slope, round(regr_intercept(r, x), 6) + 0e0 intercept from (select bank, r, lag(r) over (partition by bank order by d) x from ret) where x is not null group by 1"))
def volatility_ar(s, d):
    from riskweave.operators.stats import ar1

    return rounded(ar1(v.ret(s, d), "r", "bank"), "slope", "intercept")


@register("business_days", "select d from (select cast(unnest(generate_series(date '1998-01-01', date '1998-12-31', interval 1 day)) as date) d) where isodow(d) < 6")
def business_days(s, d):
    days = s.range(1).select(F.explode(F.expr("sequence(DATE'1998-01-01', DATE'1998-12-31', interval 1 day)")).alias("d"))
    return days.where(F.weekday("d") < 5)


@register("calendar_regimes", "select cast(d as date) d, case when strftime(d, '%Y-%m') in ('1998-08', '1998-09') then 0.8 when year(d) in (2000, 2001) then 0.6 else 0.15 end::double level from (select unnest(generate_series(date '1997-01-01', date '2001-12-31', interval 3 month)) d)")
def calendar_regimes(s, d):
    days = s.range(1).select(F.explode(F.expr("sequence(DATE'1997-01-01', DATE'2001-12-31', interval 3 month)")).alias("d"))
    level = F.when(F.date_format("d", "yyyy-MM").isin("1998-08", "1998-09"), 0.8).when(F.year("d").isin(2000, 2001), 0.6).otherwise(0.15)
    return days.select("d", level.alias("level"))


@register("fundamentals", oracle("price", "select bank, round(arg_max(price, d), 4) + 0e0 latest, round(stddev_samp(r) filter (k <= 12) * sqrt(12), 6) + 0e0 vol, case when count(*) >= 13 then round(arg_max(price, d) / max(case when k = 13 then price end) - 1, 6) + 0e0 end as change from (select bank, d, price, price / lag(price) over (partition by bank order by d) - 1 r, row_number() over (partition by bank order by d desc) k from price) group by 1"))
def fundamentals(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("bank")
    rows = v.price(s, d).select("bank", "d", "price", (F.col("price") / F.lag("price").over(w.orderBy("d")) - 1).alias("r"), F.row_number().over(w.orderBy(F.desc("d"))).alias("k"))
    latest = F.max_by("price", "d")
    return rows.groupBy("bank").agg(
        rnd(latest, 4).alias("latest"), rnd(F.stddev_samp(F.when(F.col("k") <= 12, F.col("r"))) * 12**0.5).alias("vol"),
        F.when(F.count(F.lit(1)) >= 13, rnd(latest / F.max(F.when(F.col("k") == 13, F.col("price"))) - 1)).alias("change"),
    )


@register("spread_pivot", oracle("asset", "select round(max(v) filter (a = 'click') - max(v) filter (a = 'view'), 6) + 0e0 spread, round(max(v) filter (a = 'nothing') - max(v) filter (a = 'view'), 6) + 0e0 missing from (select a, arg_max(v, d) v from asset group by 1)"))
def spread_pivot(s, d):
    last = v.asset(s, d).groupBy("a").agg(F.max_by("v", "d").alias("v")).groupBy().pivot("a", ["click", "view", "nothing"]).agg(F.max("v"))
    return last.select(rnd(F.col("click") - F.col("view")).alias("spread"), rnd(F.col("nothing") - F.col("view")).alias("missing"))


@register("system_indicators", sql("system_day", "d | ciss=least(greatest(ciss * 5, 0), 1) | funding=least(1, funding / 2)", "from system_day"))
def system_indicators(s, d):
    return v.system_day(s, d).select("d", rnd(clip(F.col("ciss") * 5, 0.0, 1.0)).alias("ciss"), rnd(F.least(F.lit(1.0), F.col("funding") / 2)).alias("funding"))
