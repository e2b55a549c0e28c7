"""Domain views over the star schema: who is a bank, what is a price, who owes whom.

Nations play the banks. ``SQL`` says the same views for DuckDB; ``oracle`` puts those that
a query needs before its body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import clip

#: Rows before a date that a rolling window holds.
WINDOW = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(c):
    return F.date_trunc("month", c).cast("date")


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bank, d, price): mean order value of a nation's customers by month."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("bank"))
    return orders.join(customer, "o_custkey").groupBy("bank", month(F.col("o_orderdate")).alias("d")).agg(F.avg("o_totalprice").alias("price"))


def ret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bank, d, r): change of the price against the month before."""
    w = Window.partitionBy("bank").orderBy("d")
    return price(spark, sf_dir).select("bank", "d", (F.col("price") / F.lag("price").over(w) - 1).alias("r")).where("r IS NOT NULL")


def exposure(spark: SparkSession, sf_dir: str, quarters: DataFrame | None = None) -> DataFrame:
    """(d, source, target, weight): net line value from supplier nations to customer nations by quarter; of all, or of the few in ``quarters`` (d).

    Lines of other quarters go before any join, and orders find their nation before lines are joined, so that lines are shuffled once.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.date_trunc("quarter", "l_shipdate").cast("date").alias("d"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    if quarters is not None:
        line = line.join(F.broadcast(quarters), "d", "left_semi")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("target"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("source"))
    buyer = orders.join(customer, "c_custkey").select("l_orderkey", "target")
    rows = line.join(supplier, "l_suppkey").join(buyer, "l_orderkey").where("source != target")
    return rows.groupBy("d", "source", "target").agg(F.sum("v").alias("weight"))


def latest_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, weight) of the last whole quarter of the data, in millions: the one before that of the last shipment."""
    last = table(spark, sf_dir, "lineitem").agg(F.add_months(F.date_trunc("quarter", F.max("l_shipdate")).cast("date"), -3).alias("d"))
    return exposure(spark, sf_dir, last).select("source", "target", (F.col("weight") / 1e6).alias("weight"))


def bank_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation: ratios as clipped linear forms of balances, size from suppliers' and customers' numbers."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("bank")).agg(F.avg("s_acctbal").alias("sb"), F.count(F.lit(1)).alias("ns"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("bank")).agg(F.avg("c_acctbal").alias("cb"), F.count(F.lit(1)).alias("nc"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("bank"))
    sb, cb, size = F.coalesce("sb", F.lit(0.0)), F.coalesce("cb", F.lit(0.0)), F.coalesce("nc", F.lit(0)) + F.coalesce("ns", F.lit(0)) + 1
    return n.join(s, "bank", "left").join(c, "bank", "left").select(
        "bank",
        clip(3 + sb / 500, 0.0, 30.0).alias("cet1"),
        clip(20 + cb / 40, 20.0, 300.0).alias("lcr"),
        clip(60 + cb / 80, 30.0, 250.0).alias("nsfr"),
        (size * 1.0).alias("total_assets"),
        (size * 0.1).alias("cash"),
        (size * 0.15).alias("interbank_assets"),
        (size * 0.14).alias("interbank_liabilities"),
    )


def system_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(d, ciss, funding) by day, from the share of errors and the mean value of events."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("ciss"), F.avg("value").alias("v"))
    return e.select("d", "ciss", clip(F.col("v") / 200, 0.0, 1.0).alias("funding"))


def asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, d, v): mean value of each event type by day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("a"), F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))


#: Closed intervals of named crises, re-dated into the years of the data.
CRISES = (
    ("first", "1995-06-01", "1995-12-31"),
    ("second", "1997-07-01", "1998-01-31"),
    ("third", "1998-08-01", "1998-10-31"),
    ("fourth", "2000-03-01", "2001-03-31"),
)


def crisis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CRISES), "name string, start string, end string").select("name", F.to_date("start").alias("start_d"), F.to_date("end").alias("end_d"))


SQL = {
    "price": (
        (),
        "select cast(c_nationkey as bigint) bank, cast(date_trunc('month', o_orderdate) as date) d, avg(o_totalprice) price from orders join customer on o_custkey = c_custkey group by 1, 2",
    ),
    "ret0": (("price",), "select bank, d, price / lag(price) over (partition by bank order by d) - 1 r from price"),
    "ret": (("ret0",), "select bank, d, r from ret0 where r is not null"),
    "exposure": (
        (),
        """select cast(date_trunc('quarter', l_shipdate) as date) d, cast(s_nationkey as bigint) source, cast(c_nationkey as bigint) target, sum(l_extendedprice * (1 - l_discount)) weight
        from lineitem join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where s_nationkey <> c_nationkey group by 1, 2, 3""",
    ),
    "latest": (("exposure",), "select source, target, weight / 1e6 weight from exposure where d = (select cast(date_trunc('quarter', max(l_shipdate)) - interval 3 month as date) from lineitem)"),
    "bank_state": (
        (),
        """select cast(n_nationkey as bigint) bank, least(greatest(3 + coalesce(sb, 0) / 500, 0), 30) cet1, least(greatest(20 + coalesce(cb, 0) / 40, 20), 300) lcr, least(greatest(60 + coalesce(cb, 0) / 80, 30), 250) nsfr,
        (coalesce(nc, 0) + coalesce(ns, 0) + 1) * 1.0e0 total_assets, (coalesce(nc, 0) + coalesce(ns, 0) + 1) * 0.1e0 cash, (coalesce(nc, 0) + coalesce(ns, 0) + 1) * 0.15e0 interbank_assets, (coalesce(nc, 0) + coalesce(ns, 0) + 1) * 0.14e0 interbank_liabilities
        from nation left join (select s_nationkey, avg(s_acctbal) sb, count(*) ns from supplier group by 1) on s_nationkey = n_nationkey left join (select c_nationkey, avg(c_acctbal) cb, count(*) nc from customer group by 1) on c_nationkey = n_nationkey""",
    ),
    "system_day": (
        (),
        "select d, ciss, least(greatest(v / 200, 0), 1) funding from (select cast(ts as date) d, avg(case when event_type = 'error' then 1.0e0 else 0.0e0 end) ciss, avg(value) v from events group by 1)",
    ),
    "asset": ((), "select event_type a, cast(ts as date) d, avg(value) v from events group by 1, 2"),
    "crisis": (
        (),
        "select * from (values " + ", ".join(f"('{n}', date '{a}', date '{b}')" for n, a, b in CRISES) + ") x(name, start_d, end_d)",
    ),
    "pair": (("ret",), "select a.d, a.bank s, b.bank t, a.r x, b.r y from ret a join ret b on a.d = b.d and a.bank < b.bank"),
    "edge": (
        ("pair",),
        f"""select d, s, t, c from (select d, s, t, corr(x, y) over f c, count(*) over f n from pair
        window f as (partition by s, t order by d rows between {WINDOW} preceding and 1 preceding)) where n = {WINDOW} and c >= 0.3""",
    ),
    "twin": (("edge",), "select d, s, t, c from edge union all select d, t s, s t, c from edge"),
    "degree": (("twin",), "select d, s node, count(*) k, sum(c) deg from twin group by 1, 2"),
    "market": (("ret",), "select d, avg(r) m from ret group by 1"),
    "vol": (("market",), "select d, m, stddev_pop(m) over (order by d rows between 5 preceding and current row) v from market"),
}


def oracle(views: str, body: str) -> str:
    """SQL for DuckDB: the named views, and those they rest on, before ``body``."""
    out: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in out:
            for x in SQL[name][0]:
                need(x)
            out[name] = SQL[name][1]

    for name in views.split():
        need(name)
    return ("with " + ", ".join(f"{n} as ({s})" for n, s in out.items()) + " " if out else "") + body
