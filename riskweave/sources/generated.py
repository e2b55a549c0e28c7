"""Supervisory and market sources: scanned from Parquet where they exist, generated by rule where they don't.

A generated source is a calendar, crossed with the banks (a small dimension), and one expression a measure:
a level, a trend by year, a factor for crises, and noise that is a function of day and bank
alone, so that every engine, task and retry makes the same rows. The expressions are plain SQL, which is also how
the queries say them to DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "1995-01-01", "2001-12-31"
#: Day 0 of the trends, in days since 1970.
ORIGIN = 9131


def noise(k: int) -> str:
    """About standard normal: three evenly spread remainders, of mean 0 and variance 1 together."""
    parts = ((7919 + 2 * k, 104729 + k, 10007), (6151 + 4 * k, 3571 + 7 * k, 9973), (8087 + 6 * k, 7 + 13 * k, 9967))
    return "((" + " + ".join(f"((days * {a} + bank * {b} + {31 * k}) % {m}) / {m}e0" for a, b, m in parts) + " - 1.5e0) * 2e0)"


def stressed(second: float, third: float, fourth: float) -> str:
    """The factor of a day: one for each of the later crises, else 1."""
    return f"(case when d between date '1997-07-01' and date '1998-01-31' then {second}e0 when d between date '1998-08-01' and date '1998-10-31' then {third}e0 when d between date '2000-03-01' and date '2001-03-31' then {fourth}e0 else 1e0 end)"


_YEARS = f"((days - {ORIGIN}) / 365.25e0)"
_GAP = "(case when extract(year from d) = 1998 then 4e0 when extract(year from d) in (2000, 2001) then -3e0 else 0e0 end)"
#: For each source its interval, whether it has a row for each bank, and its measures.
SOURCES = {
    "transparency": ("3 months", True, {"cet1": f"12 + bank % 5 + 0.5e0 * {_YEARS} + 0.3e0 * {noise(1)}", "tier1_leverage": f"5 + (bank % 3) * 0.5e0 + 0.2e0 * {_YEARS} + 0.15e0 * {noise(2)}", "total_assets": f"(500 + 40 * bank) * (1 + 0.03e0 * {_YEARS})", "risk_weighted_assets": f"(500 + 40 * bank) * (1 + 0.03e0 * {_YEARS}) * 0.35e0"}),
    "liquidity": ("6 months", True, {"lcr": f"140 + bank % 20 + 5e0 * {_YEARS} + 5e0 * {noise(3)}", "nsfr": f"115 + bank % 10 + 2e0 * {_YEARS} + 3e0 * {noise(4)}", "liquid_assets": "100e0 + 5 * bank", "net_cash_outflows": f"(100e0 + 5 * bank) / (140 + bank % 20 + 5e0 * {_YEARS} + 5e0 * {noise(3)}) * 100"}),
    "gsib": ("1 year", True, {"gsib_score": f"100 + 10 * bank + 5e0 * {_YEARS} + 8e0 * {noise(5)}", "cross_jurisdictional_claims": f"(50 + 6 * bank) * (1 + 0.04e0 * {_YEARS})", "intra_financial_assets": f"(30 + 4 * bank) * (1 + 0.03e0 * {_YEARS})"}),
    "cds": ("1 day", True, {"cds_5yr": f"(60 + 4 * bank) * {stressed(5, 3, 4)} * (1 + 0.05e0 * {noise(6)})"}),
    "srisk": ("7 days", True, {"srisk": f"(5 + bank) * {stressed(2.5, 1.8, 2.0)} * (1 + 0.1e0 * {noise(7)})"}),
    "funding_stress": ("1 day", False, {"libor_ois": f"0.15e0 * {stressed(8, 4, 5)} * (1 + 0.1e0 * {noise(8)})", "gc_repo_tbill": f"0.1e0 * {stressed(4, 2.5, 3)} * (1 + 0.1e0 * {noise(9)})"}),
    "credit_gap": ("3 months", True, {"credit_to_gdp_gap": f"bank % 7 - 3 + {_GAP} + 0.5e0 * {noise(10)}"}),
    "house_price_gap": ("3 months", True, {"house_price_gap": f"bank % 9 - 4 + 1.5e0 * {_GAP} + 0.8e0 * {noise(11)}"}),
}
#: Sources that have rows on business days only.
BUSINESS = ("cds", "funding_stress")
#: Daily drift and spread of equity prices, and the floor of each step.
DRIFT, SPREAD, FLOOR = 0.0003, 0.02, 0.1


def calendar(spark: SparkSession, start: str, end: str, step: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval {step})")).alias("d"))


def generated(spark: SparkSession, name: str, banks: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """(d, bank, measures) of a source in the closed range; without ``bank`` where the source is of the whole system."""
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}")
    step, by_bank, measures = SOURCES[name]
    days = calendar(spark, start, end, step)
    if name in BUSINESS:
        days = days.where("weekday(d) < 5")
    rows = days.crossJoin(F.broadcast(banks.select("bank"))) if by_bank else days.withColumn("bank", F.lit(0).cast("long"))
    rows = rows.withColumn("days", F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long"))
    return rows.select("d", *(["bank"] if by_bank else []), *(F.expr(f"cast({e} as double)").alias(c) for c, e in measures.items()))


def collected(spark: SparkSession, name: str, banks: DataFrame, start: str = START, end: str = END, path: str | None = None) -> DataFrame:
    """A source in a closed range of dates: scanned from ``path``, filters pushed down, else generated; only the banks given."""
    if path is None:
        return generated(spark, name, banks, start, end)
    rows = spark.read.parquet(path).where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.join(F.broadcast(banks.select("bank")), "bank", "left_semi") if "bank" in rows.columns else rows


def indicator(spark: SparkSession, name: str, banks: DataFrame, start: str = START, end: str = END) -> DataFrame:
    """A gap series by the name of its indicator; an unknown name is an error."""
    if name not in ("credit_gap", "house_price_gap"):
        raise ValueError(f"unknown indicator {name}")
    return generated(spark, name, banks, start, end)


def equity(spark: SparkSession, banks: DataFrame, start: str = START, end: str = "1995-06-30") -> DataFrame:
    """(d, bank, price, volume): a walk of each bank over business days, never below FLOOR. The floor holds at each step, so a bank's days are folded in order."""
    days = calendar(spark, start, end, "1 day").where("weekday(d) < 5")
    rows = days.crossJoin(F.broadcast(banks.select("bank"))).withColumn("days", F.datediff("d", F.lit("1970-01-01").cast("date")).cast("long"))
    rows = rows.select("bank", "d", F.expr(f"{DRIFT}e0 + {SPREAD}e0 * {noise(12)}").alias("r"), F.expr(f"cast(1000000 * (1 + 0.2e0 * abs({noise(13)})) as double)").alias("volume"))
    walk = rows.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct("d", "r", "volume"))).alias("x"))
    start_price = "cast(20 + 3 * bank as double)"
    walk = walk.withColumn("p", F.expr(f"aggregate(x, array({start_price}), (a, y) -> concat(a, array(greatest({FLOOR}e0, element_at(a, -1) * (1 + y.r)))))"))
    return walk.select("bank", F.posexplode("x").alias("k", "y"), "p").select("y.d", "bank", F.expr("p[k + 1]").alias("price"), "y.volume")


def sql(name: str) -> str:
    """The same rows for DuckDB, measures rounded to 6 digits."""
    step, by_bank, measures = SOURCES[name]
    days = f"select cast(unnest(generate_series(date '{START}', date '{END}', interval {step})) as date) d"
    rows = f"select d, {'cast(n_nationkey as bigint)' if by_bank else 'cast(0 as bigint)'} bank, cast(date_diff('day', date '1970-01-01', d) as bigint) as days from ({days}) {'cross join nation' if by_bank else ''}"
    rows += " where isodow(d) < 6" if name in BUSINESS else ""
    return f"select d, {'bank, ' if by_bank else ''}" + ", ".join(f"round(cast({e} as double), 6) + 0e0 {c}" for c, e in measures.items()) + f" from ({rows})"
