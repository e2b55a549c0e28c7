"""Exchange rates: units of a currency for one unit of the base, by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = "EUR"


def daily(rates: DataFrame) -> DataFrame:
    """(ccy, d, rate) of every day from a currency's first observation to its last, each day with the last rate seen."""
    days = rates.groupBy("ccy").agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d"))
    seen = Window.partitionBy("ccy").orderBy("d")
    return days.join(rates, ["ccy", "d"], "left").select("ccy", "d", F.last("rate", ignorenulls=True).over(seen).alias("rate"))


def converted(amounts: DataFrame, rates: DataFrame, amount: Column, strict: bool = False) -> DataFrame:
    """``amounts`` (src, dst, d and others) with ``value``: ``amount`` of src in units of dst, by way of the base.

    The same currency on both sides needs no rate. A day outside a currency's ``rates`` gives null, or an error if ``strict``.
    """
    days = daily(rates)
    out = amounts
    for side in ("src", "dst"):
        out = out.join(days.toDF(side, "d", f"_{side}"), [side, "d"], "left").withColumn(f"_{side}", F.when(F.col(side) == BASE, 1.0).otherwise(F.col(f"_{side}")))
    value = F.when(F.col("src") == F.col("dst"), amount).otherwise(amount / F.col("_src") * F.col("_dst"))
    if strict:
        value = F.coalesce(value, F.when(amount.isNotNull(), F.raise_error(F.concat(F.lit("no rate on "), F.col("d").cast("string"))).cast("double")))
    return out.withColumn("value", value).drop("_src", "_dst")


def save(rates: DataFrame, path: str, at: Column | None = None) -> None:
    """Write ``rates`` to a cache, stamped with the time."""
    rates.withColumn("cached_at", F.current_timestamp() if at is None else at).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """What the cache holds that is less than a day old; rows that can't be read are left out."""
    rows = spark.read.schema("ccy string, d date, rate double, cached_at timestamp").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("cached_at") > (F.current_timestamp() if now is None else now) - F.expr("interval 1 day")).drop("cached_at")


def missing(wanted: DataFrame, loaded: DataFrame) -> DataFrame:
    """The currencies in ``wanted`` (ccy), the base aside, that ``loaded`` has no rate of."""
    return wanted.where(F.col("ccy") != BASE).select("ccy").distinct().join(loaded, "ccy", "left_anti")
