"""Time series: returns, rolling correlation, as-of joins, calendars, recurrences and labels.

All frames are long, (key, time, value); every window partitions by the key, so that no
series is gathered with another. Only operators over one system-wide series order it
whole; such a series has one row a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import clip, correlation


def simple_returns(prices: DataFrame, key: str = "bank", time: str = "d", value: str = "price", out: str = "r") -> DataFrame:
    """value / previous value - 1; the first of each key has none and goes."""
    w = Window.partitionBy(key).orderBy(time)
    return prices.withColumn(out, F.col(value) / F.lag(value).over(w) - 1).where(F.col(out).isNotNull()).drop(value)


def complete_periods(returns: DataFrame, keys: int, time: str = "d") -> DataFrame:
    """Rows of the periods in which all ``keys`` series have a value."""
    full = returns.groupBy(time).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == keys).select(time)
    return returns.join(full, time, "left_semi")


def pairs(returns: DataFrame, key: str = "bank", time: str = "d", value: str = "r") -> DataFrame:
    """(d, s, t, x, y) for each unordered pair of keys with a value at the same time."""
    a = returns.select(F.col(time).alias("d"), F.col(key).alias("s"), F.col(value).alias("x"))
    b = returns.select(F.col(time).alias("d"), F.col(key).alias("t"), F.col(value).alias("y"))
    return a.join(b, "d").where("s < t")


def rolling_correlation(paired: DataFrame, window: int, inclusive: bool = False) -> DataFrame:
    """(d, s, t, c) once ``window`` rows stand before d, or up to d where ``inclusive``."""
    frame = (-(window - 1), 0) if inclusive else (-window, -1)
    w = Window.partitionBy("s", "t").orderBy("d").rowsBetween(*frame)
    return paired.select("d", "s", "t", correlation("x", "y", w).alias("c"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == window).drop("n")


def latest_correlation(returns: DataFrame, window: int, key: str = "bank", time: str = "d", value: str = "r") -> DataFrame:
    """(s, t, c) over the last ``window`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    last = returns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= window).drop("_k")
    return pairs(last, key, time, value).groupBy("s", "t").agg(correlation("x", "y").alias("c"))


def market(returns: DataFrame, time: str = "d", value: str = "r") -> DataFrame:
    """(d, m): mean over all keys, by period."""
    return returns.groupBy(F.col(time).alias("d")).agg(F.avg(value).alias("m"))


def node_features(returns: DataFrame, window: int, periods: int = 12, short: int = 6) -> DataFrame:
    """Volatility, mean return, log growth, beta and momentum of each bank over the rows before d.

    Beta is a sample covariance over a population variance; 1 where that variance is nil.
    """
    w = Window.partitionBy("bank").orderBy("d").rowsBetween(-window, -1)
    near = Window.partitionBy("bank").orderBy("d").rowsBetween(-short, -1)
    rows = returns.join(market(returns), "d")
    growth = F.exp(F.sum(F.log1p("r")).over(w))
    spread = F.var_pop("m").over(w)
    return rows.select(
        "d", "bank", F.count(F.lit(1)).over(w).alias("n"),
        (F.stddev_pop("r").over(w) * periods**0.5).alias("vol"),
        (F.avg("r").over(w) * periods).alias("mean"),
        F.log(F.greatest(growth, F.lit(0.01))).alias("growth"),
        F.when(spread <= 1e-10, F.lit(1.0)).otherwise(F.covar_samp("r", "m").over(w) / spread).alias("beta"),
        F.sum("r").over(near).alias("momentum"),
    ).where(F.col("n") == window).drop("n")


def as_of_table(times: DataFrame, table: DataFrame, time: str = "t", date: str = "d") -> DataFrame:
    """For each time, all rows of the one latest date at or before it, the date chosen for the whole table.

    Only distinct dates are matched; the table's rows then join on equality.
    """
    dates = table.select(date).distinct()
    best = times.select(time).distinct().join(dates, F.col(date) <= F.col(time)).groupBy(time).agg(F.max(date).alias(date))
    return best.join(table, date)


def as_of_key(times: DataFrame, table: DataFrame, key: str, time: str = "t", date: str = "d") -> DataFrame:
    """For each (key, time) the latest row of its key at or before it; null columns where none is.

    A union of both sides and a window per key, so that it is one shuffle and no range join.
    """
    own = [c for c in table.columns if c not in (key, date)]
    a = times.select(key, F.col(time).alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast(table.select(F.struct(date, *own)).schema[0].dataType).alias("_row"))
    b = table.select(key, F.col(date).alias("_at"), F.lit(0).alias("_ask"), F.struct(date, *own).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b).withColumn("_last", F.last("_row", ignorenulls=True).over(w)).where("_ask = 1")
    return rows.select(key, F.col("_at").alias(time), *(F.col(f"_last.{c}").alias(c) for c in (date, *own)))


def calendar(df: DataFrame, date: str = "d", every: str = "1 day") -> DataFrame:
    """One row a step from the first to the last date."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(F.explode(F.expr(f"sequence(a, b, interval {every})")).alias(date))


def forward_fill(df: DataFrame, key: str, date: str, value: str, every: str = "1 day") -> DataFrame:
    """A value at every step between each key's first and last date, carried forward."""
    steps = df.groupBy(key).agg(F.min(date).alias("_from"), F.max(date).alias("_upto")).select(key, F.explode(F.expr(f"sequence(_from, _upto, interval {every})")).alias(date))
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(df.select(key, date, value), [key, date], "left").withColumn(value, F.last(value, ignorenulls=True).over(w))


def limited_fill(df: DataFrame, key: str, date: str, value: str, limit: int) -> DataFrame:
    """Nulls take the last value of at most ``limit`` rows before."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(-limit, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def align_union(tables: dict[str, DataFrame], date: str = "d", value: str = "v") -> DataFrame:
    """(date, name, value): each series on the union of all dates, carried forward, null before its first."""
    dates = None
    for df in tables.values():
        dates = df.select(date) if dates is None else dates.unionByName(df.select(date))
    dates = dates.distinct()
    w = Window.partitionBy("name").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = None
    for name, df in tables.items():
        one = dates.join(df.select(date, F.col(value).alias("v")), date, "left").select(date, F.lit(name).alias("name"), "v")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("v", F.last("v", ignorenulls=True).over(w))


def align_intersection(tables: dict[str, DataFrame], date: str = "d", value: str = "v") -> DataFrame:
    """Like ``align_union``, from the latest first date to the earliest last one."""
    ends = None
    for df in tables.values():
        one = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
        ends = one if ends is None else ends.unionByName(one)
    ends = ends.agg(F.max("a").alias("a"), F.min("b").alias("b"))
    return align_union(tables, date, value).join(F.broadcast(ends), F.col(date).between(F.col("a"), F.col("b"))).drop("a", "b")


def interval_join(df: DataFrame, intervals: DataFrame, date: str = "d") -> DataFrame:
    """Each row with every closed interval (name, start_d, end_d) that holds its date."""
    return df.join(F.broadcast(intervals), F.col(date).between(F.col("start_d"), F.col("end_d")))


def change_z(df: DataFrame, value: str, window: int, order: str = "d", key: str | None = None) -> DataFrame:
    """``delta`` against the row before (first 0), its ``z`` against the ``window`` deltas before, and ``alert`` where \\|z\\| > 2."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    w, past = by.orderBy(order), by.orderBy(order).rowsBetween(-window, -1)
    out = df.withColumn("delta", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0))).withColumn("_k", F.row_number().over(w))
    out = out.withColumn("_m", F.avg("delta").over(past)).withColumn("_s", F.stddev_pop("delta").over(past))
    z = F.when((F.col("_k") > window) & (F.col("_s") > 1e-10), (F.col("delta") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return out.withColumn("z", z).withColumn("alert", F.abs(F.col("z")) > 2).drop("_k", "_m", "_s")


def cusum(df: DataFrame, value: str, threshold: float, key: str, order: str = "d") -> DataFrame:
    """(key, breaks): indexes at which a one-sided sum of z-scores passes the threshold; both sums then restart."""
    base = df.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.array_sort(F.collect_list(F.struct(order, value))).alias("xs"))
    step = (
        "aggregate(sequence(1, size(xs) - 1), struct(0.0D AS up, 0.0D AS down, cast(array() AS array<int>) AS hits), (a, i) -> "
        f"CASE WHEN greatest(0.0D, a.up + (xs[i].{value} - m) / sd) > {threshold}D OR greatest(0.0D, a.down - (xs[i].{value} - m) / sd) > {threshold}D "
        "THEN struct(0.0D AS up, 0.0D AS down, concat(a.hits, array(i)) AS hits) "
        f"ELSE struct(greatest(0.0D, a.up + (xs[i].{value} - m) / sd) AS up, greatest(0.0D, a.down - (xs[i].{value} - m) / sd) AS down, a.hits AS hits) END, a -> a.hits)"
    )
    return base.select(key, F.expr(f"CASE WHEN size(xs) > 1 AND sd >= 1e-10 THEN {step} ELSE cast(array() AS array<int>) END").alias("breaks"))


def binary_segmentation(df: DataFrame, value: str, key: str, order: str = "d", least: int = 20, most: int = 10) -> DataFrame:
    """(key, at, gain): greedy splits of least squared error, each gaining at least ln(n) times the variance."""
    import numpy as np
    import pandas as pd

    def split(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values(order)[value].to_numpy(dtype=float)
        n = len(x)
        s, q = np.concatenate([[0], x.cumsum()]), np.concatenate([[0], (x * x).cumsum()])
        sse = lambda a, b: (q[b] - q[a]) - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)
        penalty, parts, out = np.log(max(n, 2)) * x.var(), [(0, n)], []
        while len(out) < most:
            best = (0.0, -1, None)
            for a, b in parts:
                if b - a >= 2 * least:
                    at = np.arange(a + least, b - least + 1)
                    gain = sse(a, b) - sse(np.full_like(at, a), at) - sse(at, np.full_like(at, b))
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(at[k]), (a, b))
            if best[2] is None or best[0] < penalty:
                break
            a, b = best[2]
            parts[parts.index((a, b)) : parts.index((a, b)) + 1] = [(a, best[1]), (best[1], b)]
            out.append((group[key].iloc[0], best[1], best[0]))
        return pd.DataFrame(out, columns=[key, "at", "gain"])

    kind = dict(df.dtypes)[key]
    return df.select(key, order, value).groupBy(key).applyInPandas(split, f"{key} {kind}, at long, gain double")


def lag_features(df: DataFrame, value: str, key: str, order: str = "d") -> DataFrame:
    """Lags 1 to 3, rolling mean and sample deviation over 5 rows, difference over 5, and the next value; the first three rows go."""
    w = Window.partitionBy(key).orderBy(order)
    near = w.rowsBetween(-4, 0)
    out = df.select(
        key, order, value, F.row_number().over(w).alias("_k"), *(F.lag(value, k).over(w).alias(f"lag{k}") for k in (1, 2, 3)),
        F.avg(value).over(near).alias("mean5"), F.coalesce(F.stddev_samp(value).over(near), F.lit(0.0)).alias("sd5"),
        (F.col(value) - F.lag(value, 5).over(w)).alias("diff5"), F.lead(value).over(w).alias("target"),
    )
    return out.where("_k > 3").drop("_k")


def future_mean(df: DataFrame, value: str, horizon: int, order: str = "d", key: str | None = None) -> DataFrame:
    """``future``: mean of the next ``horizon`` rows."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    return df.withColumn("future", F.avg(value).over(by.orderBy(order).rowsBetween(1, horizon)))


def stress_labels(df: DataFrame, value: str, horizon: int, times: float = 1.0, order: str = "d", key: str | None = None) -> DataFrame:
    """``drop``, ``rise`` beyond ``times`` deviations within the horizon, and ``high``: future mean above the 75th percentile of the first 80 %; the tail has none."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    w, nxt = by.orderBy(order), by.orderBy(order).rowsBetween(1, horizon)
    out = df.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_sd", F.stddev_pop(value).over(by))
    out = out.withColumns({"_lo": F.min(value).over(nxt), "_hi": F.max(value).over(nxt), "_mean": F.avg(value).over(nxt)})
    early = F.when(F.col("_k") <= F.floor(F.col("_n") * 0.8), F.col(value))
    out = out.withColumn("_p", F.percentile(early, 0.75).over(by))
    tail = F.col("_k") > F.col("_n") - horizon
    flag = lambda c: F.when(tail | ~c, 0).otherwise(1).cast("long")
    return out.withColumns({
        "drop": flag(F.col(value) - F.col("_lo") > times * F.col("_sd")),
        "rise": flag(F.col("_hi") - F.col(value) > times * F.col("_sd")),
        "high": flag(F.col("_mean") > F.col("_p")),
    }).drop("_k", "_n", "_sd", "_lo", "_hi", "_mean", "_p")


def sequences(df: DataFrame, values: list[str], length: int, order: str = "d", key: str | None = None) -> DataFrame:
    """``window``: array of structs of the ``length`` rows before, where there are so many."""
    by = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    w = by.orderBy(order).rowsBetween(-length, -1)
    return df.withColumn("window", F.collect_list(F.struct(*values)).over(w)).where(F.size("window") == length)


def drawdown(df: DataFrame, value: str, key: str, order: str = "d") -> DataFrame:
    """``drawdown``: value over its running maximum, less 1."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drawdown", F.col(value) / F.max(value).over(w) - 1)


def flat_features(df: DataFrame, value: str, length: int, key: str, order: str = "d") -> DataFrame:
    """Last, mean, population deviation and trend of the ``length`` rows up to each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)
    first = F.first(value).over(w)
    return df.select(
        key, order, F.col(value).alias("last"), F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("sd"),
        (F.col(value) - first).alias("trend"), F.count(F.lit(1)).over(w).alias("n"),
    ).where(F.col("n") == length).drop("n")


def walk_forward(n: int, folds: int, least: int, size: int, gap: int) -> list[tuple[int, int, int, int]]:
    """(fold, end of training, start and end of test): training expands, the test has a fixed size; ValueError where nothing fits."""
    room = n - least - gap - size
    if room <= 0:
        raise ValueError("too few rows for a fold")
    step = max(1, room // folds)
    out = []
    for k in range(folds):
        end = least + k * step
        if end + gap + size > n:
            break
        out.append((k, end, end + gap, end + gap + size))
    return out


def rate_of(amount: Column, rate_from: Column, rate_to: Column) -> Column:
    """An amount in one currency in another, through rates per unit of the base currency."""
    return amount / rate_from * rate_to


def sentiment(ciss: Column, funding: Column) -> Column:
    return clip(1 - ciss, 0.0, 1.0) * clip(1 - funding, 0.0, 1.0)


def momentum(rows: DataFrame, value: str, order: str, window: int) -> DataFrame:
    """``rows`` with ``z``: the value against mean and spread of the ``window`` rows before it; 0 where there are fewer, where they are flat, and throughout a series that is too short."""
    w = Window.orderBy(order).rowsBetween(-window, -1)
    mean, spread, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    long = rows.count() > window
    return rows.withColumn("z", F.when(F.lit(long) & (n == window) & (spread > 0), (F.col(value) - mean) / spread).otherwise(0.0))


def noise_edge(rows: int, columns: int):
    """The largest eigenvalue that a correlation matrix of pure noise has: (1 + sqrt(columns / rows))^2."""
    return F.lit((1 + (columns / rows) ** 0.5) ** 2)
