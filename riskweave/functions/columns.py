"""Column helpers used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def rounded(df, *names: str, digits: int = 6):
    """``df`` with the named columns rounded."""
    return df.withColumns({n: rnd(n, digits) for n in names})


def correlation(x: str, y: str, over=None) -> Column:
    """Pearson's correlation; null where a side is flat, for which ``corr`` divides by zero. Rows must hold both sides."""
    at = lambda c: c if over is None else c.over(over)
    spread = at(F.stddev_pop(x)) * at(F.stddev_pop(y))
    return F.when(spread > 0, at(F.covar_pop(x, y)) / spread)
