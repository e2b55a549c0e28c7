"""Registry of the named queries: each has a Spark form and, where SQL can say it, a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator that adds a query under ``name``, with its SQL form if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling correlation networks and their spectra: one row a month."""
    _load()
    return _QUERIES["spectrum"](spark, sf_dir)


def _load() -> None:
    """Import the modules that register queries."""
    from riskweave.plans import designs, graphs, models, more, scores, series, streams, structures  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
