"""Names of the registered queries, their Spark form and their SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the function takes a ``Bindings`` and returns a DataFrame."""

    def register(fn: Callable[..., DataFrame]):
        from tierloom.plans.bindings import Bindings, with_tables

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Bindings(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
