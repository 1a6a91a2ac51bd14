"""How a query is registered: a function of the domain tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

from ..sources.bindings import domain_table, with_domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(t), where t(name) is a domain table, or f(spark, sf_dir)."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if len(signature(f).parameters) == 2:
                return f(spark, sf_dir)
            return f(lambda table: domain_table(spark, sf_dir, table))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_domain(sql)
        return f

    return register
