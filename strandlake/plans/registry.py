"""The registered queries, each beside its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans.fixtures import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The queries as functions of their inputs, so that several may share views made once.
PLANS: dict[str, Callable[[Inputs], DataFrame]] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Register a function of Inputs under its name, with its oracle."""

    def add(f: Callable[[Inputs], DataFrame]):
        PLANS[f.__name__] = f
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, recursive)
        return f

    return add
