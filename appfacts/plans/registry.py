"""Registered queries: name -> (Spark job over a data folder, equivalent SQL or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from appfacts.plans.facts import Facts, with_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(facts) -> DataFrame`` under a name, with the SQL that must give the same rows."""

    def wrap(fn: Callable[[Facts], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Facts(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_facts(oracle)
        return fn

    return wrap
