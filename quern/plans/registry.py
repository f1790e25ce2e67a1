"""Where query modules put their queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern import session
from quern.plans import dialect
from quern.sources.tables import TABLES, register

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its own name."""

    def put(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(session.apply(spark), sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return put


def same(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose SQL both engines read; oracle where the twin has to differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session.apply(spark)
        register(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", sql)])
        return dialect.run(spark, sql)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or sql
