"""User functions: registered once, called by name from SQL. Batches of Arrow columns, never single rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str | T.DataType, deterministic: bool = True) -> None:
    """function takes and returns pandas Series. A function that is not deterministic is called once for each use."""
    made = F.pandas_udf(function, returns)
    spark.udf.register(name, made if deterministic else made.asNondeterministic())


def register_aggregate(spark: SparkSession, name: str, function: Callable, returns: str | T.DataType) -> None:
    """function takes Series of a group and returns one value; also usable over windows."""
    spark.udf.register(name, F.pandas_udf(function, returns))


def register_sql(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A function whose body is one SQL expression: Catalyst inlines it, so it costs nothing over writing it out."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def register_table_sql(spark: SparkSession, name: str, arguments: str, columns: str, query: str) -> None:
    """A table function whose body is one query."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {query}")


def register_table(spark: SparkSession, name: str, generator: type, returns: str) -> None:
    """A Python table function: a class whose eval() yields rows."""
    spark.udtf.register(name, F.udtf(generator, returnType=returns))
