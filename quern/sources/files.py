"""Bulk loading of CSV and JSON into declared schemas: a load is whole or fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that a load takes as booleans.
TRUE_TEXTS, FALSE_TEXTS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def to_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(text.isNull(), None).when(low.isin(*TRUE_TEXTS), True).when(low.isin(*FALSE_TEXTS), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns in declared types. Under ANSI a text that does not fit its type fails the load."""
    return df.select(*[(to_boolean(F.col(f.name)) if isinstance(f.dataType, T.BooleanType) else F.col(f.name).cast(f.dataType)).alias(f.name) for f in schema])


def copy_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, delimiter: str = ",", null: str = "", columns: list[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """COPY ... WITH (FORMAT CSV): columns of the table that the file lacks are null; names of the header are checked.

    With line_breaks, values may hold some; a file is then read by one task, else by as many as it has splits.
    """
    names = columns or schema.fieldNames()
    if header:
        first = spark.read.text(path).filter("length(value) > 0").first()
        found = [c.strip().strip('"').lower() for c in (first[0].split(delimiter) if first else [])]
        unknown = [c for c in found if c not in [n.lower() for n in schema.fieldNames()]]
        if unknown:
            raise ValueError(f"the file has columns that the table lacks: {unknown}")
        names = [next(n for n in schema.fieldNames() if n.lower() == c) for c in found] or names
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, header=header, sep=delimiter, nullValue=null, mode="FAILFAST", enforceSchema=True, escape='"', multiLine=line_breaks)
    return typed(raw.select(*[F.col(n) if n in names else F.lit(None).cast("string").alias(n) for n in schema.fieldNames()]), schema)


def copy_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """COPY ... WITH (FORMAT JSON): an array of objects or one object a line; keys in any case, unknown keys rejected."""
    raw = spark.read.option("primitivesAsString", True).json(path, multiLine=not lines, mode="FAILFAST")
    by_key = {c.lower(): c for c in raw.columns}
    unknown = set(by_key) - {n.lower() for n in schema.fieldNames()}
    if unknown:
        raise ValueError(f"the file has keys that the table lacks: {sorted(unknown)}")
    texts = raw.select(*[(F.col(f"`{by_key[n.lower()]}`") if n.lower() in by_key else F.lit(None)).cast("string").alias(n) for n in schema.fieldNames()])
    return typed(texts, schema)
