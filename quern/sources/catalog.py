"""A small catalogue of versioned tables: Parquet folders beside one JSON file each, on any file system Spark reaches.

A version is a list of folders. A change writes the folders that it needs (an append only its own rows), checks the
constraints on what was written, and then writes a JSON file of the next number, which must not be there yet: readers take
the file of the highest number and so see the state before or after a change, and of two writers one fails. Versions
stay, which is what AS OF reads. Views are kept the same way, as files of their own.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import versions as V


@dataclass
class Entry:
    name: str
    schema: dict
    key: str | None = None
    not_null: list[str] = field(default_factory=list)
    unique: list = field(default_factory=list)  # columns, or lists of columns that are unique together
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    references: dict[str, list[str]] = field(default_factory=dict)
    versions: list[dict] = field(default_factory=list)  # number, micros since the epoch, folders


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    # metadata
    def entry(self, name: str) -> Entry:
        return Entry(**self._load(name, "json", "table"))

    def _load(self, name: str, kind: str, what: str) -> dict:
        number = self._numbers(kind).get(name.lower())
        if number is None:
            raise ValueError(f"no {what} {name}")
        stream = self.fs.open(self._path(f"{name.lower()}.{number:09d}.{kind}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _save(self, name: str, number: int, kind: str, content: dict) -> None:
        new = self._path(f".{uuid.uuid4().hex}")
        out = self.fs.create(new)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        target = self._path(f"{name}.{number:09d}.{kind}")
        if self.fs.exists(target) or not self.fs.rename(new, target):
            self.fs.delete(new, False)
            raise OSError(f"{name} was changed by another writer")

    def _numbers(self, kind: str = "json") -> dict[str, int]:
        """The highest number of each table's, or view's, files."""
        found: dict[str, int] = {}
        for status in self.fs.listStatus(self._path("")):
            name, *number = status.getPath().getName().rsplit(".", 2)
            if len(number) == 2 and number[1] == kind and number[0].isdigit():
                found[name] = max(found.get(name, 0), int(number[0]))
        return found

    def tables(self) -> list[str]:
        return sorted(self._numbers())

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.tables()], "table_name string")

    # views
    def views(self) -> list[str]:
        return sorted(self._numbers("view"))

    def view(self, name: str) -> dict:
        """The view's text and its column names, if it was given some."""
        return self._load(name, "view", "view")

    def create_view(self, name: str, sql: str, columns: Sequence[str] = (), replace: bool = False, if_not_exists: bool = False) -> None:
        known = self._numbers("view").get(name.lower(), 0)
        if known and if_not_exists:
            return
        if name.lower() in self.tables() or (known and not replace):
            raise ValueError(f"{name} exists")
        self._save(name.lower(), known + 1, "view", {"sql": sql, "columns": list(columns)})

    def drop_view(self, name: str) -> None:
        self.view(name)
        self._forget(name.lower(), "view")

    def _forget(self, name: str, kind: str) -> None:
        for status in self.fs.listStatus(self._path("")):
            if re.fullmatch(re.escape(name) + r"\.\d+\." + kind, status.getPath().getName()):
                self.fs.delete(status.getPath(), False)

    def describe(self, name: str) -> DataFrame:
        e = self.entry(name)
        schema = T.StructType.fromJson(e.schema)
        rows = [(f.name, f.dataType.simpleString(), f.name not in e.not_null and f.name != e.key, f.name == e.key, e.defaults.get(f.name)) for f in schema]
        return self.spark.createDataFrame(rows, "field string, type string, nullable boolean, is_key boolean, default_value string")

    # definition
    def create(self, name: str, schema: T.StructType, key: str | None = None, not_null: Sequence[str] = (), unique: Sequence[str] = (), checks: dict[str, str] | None = None,
               defaults: dict[str, str] | None = None, references: dict[str, tuple[str, str]] | None = None, if_not_exists: bool = False) -> None:
        if name.lower() in self.tables() and if_not_exists:
            return
        if name.lower() in [*self.tables(), *self.views()]:
            raise ValueError(f"{name} exists")
        wide = T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else f.dataType) for f in schema])
        entry = Entry(name.lower(), json.loads(wide.json()), key, list(not_null), list(unique), checks or {}, defaults or {}, {k: list(v) for k, v in (references or {}).items()})
        self._write(entry, self.spark.createDataFrame([], wide))

    def create_as(self, name: str, df: DataFrame) -> None:
        self.create(name, df.schema)
        self.insert(name, df)

    def drop(self, name: str) -> None:
        entry = self.entry(name)
        self._forget(entry.name, "json")
        self.fs.delete(self._path(f"{entry.name}.data"), True)

    def add_column(self, name: str, column: str, kind: T.DataType, default: str | None = None) -> None:
        e = self.entry(name)
        self._reshape(e, self.table(name).withColumn(column, F.expr(default or "NULL").cast(kind)))

    def drop_column(self, name: str, column: str) -> None:
        """The column goes, with the rules that name it."""
        e = self.entry(name)
        if column == e.key:
            raise ValueError("a key stays")
        names = lambda text: re.findall(r"\w+", text.lower())
        e.not_null = [c for c in e.not_null if c != column]
        e.unique = [u for u in e.unique if column not in (u if isinstance(u, list) else [u])]
        e.checks = {n: text for n, text in e.checks.items() if column.lower() not in names(text)}
        e.defaults.pop(column, None)
        e.references.pop(column, None)
        self._reshape(e, self.table(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        e = self.entry(name)
        e.key = new if e.key == old else e.key
        e.not_null = [new if c == old else c for c in e.not_null]
        e.unique = [new if c == old else [new if u == old else u for u in c] if isinstance(c, list) else c for c in e.unique]
        e.references = {new if c == old else c: t for c, t in e.references.items()}
        e.defaults = {new if c == old else c: d for c, d in e.defaults.items()}
        e.checks = {n: re.sub(rf"\b{re.escape(old)}\b", new, text, flags=re.IGNORECASE) for n, text in e.checks.items()}
        self._reshape(e, self.table(name).withColumnRenamed(old, new))

    def _reshape(self, entry: Entry, df: DataFrame) -> None:
        entry.schema = json.loads(df.schema.json())
        self._write(entry, df)

    # data
    def _write(self, entry: Entry, *parts: DataFrame, keep: bool = False) -> list[str]:
        """A new version of the parts, each in a folder of its own, after those of the last version if it is kept.

        What is checked and what RETURNING reads is what was written, so the input is evaluated once. Gives the new folders.
        """
        old = entry.versions[-1]["folders"] if keep else []
        new = [f"{entry.name}.data/{uuid.uuid4().hex}" for _ in parts]
        try:
            for folder, df in zip(new, parts, strict=True):
                df.write.parquet(f"{self.folder}/{folder}")
            self._check(entry, self.folders(entry, new), self.folders(entry, old) if old else None)
            entry.versions.append({"number": len(entry.versions) + 1, "micros": time.time_ns() // 1000, "folders": [*old, *new]})
            self._save(entry.name, len(entry.versions), "json", asdict(entry))
        except Exception:
            for folder in new:
                self.fs.delete(self._path(folder), True)
            raise
        return new

    def folders(self, entry: Entry, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(entry.schema)).parquet(*[f"{self.folder}/{f}" for f in folders])

    def table(self, name: str) -> DataFrame:
        entry = self.entry(name)
        return self.folders(entry, entry.versions[-1]["folders"])

    def as_of(self, name: str, number: int | None = None, micros: int | None = None) -> DataFrame:
        """The table after change `number`, or as it was at a moment."""
        entry = self.entry(name)
        fit = [v for v in entry.versions if (number is None or v["number"] <= number) and (micros is None or v["micros"] <= micros)]
        if not fit:
            raise ValueError("the table is younger than that")
        return self.spark.read.parquet(*[f"{self.folder}/{f}" for f in fit[-1]["folders"]])  # with the columns of that time

    def _check(self, entry: Entry, new: DataFrame, old: DataFrame | None) -> None:
        """Raises where a new row breaks a constraint: one pass for all row rules, one aggregation for each unique column or
        list of them, and a join of it with the rows that stay."""
        rules = {f"null in {c}": F.col(c).isNull() for c in dict.fromkeys([*entry.not_null, *([entry.key] if entry.key else [])])}
        rules |= {f"check {n}": ~F.coalesce(F.expr(e), F.lit(True)) for n, e in entry.checks.items()}
        if rules:
            broken = new.agg(*[F.coalesce(F.max(r.cast("int")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(rules.values())]).first()
            for said, hit in zip(rules, broken, strict=True):
                if hit:
                    raise ValueError(f"{entry.name}: {said}")
        for u in [*([entry.key] if entry.key else []), *entry.unique]:
            key = u if isinstance(u, list) else [u]
            some = new.select(*key).dropna()
            if not some.groupBy(*key).count().filter("count > 1").isEmpty() or (old is not None and not old.select(*key).join(some, key, "left_semi").isEmpty()):
                raise ValueError(f"{entry.name}: {', '.join(key)} is not unique")
        for c, (target, key) in entry.references.items():
            other = (new if old is None else new.unionByName(old)) if target == entry.name else self.table(target)
            if not new.filter(F.col(c).isNotNull()).join(other.select(F.col(key).alias("quern_target")), F.col(c) == F.col("quern_target"), "left_anti").isEmpty():
                raise ValueError(f"{entry.name}: {c} refers to nothing in {target}")

    def fitted(self, entry: Entry, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns and types, missing columns by their defaults."""
        by_name = {c.lower(): c for c in rows.columns}
        return rows.select(*[(F.col(f"`{by_name[f.name.lower()]}`") if f.name.lower() in by_name else F.expr(entry.defaults.get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in T.StructType.fromJson(entry.schema)])

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """Appends rows, missing columns by their defaults; returns them as RETURNING would. Earlier rows are not rewritten."""
        entry = self.entry(name)
        return self.folders(entry, self._write(entry, self.fitted(entry, rows), keep=True))

    def upsert(self, name: str, rows: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> None:
        entry = self.entry(name)
        self._write(entry, V.upsert(self.table(name), rows, keys, update))

    def change(self, name: str, kept: DataFrame, changed: DataFrame | None = None) -> DataFrame | None:
        """The table becomes the rows kept and the rows changed or new; gives the latter as they were written."""
        entry = self.entry(name)
        parts = [self.fitted(entry, df) for df in (kept, changed) if df is not None]
        new = self._write(entry, *parts)
        return self.folders(entry, new[1:]) if changed is not None else None

    def update(self, name: str, where: Column, **values: Column) -> None:
        entry = self.entry(name)
        self._write(entry, V.update(self.table(name), where, **values))

    def delete(self, name: str, where: Column) -> None:
        entry = self.entry(name)
        self._write(entry, V.delete(self.table(name), where))

    def truncate(self, name: str) -> None:
        self.delete(name, F.lit(True))

    def analyze(self, name: str) -> DataFrame:
        """Per column: rows, nulls, distinct values (by sketch), least and most, in one pass."""
        df = self.table(name)
        parts = [(f"{k}{i}", e) for i, c in enumerate(df.columns) for k, e in (("s", F.count(c)), ("d", F.approx_count_distinct(c)), ("l", F.min(c).cast("string")), ("m", F.max(c).cast("string")))]
        one = df.agg(F.count("*").alias("n"), *[e.alias(a) for a, e in parts])
        rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"s{i}")).alias("null_count"), F.col(f"d{i}").alias("distinct_count"), F.col(f"l{i}").alias("least"), F.col(f"m{i}").alias("most")) for i, c in enumerate(df.columns)]
        return one.select(F.inline(F.array(*rows)))
