"""What the corpus operators share: reading tables, shared scratch folders and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most characters and texts that one numpy step over an Arrow batch takes in, so that memory does not follow the input.
STEP_CHARS, STEP_TEXTS = 1 << 19, 256
#: Most characters of a step that takes distinct runs out of its texts: the more, the oftener each run serves.
STEP_RUNS = 1 << 21
#: Most groups that a sample to learn from may have.
GROUPS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as long texts must not meet by the ten thousand in one Python worker, and sends them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # the setting is newer than the oldest Spark that is supported
        if "CANNOT_MODIFY" not in str(e):
            raise


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context: they may run where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "quern_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(target)
    context.quern_shipped = True


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset a local folder is made, for a local
    master alone: executors elsewhere would not find it."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (context.getCheckpointDir().get() if context.getCheckpointDir().isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/quern-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the process
        pass


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, and lost executors cost no second pass."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.quern_path = path
    return made


def discard(df: DataFrame | None) -> None:
    """Deletes what materialise wrote for df, once nothing reads it any more."""
    if (path := getattr(df, "quern_path", None)) is not None:
        delete(df.sparkSession, path)


def without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """docs without the rows whose id is in gone (one column), whatever names the columns of docs have."""
    other = gone.toDF(free_name(docs))
    return docs.join(other, docs[doc_id].cast("long") == other[other.columns[0]], "left_anti")


def free_name(docs: DataFrame, wish: str = "quern") -> str:
    """A column name that docs does not have."""
    while wish.lower() in [c.lower() for c in docs.columns]:
        wish += "_"
    return wish


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(lengths: list[int], most: int = STEP_CHARS, most_texts: int = STEP_TEXTS) -> Iterator[tuple[int, int]]:
    """Ranges of at most `most_texts` neighbouring texts of at most `most` characters together; a longer text stands alone."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and (total + n > most or i - at >= most_texts):
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def give_back() -> None:
    """Returns memory that a task has freed to the system, as its worker lives on and others run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def map_texts(df: DataFrame, function: Callable[[list], dict[str, list]], schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", most: int = STEP_CHARS) -> DataFrame:
    """Adds what function makes of each slice of texts (None: null) to the kept columns, one row for one row.

    A slice has at most `most` characters, and STEP_TEXTS texts unless most is larger than usual."""
    bound_batches(df.sparkSession)
    kept = [df.schema[c] for c in keep]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices([len(t or "") for t in texts], most, STEP_TEXTS if most == STEP_CHARS else len(texts)):
                made = function(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()], names=list(keep) + list(made))
        give_back()

    return df.select(*keep, text).mapInArrow(run, fields)


def learn_split(doc_id: Column) -> Column:
    """True for rows that may be learnt from; the others, whose remainder is 2, are held out. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def package_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; each executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def filter_texts(df: DataFrame, keeps: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """The rows whose text keeps() accepts, all columns as they are. Only the texts go to Python, and only verdicts come back."""
    bound_batches(df.sparkSession)

    @F.arrow_udf("boolean")
    def verdict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts = column.to_pylist()
            yield pa.array([bool(k) for a, b in slices([len(t or "") for t in texts]) for k in keeps(texts[a:b])], pa.bool_())
        give_back()

    return df.filter(verdict(df[text]))


def share_sample(rows: DataFrame, group: str, key: str, each: int, most: int, text: str = "text", groups: int = GROUPS) -> DataFrame | None:
    """(grp, rank, text) of about `each` rows of every group, taken by a hash of their key, so that a table gives the same
    sample however it is laid out; at most `most` rows in all, whole texts, written once. None if there is no row.

    With many groups each gives fewer, so that all of them fit into `most` together; of a group with fewer rows all are taken.
    More than `groups` groups are an error, as none is left out in silence.
    """
    fit = rows.filter(F.col(group).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in fit.groupBy(group).count().limit(groups + 1).collect()}
    if not counts:
        return None
    if len(counts) > groups:
        raise ValueError(f"{group} has more than {groups} values to learn; raise groups, and most with it")
    room = most - 6 * math.sqrt(most)  # hashes take some rows more or less
    each = min(each, room / len(counts))
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, each / n))])[F.col(group)]
    rank = F.xxhash64(F.col(key), F.lit(17))
    taken = fit.filter(F.pmod(rank, F.lit(1 << 20)) < share * (1 << 20)).select(F.col(group).alias("grp"), rank.alias("rank"), F.col(text).alias("text"))
    made = materialise(taken, "sample")
    if made.count() > most:  # many rows share a key, and the hash takes all of them
        place = F.row_number().over(Window.partitionBy("grp").orderBy("rank", F.xxhash64("text"), "text"))
        made = materialise(made.withColumn("place", place).filter(F.col("place") <= each).drop("place"), "sample")
    return made
