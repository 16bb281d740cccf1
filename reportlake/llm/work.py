"""Shared folder for written tables, and rows by identifier."""

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests on one machine), a new one
    that is set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable, name: str = "table"):
    """What `make` returns, without the tables that it stored on the way: those are removed. A
    DataFrame is written first, as it reads them."""
    _scratch.append([])
    try:
        out = make()
        if isinstance(out, DataFrame):
            path, schema = new_path(spark, name), out.schema
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
        return out
    finally:
        for path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def first_of_each(rows: DataFrame, group: str, n: int, salts: int = 32) -> DataFrame:
    """The n rows of each group with the smallest hash of their `id`, numbered by `turn`. A group is
    first cut down to n rows in each of its salted parts, so one task sees at most salts * n of it."""
    rows = rows.withColumn("h", F.xxhash64("id"))
    salt = F.pmod(F.col("h"), F.lit(salts))
    part = F.row_number().over(Window.partitionBy(group, salt).orderBy("h", "id"))
    rows = rows.withColumn("part", part).where(F.col("part") <= n)
    turn = F.row_number().over(Window.partitionBy(group).orderBy("h", "id"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n)


def held_out(id_column):
    """Rows that no classifier may learn from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Sent:
    """A broadcast of an object's fields. The object is put together in the task: its class travels with
    the function, so workers need no copy of this package."""

    def __init__(self, spark: SparkSession, thing) -> None:
        self.fields, self.kind = spark.sparkContext.broadcast(vars(thing)), type(thing)

    @property
    def value(self):
        out = self.kind.__new__(self.kind)
        vars(out).update(self.fields.value)
        return out


def hidden_file() -> int:
    """Descriptor of a file without a name: gone when its process ends."""
    handle, path = tempfile.mkstemp()
    os.unlink(path)
    return handle


def give_back() -> None:
    """Return freed memory of this process to the machine, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of the rows that go to a Python worker at once, and rows that the Parquet reader holds at once.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(spark: SparkSession) -> None:
    """Let texts travel in small batches where the session does not say otherwise: a batch lies in the
    executor and in its worker at the same time. The settings stay, as DataFrames run later; they change
    memory, never a result."""
    for name, size in SMALL.items():
        if name not in spark.conf.getAll:
            spark.conf.set(name, size)


def lean(run: Callable) -> Callable:
    """`run` for mapInArrow in a worker that gives memory back before and after it. Workers are reused
    and wait for a minute: what they held for one task would lie beside what the next stage needs."""

    def task(stream):
        give_back()
        yield from run(stream)
        give_back()

    return task
