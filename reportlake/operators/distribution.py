"""How data is laid out: input spread, measured broadcasts, lineage cuts."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Estimated bytes of a part that `spread` makes; texts take a few times their estimate.
SHARE_BYTES = 8 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core a share of a small input.

    A file of one row group is read by one task. Input of fewer full-size splits than cores is
    therefore shuffled once (at most cores x split size moves), a part a core and more parts where these
    would grow; larger input is left as it is. A union of spread tables reads a part of each in one task."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128MB"))
    size = input_bytes(df)
    if size > cores * split:
        return df
    return df.repartition(max(cores, -(-size // SHARE_BYTES)), *keys)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Put a small table with costly work ahead on all cores; adaptive planning would merge it
    into one task by its size."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def input_bytes(df: DataFrame) -> int:
    """Size of the scanned input as Catalyst knows it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _bytes(text: str) -> int:
    text = text.strip().lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def measured_bytes(df: DataFrame) -> int:
    """Serialized size of a side, counted over all of its rows."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint"))
    return df.agg(size.alias("size")).first()["size"] or 0


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after the side was measured; beyond the limit Spark shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def working_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, else a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession):
    """An action in here removes its shuffle files when it ends; nothing may read them again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, even: bool = True) -> DataFrame:
    """Write a reused intermediate result as Parquet and read it back; this cuts lineage and
    survives the loss of executors. With `even`, the rows of a small input are spread first, or
    one file would be written and every later read would be one task. What was shuffled for it is removed
    from the disks of the executors, where it would stay until the driver collects its garbage."""
    path = f"{working_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        (spread(df) if even else df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
