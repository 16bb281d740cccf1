"""Continuous ingest on Structured Streaming."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from reportlake.sources.store import exists, remove

KEYS = ("checksum", "domain")
#: Marks rows that tell of a key that other runs have stored.
KNOWN = "_known"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Batches of the state log between two compactions.
EVERY = 10


class _Once(StatefulProcessor):
    """Lets the first row of a key pass and forgets the key when it expires."""

    def __init__(self, expiry: int) -> None:
        self.expiry = expiry

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.expiry)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            if first is None and len(part):
                first = part.head(1)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


def new_uploads(uploads: DataFrame, known: DataFrame) -> DataFrame:
    """Stream of the first row of each checksum in a domain, of uploads and `known` keys, a stream too.

    What was seen is keyed state: a batch costs what its own keys cost, whatever was stored before. Keys
    are looked up by Spark itself, none passes a Python worker. Rows of `known` are marked; they belong
    to the first batch, where either row of a key may come first."""
    marked = known.select(*KEYS, F.lit(True).alias(KNOWN))
    both = marked.unionByName(uploads.withColumn(KNOWN, F.lit(False)), allowMissingColumns=True)
    return both.select(*uploads.columns, KNOWN).dropDuplicates(list(KEYS))


def expiring_uploads(uploads: DataFrame, stored: DataFrame, expiry: int) -> DataFrame:
    """Stream of the first upload of each checksum in a domain, where a key is forgotten `expiry`
    milliseconds after it.

    `stored` (checksum, domain) is read once, when the query starts for the first time. Every key passes a
    Python worker, about 2 ms each on eight cores."""
    known = stored.select(*KEYS).distinct().groupBy(*KEYS)
    return uploads.groupBy(*KEYS).transformWithStateInPandas(
        _Once(expiry), uploads.schema, "Append", "ProcessingTime", known)


def _not_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key, null parts included, is not among the keys."""
    held = keys.select(*[F.col(c).alias(f"_{c}") for c in KEYS])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEYS]
    return rows.join(held, same[0] & same[1], "left_anti")


def ingest(uploads: DataFrame, table: str, checkpoint: str, expiry: int | None = None, **trigger) -> StreamingQuery:
    """Append uploads that are not stored yet; partitioned by domain.

    Every batch overwrites its own folder, named by the checkpoint and the batch number, so a replayed
    batch leaves what it left before. A query with a new checkpoint starts from the keys that other
    runs have stored, which are written once to `known` in the checkpoint and read by its first batch only;
    its own rows are in its state. `expiry` in milliseconds bounds the state; without it a repeat is
    recognised for ever. A checkpoint goes on with the kind of query that made it, with or without expiry."""
    spark = uploads.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    keys = ", ".join(f"{c} string" for c in KEYS)

    def others() -> DataFrame:
        if not exists(spark, table):
            return spark.createDataFrame([], keys)
        stored = spark.read.schema(f"{keys}, run string").parquet(table)
        return stored.filter(F.col("run") != run).select(*KEYS).distinct()

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("domain").parquet(f"{table}/run={run}/batch={batch_id}")

    def save_unknown(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.filter(~F.col(KNOWN)).drop(KNOWN)
        if batch_id == 0:
            fresh = _not_in(fresh, batch.sparkSession.read.schema(keys).parquet(snapshot))
        save(fresh, batch_id)

    if expiry:
        stream, write = expiring_uploads(uploads, others(), expiry), save
    else:
        snapshot = f"{checkpoint}/known"
        if not exists(spark, f"{snapshot}/_SUCCESS"):
            others().write.mode("overwrite").parquet(snapshot)
        stream, write = new_uploads(uploads, spark.readStream.schema(keys).parquet(snapshot)), save_unknown
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings it was started with
        return (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def latest_states(events: DataFrame) -> DataFrame:
    """Latest lifecycle state per document as a streaming aggregation (update mode)."""
    return events.groupBy("document_id").agg(
        F.max_by(F.struct("state", "ts", "seq"), F.struct("ts", "seq")).alias("s")
    ).select("document_id", "s.state", "s.ts", "s.seq")


def track_states(events: DataFrame, folder: str, checkpoint: str, every: int = EVERY, **trigger) -> StreamingQuery:
    """Write each batch of changed states to a log, and fold the log into a base every few batches. Base
    and log are named by the batches they hold, so a replayed batch writes the same again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/batch={batch_id}")
        if batch_id % every == every - 1:
            compact_states(batch.sparkSession, folder, batch_id)

    return (
        latest_states(events).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _numbered(spark: SparkSession, pattern: str) -> list[int]:
    """Numbers of the finished folders `…=number` of a pattern, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().rpartition("=")[2]) for f in found)


def _newest(rows: DataFrame) -> DataFrame:
    at = F.struct("ts", "seq")
    return rows.groupBy("document_id").agg(
        F.max_by("state", at).alias("state"), F.max("ts").alias("ts"), F.max_by("seq", at).alias("seq"))


def _generation(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame | None:
    """The newest base and the log batches behind it, up to a batch; None where there is neither."""
    bases = [n for n in _numbered(spark, f"{folder}/base/upto") if upto is None or n < upto]
    base = bases[-1] if bases else -1
    log = [n for n in _numbered(spark, f"{folder}/log/batch") if n > base and (upto is None or n <= upto)]
    paths = [f"{folder}/base/upto={base}"] * bool(bases) + [f"{folder}/log/batch={n}" for n in log]
    return spark.read.parquet(*paths).select("document_id", "state", "ts", "seq") if paths else None


def compact_states(spark: SparkSession, folder: str, upto: int) -> None:
    """Fold base and log up to a batch into a new base. What the base before it held goes; that base
    itself stays for those who read it now."""
    rows = _generation(spark, folder, upto)
    if rows is None:
        return
    _newest(rows).write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    older = [n for n in _numbered(spark, f"{folder}/base/upto") if n < upto]
    for n in older[:-1]:
        remove(spark, f"{folder}/base/upto={n}")
    for n in _numbered(spark, f"{folder}/log/batch"):
        if older and n <= older[-1]:
            remove(spark, f"{folder}/log/batch={n}")


def current_states(spark: SparkSession, folder: str) -> DataFrame:
    """Latest state of every document: one base and at most the batches since."""
    rows = _generation(spark, folder)
    if rows is None:
        return spark.createDataFrame([], "document_id string, state string, ts timestamp")
    return _newest(rows).drop("seq")
