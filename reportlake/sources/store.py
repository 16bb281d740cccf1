"""Stored tables: lookups, filtered scans, keyed merges, deletion and lifecycle.

A keyed table is a Parquet folder partitioned into buckets of one column. A change reads and overwrites
only the buckets that its keys fall into; the files of all others stay as they are."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reportlake.functions.ids import point_id
from reportlake.functions.vectors import vector_issue
from reportlake.operators.search import Filters, apply_filters

STATES = ("uploaded", "processing", "ready", "failed", "deleted")
BUCKETS = 256


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def in_buckets(df: DataFrame, by: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))


def read_keyed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of a keyed table; none if nothing was written yet."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, bucket int").parquet(folder).drop("bucket")


def _rows_of(spark: SparkSession, folder: str, schema: str, buckets: list[int]) -> DataFrame:
    """The rows of some buckets; the condition prunes the folders of all others."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, bucket int").parquet(folder).filter(F.col("bucket").isin(buckets)).drop("bucket")


def _numbers(rows: DataFrame, by: str, buckets: int) -> list[int]:
    """Buckets that some rows fall into; at most `buckets` numbers reach the driver."""
    return [r["bucket"] for r in in_buckets(rows.select(by), by, buckets).select("bucket").distinct().collect()]


def _overwrite(rows: DataFrame, folder: str, by: str, buckets: int) -> None:
    placed = in_buckets(rows, by, buckets).repartition("bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def upsert(new: DataFrame, folder: str, schema: str, keys: list[str], order: str | None = None, by: str | None = None,
           buckets: int = BUCKETS) -> list[int]:
    """Insert or overwrite rows by key (see `merge_by_key`); gives the buckets that were written.

    `by` is the key column that names the bucket, the first one unless given. A table keeps the number
    of buckets it was first written with. A change that is repeated leaves the same rows."""
    spark, by = new.sparkSession, by or keys[0]
    touched = _numbers(new, by, buckets)
    if touched:
        stored = _rows_of(spark, folder, schema, touched)
        _overwrite(merge_by_key(stored, new, keys, order), folder, by, buckets)
    return touched


def delete_keys(gone: DataFrame, folder: str, schema: str, by: str, buckets: int = BUCKETS) -> list[int]:
    """Delete the rows whose `by` is among `gone`; gives the buckets that were touched."""
    spark = gone.sparkSession
    touched = _numbers(gone, by, buckets) if exists(spark, folder) else []
    if not touched:
        return []
    left = _rows_of(spark, folder, schema, touched).join(gone.select(by).distinct(), by, "left_anti")
    still = _numbers(left, by, buckets)
    if still:
        _overwrite(left.select(*_columns(schema)), folder, by, buckets)
    for empty in set(touched) - set(still):
        remove(spark, f"{folder}/bucket={empty}")
    return touched


def _columns(schema: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(schema).fields]


def delete_with_event(gone: DataFrame, folder: str, schema: str, events: str, at: Column, buckets: int = BUCKETS) -> list[int]:
    """Delete the points of documents (document_id) and append a `deleted` event for each to the event
    log. The event is written first: after a failure the call is repeated, and of equal events the
    latest counts."""
    ids = gone.select("document_id").distinct()
    ids.select("document_id", at.alias("ts"), F.lit(1 << 40).alias("seq"), F.lit("deleted").alias("state"),
               F.lit(None).cast("string").alias("stage"), F.lit(None).cast("bigint").alias("chunk_count")
               ).write.mode("append").parquet(events)
    return delete_keys(ids, folder, schema, "document_id", buckets)


def merge_by_key(stored: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Insert or overwrite rows by key; of several new rows the one latest by `order` counts.

    A partial aggregation, so any number of rows of one key meets as one per task."""
    columns = stored.columns
    place = F.col(order) if order else F.lit(0)
    both = stored.withColumn("_place", F.struct(F.lit(0).alias("new"), place.alias("at"))).unionByName(
        new.select(*columns).withColumn("_place", F.struct(F.lit(1).alias("new"), place.alias("at"))))
    rest = [c for c in columns if c not in keys]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_place").alias("row"))
    return merged.select(*keys, "row.*").select(*columns)


def embedded_points(chunks: DataFrame, payload: Column | None = None) -> DataFrame:
    """Rows to store for embedded chunks: stable id, vector, chunk columns, merged metadata."""
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    if payload is not None:
        extra = F.map_filter(payload, lambda _, v: v.isNotNull())
        kept = F.map_filter(metadata, lambda k, _: ~F.map_contains_key(extra, k))
        metadata = F.map_concat(kept, extra)
    return chunks.withColumns(
        {"point_id": point_id(F.col("document_id"), F.col("chunk_id")), "metadata": metadata})


def delete_documents(stored: DataFrame, document_ids: DataFrame) -> DataFrame:
    return stored.join(document_ids.select("document_id").distinct(), "document_id", "left_anti")


def counts_per_document(stored: DataFrame) -> DataFrame:
    return stored.groupBy("document_id").agg(F.count("*").alias("n"))


def verify_counts(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose stored chunk count differs from the expected one (document_id, expected)."""
    joined = expected.join(counts_per_document(stored), "document_id", "left")
    actual = F.coalesce("n", F.lit(0))
    return joined.filter(actual != F.col("expected")).select(
        "document_id", "expected", actual.alias("actual"))


def reindex(stored: DataFrame, documents: DataFrame, rebuilt: DataFrame, wanted: DataFrame
            ) -> tuple[DataFrame, DataFrame]:
    """Replace the chunks of the wanted documents by rebuilt ones.

    Result: the new table, and the refused ids (missing or deleted documents)."""
    alive = documents.filter("processing_status <> 'deleted'").select("document_id")
    allowed = wanted.join(alive, "document_id", "left_semi")
    refused = wanted.join(alive, "document_id", "left_anti")
    fresh = rebuilt.join(allowed, "document_id", "left_semi").select(*stored.columns)
    return delete_documents(stored, allowed).unionByName(fresh), refused


def collection_facts(stored: DataFrame, vector: str = "vector") -> DataFrame:
    """Smallest and largest vector size and the number of vectors that may not be stored."""
    return stored.agg(
        F.min(F.size(vector)).alias("min_size"), F.max(F.size(vector)).alias("max_size"),
        F.count_if(vector_issue(F.col(vector)).isNotNull()).alias("invalid"), F.count("*").alias("n"))


def incompatible_vectors(new: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    issue = vector_issue(F.col(vector), F.lit(dimension))
    return new.withColumn("issue", issue).filter("issue is not null")


def get_by_id(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.filter(F.col(key) == value)


def searchable_chunks(table: DataFrame, filters: Filters) -> DataFrame:
    """Filtered scan without the vector column, which Parquet then never reads."""
    return apply_filters(table, filters).drop("vector")


def list_documents(documents: DataFrame, offset: int = 0, limit: int = 100, **equal: str | None) -> DataFrame:
    """A page of documents by id, restricted by the given columns."""
    for name, value in equal.items():
        if value is not None:
            documents = documents.filter(F.col(name) == value)
    return documents.orderBy("document_id").offset(offset).limit(limit)


def newest_first(reports: DataFrame, **equal: str | None) -> DataFrame:
    for name, value in equal.items():
        if value is not None:
            reports = reports.filter(F.col(name) == value)
    return reports.orderBy(F.desc("created_at"), "report_id")


def known_checksums(uploads: DataFrame, stored: DataFrame, *extra: str) -> DataFrame:
    """Uploads whose checksum (and extra columns) is stored and not deleted."""
    alive = stored.filter("processing_status <> 'deleted'") if "processing_status" in stored.columns else stored
    return uploads.join(alive.select("checksum", *extra), ["checksum", *extra], "left_semi")


def ingest_outcomes(uploads: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """uploads (upload_no, checksum, force), stored (checksum, processing_status, embedding_model,
    embedding_dimension) -> indexed, reindexed, skipped_duplicate or error per upload.

    Of equal new uploads the first is indexed; the later ones find it stored."""
    alive = stored.filter("processing_status <> 'deleted'").select(
        "checksum", F.lit(True).alias("known"),
        (F.coalesce((F.col("processing_status") == "ready") & (F.col("embedding_model") == model),
                    F.lit(False)) & F.col("embedding_dimension").isNotNull()).alias("compatible"))
    firsts = uploads.groupBy("checksum").agg(F.min("upload_no").alias("first"))
    joined = uploads.join(alive, "checksum", "left").join(firsts, "checksum")
    new = F.col("known").isNull()
    outcome = (
        F.when(new & (F.col("upload_no") == F.col("first")), "indexed")
        .when(F.col("force"), "reindexed")
        .when(new | F.col("compatible"), "skipped_duplicate")
        .otherwise("error")
    )
    return joined.select("upload_no", "checksum", outcome.alias("outcome"))


def ingest_summary(outcomes: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Found, indexed, reindexed, skipped and failed uploads and all chunks of the good ones."""
    good = F.col("outcome").isin("indexed", "reindexed", "skipped_duplicate")
    joined = outcomes.join(chunk_counts, "checksum", "left")
    is_ = lambda name: F.count_if(F.col("outcome") == name)
    return joined.agg(
        F.count("*").alias("files_found"), is_("indexed").alias("indexed"),
        is_("reindexed").alias("reindexed"), is_("skipped_duplicate").alias("skipped"),
        is_("error").alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col("n_chunks"))), F.lit(0)).alias("total_chunks"))


def lifecycle_states(events: DataFrame) -> DataFrame:
    """events (document_id, ts, seq, state, stage, chunk_count) -> current row per document.

    A failure's stage stays until processing starts again or succeeds; deletion keeps it."""
    at = F.struct("ts", "seq")
    decides = F.col("state").isin("processing", "ready", "failed")
    stage = F.struct(F.when(F.col("state") == "failed", F.col("stage")).alias("stage"))
    return events.groupBy("document_id").agg(
        F.max_by("state", at).alias("processing_status"),
        F.max_by(stage, F.when(decides, at)).getField("stage").alias("failed_stage"),
        F.max_by("chunk_count", F.when(F.col("state") == "ready", at)).alias("chunk_count"),
        F.max("ts").alias("updated_at"))
