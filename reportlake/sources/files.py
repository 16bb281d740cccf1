"""Files as tables: inventories, safety checks, registries and saved results."""

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportlake.functions.ids import checksum, managed_path, short_document_id
from reportlake.functions.text import safe_file_name
from reportlake.operators.inventory import SUPPORTED, path_domain
from reportlake.settings import MAX_FILE_BYTES

# Fixed values.
DOCUMENT_EXTENSIONS = ("pdf", "docx")
MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/octet-stream",
)
MAIN_MEMBER = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml"}
CONTENT_TYPES = "[Content_Types].xml"
ACTIVE_CONTENT = r"(?i)(vbaProject\.bin|\.exe|\.dll)$"


def read_files(spark: SparkSession, root: str, extensions=SUPPORTED) -> DataFrame:
    """Files below a folder with those extensions, with path, length and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(F.lower("path").rlike(rf"\.({'|'.join(extensions)})$"))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Paths of documents in order."""
    return read_files(spark, root, DOCUMENT_EXTENSIONS).select("path").orderBy("path")


def file_format(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, domain, format, length, sha256) of the report files; the first folder is the domain."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    return read_files(spark, root).select(
        "path", path_domain(F.col("path"), base).alias("domain"),
        file_format(F.col("path")).alias("format"), "length", checksum(F.col("content")).alias("sha256"))


def _member_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names = []
        for content in batch["content"]:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as package:
                    names.append(package.namelist())
            except zipfile.BadZipFile:
                names.append(None)
        yield pd.DataFrame({"path": batch["path"], "members": names})


def file_issues(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, issue): first reason to refuse a file; null for safe ones.

    Files above the limit are judged by their length and are never opened."""
    kind = file_format(F.col("path"))
    small = files.filter(F.col("length") <= max_bytes)
    office = small.filter(kind.isin(*MAIN_MEMBER)).select("path", "content")
    members = office.mapInPandas(_member_names, "path string, members array<string>")
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    judged = (
        files.withColumn("is_pdf", magic).select("path", "length", "is_pdf", kind.alias("kind"))
        .join(members, "path", "left")
    )
    main = F.create_map(*[F.lit(x) for pair in MAIN_MEMBER.items() for x in pair])[F.col("kind")]
    complete = F.array_contains("members", main) & F.array_contains("members", CONTENT_TYPES)
    issue = (
        F.when(F.col("length") > max_bytes, "file_too_large")
        .when((F.col("kind") == "pdf") & ~F.col("is_pdf"), "pdf_signature_mismatch")
        .when(F.col("kind") == "pdf", F.lit(None).cast("string"))
        .when(~F.col("kind").isin(*MAIN_MEMBER), "unsupported_type")
        .when(F.col("members").isNull(), "invalid_package")
        .when(~complete, "package_content_mismatch")
        .when(F.exists("members", lambda m: m.rlike(ACTIVE_CONTENT)), "active_content")
    )
    return judged.select("path", issue.alias("issue"))


def inspect_documents(files: DataFrame, max_bytes: int = MAX_FILE_BYTES,
                      mime_type: Column | None = None) -> DataFrame:
    """Upload inspection of documents; refused rows keep their reason."""
    path = F.col("path")
    kind = file_format(path)
    guessed = (
        F.when(kind == "pdf", MIME_TYPES[0]).when(kind == "docx", MIME_TYPES[1]).otherwise(MIME_TYPES[2]))
    mime = F.coalesce(mime_type, guessed) if mime_type is not None else guessed
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    reason = (
        F.when(~kind.isin(*DOCUMENT_EXTENSIONS), "unsupported_extension")
        .when(F.col("length") > max_bytes, "file_too_large")
        .when(~mime.isin(*MIME_TYPES), "unsupported_mime_type"))
    digest = checksum(F.col("content"))
    return files.select(
        "path", name.alias("original_filename"), safe_file_name(name).alias("stored_filename"),
        kind.alias("file_type"), mime.alias("mime_type"), F.col("length").alias("file_size_bytes"),
        digest.alias("checksum_sha256"), short_document_id(digest).alias("source_id"),
        reason.alias("issue"))


def with_managed_path(files: DataFrame) -> DataFrame:
    """Place of the stored copy: domain / first two digits / checksum_name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("managed_path", managed_path(F.col("domain"), F.col("sha256"), name))


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; a byte-order mark does not disturb the first name."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one per file; a file that holds no readable object fails the read."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return reader.schema(schema).json(path)


def read_retrieval_results(spark: SparkSession, path: str) -> DataFrame:
    """Saved results: query_id, retrieved and expected ids, as JSON lines."""
    return spark.read.schema("query_id string, retrieved array<string>, expected array<string>").json(path)


def write_audit(summary: DataFrame, files: DataFrame, folder: str) -> None:
    """Audit result: a JSON summary and the rows per file."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    files.write.mode("overwrite").parquet(f"{folder}/files")
