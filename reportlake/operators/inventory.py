"""File inventories, path classes and the case registry."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.text import is_sha256
from reportlake.operators.rules import Rule, issues_of

# Fixed values.
SUPPORTED = ("pdf", "docx", "xlsx")
CASE_STATUSES = ("DRAFT", "IN_REVIEW", "APPROVED", "REJECTED")
APPROVED_MARKER = "HUMAN_REVIEWED_GROUND_TRUTH"
EXPECTED_FILES = ("expected_normalized.json", "expected_validation.json", "expected_report.docx")


def inventory_counts(files: DataFrame, *dimensions: str) -> DataFrame:
    """Number of files per value of each dimension, in one aggregation (grouping sets)."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = files.groupingSets(sets, *dimensions).agg(
        F.count("*").alias("n"), F.grouping_id().alias("_set"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    last = len(dimensions) - 1
    for i, dimension in enumerate(dimensions):
        # grouping_id has a zero bit at the dimension that is grouped.
        mine = F.col("_set").bitwiseAND(1 << (last - i)) == 0
        name = F.when(mine, F.lit(dimension)).otherwise(name)
        value = F.when(mine, F.col(dimension).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")


def duplicate_files(files: DataFrame) -> DataFrame:
    """(sha256, path, copies) of files whose content occurs more than once.

    Long form: a group of copies may be any share of the files, so it is never put in one list."""
    counts = files.groupBy("sha256").agg(F.count("*").alias("copies")).filter("copies > 1")
    return files.select("sha256", "path").join(counts, "sha256")


def classify_paths(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """Longest matching prefix decides domain and document_type; unmatched paths get null.

    Only the prefix lengths in use are cut from each path, which makes it an equi-join."""
    lengths = [r[0] for r in mapping.select(F.length("prefix")).distinct().collect()]
    cuts = [
        F.when(F.length("path") >= n, F.struct(F.lit(n).alias("n"), F.substring("path", 1, n).alias("prefix")))
        for n in sorted(lengths)
    ]
    heads = paths.select("path", F.explode(F.array_compact(F.array(*cuts))).alias("h")).select("path", "h.*")
    best = heads.join(mapping, "prefix").groupBy("path").agg(
        F.max_by(F.struct("domain", "document_type"), "n").alias("c"))
    return paths.join(best, "path", "left").select(*paths.columns, "c.domain", "c.document_type")


def case_rules(require_approved: bool = False) -> list[Rule]:
    """Checks of a registered case. Columns: has_directory, has_manifest, domain, case_id,
    manifest_domain, manifest_case_id, status, approved_for_ground_truth,
    llm_used_as_ground_truth, extractor_id, reviewer_id, approver_id, disagreements_resolved,
    extracted_at, reviewed_at, approved_at, source_files, expected_files
    (array of struct name, marker, case_id, is_package)."""
    c = F.col
    true = lambda name: F.coalesce(c(name), F.lit(False))
    blank = lambda name: F.coalesce(F.trim(c(name)), F.lit("")) == ""
    listed, has = c("has_directory"), c("has_directory") & c("has_manifest")
    known = has & F.coalesce(c("status").isin(*CASE_STATUSES), F.lit(False))
    approved = known & (c("status") == "APPROVED")
    other = known & (c("status") != "APPROVED")
    unnamed = blank("extractor_id") | blank("reviewer_id") | blank("approver_id")
    same_id = c("manifest_case_id").eqNullSafe(c("case_id")) & c("manifest_domain").eqNullSafe(c("domain"))
    files = F.coalesce(c("expected_files"), F.array().cast(
        "array<struct<name:string,marker:string,case_id:string,is_package:boolean>>"))
    rules = [
        Rule("case_directory_missing", ~listed),
        Rule("case_manifest_required", listed & ~c("has_manifest") & F.lit(require_approved)),
        Rule("invalid_status", has & ~known),
        Rule("manifest_identity_mismatch", known & ~same_id),
        Rule("not_approved_for_ground_truth", approved & ~true("approved_for_ground_truth")),
        Rule("llm_output_as_ground_truth", approved & F.coalesce(c("llm_used_as_ground_truth"), F.lit(True))),
        Rule("review_ids_required", approved & unnamed),
        Rule("extractor_is_reviewer", approved & ~unnamed & (c("extractor_id") == c("reviewer_id"))),
        Rule("disagreements_unresolved", approved & ~true("disagreements_resolved")),
    ]
    rules += [Rule("review_time_required", approved & blank(f), f)
              for f in ("extracted_at", "reviewed_at", "approved_at")]
    for name in EXPECTED_FILES:
        given = F.try_element_at(F.filter(files, lambda x: x["name"] == name), F.lit(1))  # noqa: B023
        rules.append(Rule("expected_file_missing", approved & given.isNull(), name))
        if name.endswith(".docx"):
            rules.append(Rule("expected_report_invalid", approved & given.isNotNull()
                              & ~F.coalesce(given["is_package"], F.lit(False)), name))
        else:
            rules += [
                Rule("marker_missing", approved & given.isNotNull()
                     & ~given["marker"].eqNullSafe(F.lit(APPROVED_MARKER)), name),
                Rule("expected_case_id_mismatch", approved & given.isNotNull()
                     & ~given["case_id"].eqNullSafe(c("manifest_case_id")), name),
            ]
    no_sources = F.coalesce(F.size("source_files"), F.lit(0)) <= 0
    return rules + [
        Rule("source_files_required", approved & no_sources),
        Rule("marked_approved_without_status", other & true("approved_for_ground_truth")),
        Rule("case_not_approved", other & F.lit(require_approved)),
    ]


def case_issues(cases: DataFrame, require_approved: bool = False) -> DataFrame:
    found = issues_of(case_rules(require_approved))
    return cases.select("domain", "case_id", F.explode(found).alias("i")).select(
        "domain", "case_id", "i.code", "i.field_path")


def source_file_issues(cases: DataFrame, files: DataFrame) -> DataFrame:
    """Source files of approved cases against the inventory (path, sha256); first fault per file,
    but a wrong checksum and a missing deidentification are both reported."""
    listed = cases.filter("status = 'APPROVED'").select(
        "domain", "case_id", F.posexplode("source_files").alias("index", "f"))
    named = listed.select("domain", "case_id", "index", F.col("f.relative_path").alias("path"),
                          F.col("f.sha256").alias("expected"), F.col("f.deidentified").alias("deidentified"))
    joined = named.join(files.select("path", "sha256"), "path", "left")
    path = F.coalesce(F.col("path"), F.lit(""))
    escapes = path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)")
    first = (
        F.when(path == "", "relative_path_required")
        .when(~is_sha256(F.col("expected")), "valid_sha256_required")
        .when(escapes, "path_escapes_root")
        .when(F.col("sha256").isNull(), "file_not_found")
    )
    later = F.array(
        F.when(F.lower("sha256") != F.lower("expected"), F.lit("sha256_mismatch")),
        F.when(~F.coalesce(F.col("deidentified"), F.lit(False)), F.lit("not_deidentified")))
    codes = F.when(first.isNotNull(), F.array(first)).otherwise(F.array_compact(later))
    return joined.select("domain", "case_id", "index", F.explode(codes).alias("code"))


def case_summary(cases: DataFrame, issues: DataFrame) -> DataFrame:
    """planned, approved, pending and number of errors."""
    known = F.col("has_directory") & (
        ~F.col("has_manifest") | F.coalesce(F.col("status").isin(*CASE_STATUSES), F.lit(False)))
    approved = F.coalesce(F.col("has_manifest") & known & (F.col("status") == "APPROVED"), F.lit(False))
    counts = cases.agg(
        F.count("*").alias("planned"), F.count_if(approved).alias("approved"),
        F.count_if(known & ~approved).alias("pending"))
    errors = issues.agg(F.count("*").alias("errors"))
    return counts.withColumn("errors", errors.scalar())


def paired_values(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(domain, source_input, field, value) on both sides: one row per field, equal or not."""
    right = actual.withColumnRenamed("value", "actual_value")
    joined = expected.join(right, ["domain", "source_input", "field"], "left")
    return joined.withColumn("matches", F.col("value").eqNullSafe(F.col("actual_value")))


def path_domain(path: Column, root: str) -> Column:
    """First folder below the root."""
    relative = F.replace(
        path, F.lit(root.rstrip("/") + "/"), F.lit("")
    )
    return F.regexp_extract(relative, r"^([^/]+)/", 1)
