"""Three population sources become one balanced report.

sources: bundle_id, source_file_id, role, period (kind, start, end, label), organization_id,
organization_name, classification, sha256.  values: bundle_id, source_file_id, role, field, value.
Groups are one bundle or one field of a bundle; counts and extremes are enough, nothing is
collected before a bundle is known to have exactly three sources."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.ids import combined_checksum, uuid5
from reportlake.operators.extract import ROLE_FIELDS
from reportlake.operators.rules import (
    CANONICAL_FIELDS,
    ERROR,
    ISSUE,
    WARNING,
    Rule,
    canonical_population_rules,
    explode_issues,
    issues_of,
    status_of,
    with_numbers,
)
from reportlake.settings import OFFICIAL, SYNTHETIC

ROLES = tuple(ROLE_FIELDS)
INPUT_FIELDS = tuple(sorted(f for fields in ROLE_FIELDS.values() for f in fields))
# Terms of the two closing balances (plus, minus).
CLOSING = {
    "population_closing": (
        ("population_opening", "birth_local_resident", "permanent_in"),
        ("death_local_resident", "permanent_out"),
    ),
    "temporary_closing": (("temporary_opening", "temporary_new"), ("temporary_removed",)),
}
SCHEMA_VERSION = "population-canonical-v1"


def bundle_facts(sources: DataFrame) -> DataFrame:
    """One row per bundle: source counts, spread of periods and organizations, classification."""
    span = F.struct("period.kind", "period.start", "period.end")
    return sources.groupBy("bundle_id").agg(
        F.count("*").alias("n_sources"),
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES],
        (F.min(span) != F.max(span)).alias("periods_differ"),
        (F.min("organization_id") != F.max("organization_id")).alias("organizations_differ"),
        F.min("period").alias("period"),
        F.min("organization_id").alias("organization_id"),
        F.min("organization_name").alias("organization_name"),
        F.when(F.bool_and(F.col("classification") == SYNTHETIC), SYNTHETIC)
        .otherwise(OFFICIAL).alias("classification"),
    )


def identity_rules() -> list[Rule]:
    rules = []
    for role in ROLES:
        n = F.col(f"n_{role}")
        rules += [
            Rule("POP_SOURCE_ROLE_MISSING", n == 0, "sources", message=f"Thiếu nguồn {role}."),
            Rule("POP_SOURCE_ROLE_DUPLICATE", n > 1, "sources",
                 message=f"Nguồn {role} xuất hiện nhiều lần."),
        ]
    return rules + [
        Rule("POP_SOURCE_COUNT_INVALID", F.col("n_sources") != len(ROLES), "sources",
             message="Bundle population phải gồm đúng ba source role."),
        Rule("POP_REPORTING_PERIOD_MISMATCH", F.col("periods_differ"),
             "sources.reporting_period", message="Ba nguồn không cùng kỳ báo cáo."),
        Rule("POP_REPORTING_ORGANIZATION_MISMATCH", F.col("organizations_differ"),
             "sources.organization", message="Ba nguồn không cùng đơn vị tổng hợp."),
    ]


def merge_values(values: DataFrame) -> DataFrame:
    """(bundle_id, field, value, conflict): one value per field, unless two sources disagree."""
    return values.groupBy("bundle_id", "field").agg(
        F.max("value").alias("value"), (F.min("value") != F.max("value")).alias("conflict")
    )


def source_warnings(warnings: DataFrame) -> DataFrame:
    """(bundle_id, source_issues): what the sources of a bundle warned of, in the order of the sources.

    warnings: bundle_id, source_file_id, role, ord, code, field_path, message. A warning is told once per
    source and field, so a list holds at most the fields of the sources times the codes."""
    order = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    once = warnings.groupBy("bundle_id", "source_file_id", "role", "code", "field_path").agg(
        F.min("ord").alias("ord"), F.min_by("message", "ord").alias("message"))
    issue = F.struct("code", F.lit(WARNING).alias("severity"), "field_path", "message").cast(ISSUE)
    place = F.struct(order.alias("role"), "source_file_id", "ord", "code", "field_path", issue.alias("issue"))
    listed = once.groupBy("bundle_id").agg(F.array_sort(F.collect_list(place)).alias("w"))
    return listed.select("bundle_id", F.transform("w", lambda x: x["issue"]).alias("source_issues"))


def in_order(found: Column, warned: Column) -> Column:
    """Errors, then what the sources warned of, then the report's own warnings."""
    errors = F.filter(found, lambda i: i["severity"] == ERROR)
    others = F.filter(found, lambda i: i["severity"] != ERROR)
    return F.concat(errors, F.coalesce(warned, F.array().cast(f"array<{ISSUE}>")), others)


def standardize(sources: DataFrame, values: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row per bundle: canonical values, report id, checksum, issues and status.

    A bundle that fails the identity checks, has conflicting or missing inputs, gets no values and only
    the issues of that stage. Otherwise warnings of its sources (see `source_warnings`) stand between
    the errors and the warnings of the report, and one alone makes its status `needs_review`."""
    facts = bundle_facts(sources).withColumn("identity_issues", issues_of(identity_rules()))
    merged = merge_values(values)
    wide = merged.groupBy("bundle_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in INPUT_FIELDS],
        *[F.bool_or((F.col("field") == f) & F.col("conflict")).alias(f"_conflict_{f}")
          for f in INPUT_FIELDS],
    )
    joined = facts.join(wide, "bundle_id", "left")
    if warnings is not None:
        joined = joined.join(source_warnings(warnings), "bundle_id", "left")
    conflicts = [
        Rule("POP_CANONICAL_FIELD_CONFLICT", F.col(f"_conflict_{f}"), f,
             message=f"Hai nguồn cung cấp {f} với giá trị khác nhau.") for f in INPUT_FIELDS
    ]
    missing = [
        Rule("POP_REQUIRED_FIELD_MISSING", F.col(f).isNull(), f, message="Thiếu trường bắt buộc.")
        for f in INPUT_FIELDS
    ]
    # The first failing stage reports; later stages do not run.
    staged = joined.withColumns(
        {"_conflicts": issues_of(conflicts), "_missing": issues_of(missing)}
    )
    size = lambda c: F.size(c)
    blocking = (
        F.when(size("identity_issues") > 0, F.col("identity_issues"))
        .when(size("_conflicts") > 0, F.col("_conflicts"))
        .otherwise(F.col("_missing"))
    )
    staged = staged.withColumn("blocking", blocking)
    usable = size("blocking") == 0
    for closing, (plus, minus) in CLOSING.items():
        total = sum((F.col(f) for f in plus), F.lit(0)) - sum((F.col(f) for f in minus), F.lit(0))
        staged = staged.withColumn(closing, F.when(usable, total))
    staged = with_numbers(staged, CANONICAL_FIELDS)
    warned = F.col("source_issues") if warnings is not None else F.lit(None)
    found = in_order(issues_of(canonical_population_rules()), warned.cast(f"array<{ISSUE}>"))
    key = F.concat_ws(
        ":", F.lit("population-bundle"), F.col("organization_id"),
        F.col("period.start").cast("string"), F.col("period.end").cast("string"),
    )
    result = staged.withColumn("issues", F.when(usable, found).otherwise(F.col("blocking")))
    return result.select(
        "bundle_id",
        F.when(usable, uuid5(key)).alias("report_id"),
        "period", "organization_id", "organization_name", "classification",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        *[F.when(usable, F.col(f)).alias(f) for f in (*INPUT_FIELDS, *CLOSING)],
        "issues",
        status_of(F.col("issues")).alias("status"),
    )


def bundle_checksums(sources: DataFrame) -> DataFrame:
    """Combined checksum of complete bundles, over (role, sha256) in role order."""
    complete = sources.groupBy("bundle_id").agg(
        F.count("*").alias("n"),
        *[F.max(F.when(F.col("role") == r, F.col("sha256"))).alias(r) for r in ROLES],
    ).filter(F.col("n") == len(ROLES))
    parts = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("sha256")) for r in ROLES])
    return complete.select("bundle_id", combined_checksum(parts).alias("checksum"))


def closing_provenance(values: DataFrame) -> DataFrame:
    """(bundle_id, field, term, source_file_id): the sources behind each closing balance."""
    terms = [
        F.when(F.col("field").isin(*plus, *minus), F.lit(closing))
        for closing, (plus, minus) in CLOSING.items()
    ]
    named = values.select(
        "bundle_id", "source_file_id", F.col("field").alias("term"),
        F.explode(F.array_compact(F.array(*terms))).alias("field"),
    )
    return named.select("bundle_id", "field", "term", "source_file_id")


def source_records(sources: DataFrame, details: DataFrame) -> DataFrame:
    """Source rows and detail-count rows in one table."""
    rows = sources.select(
        F.lit("population_source").alias("record_type"), "bundle_id", "source_file_id",
        F.col("role").alias("source_role"), F.col("period.label").alias("reporting_period"),
        "organization_id", "organization_name",
    )
    counts = details.select(
        F.lit("population_detail_count").alias("record_type"), "bundle_id", "source_file_id",
        F.col("role").alias("source_role"), "field", "value",
    )
    return rows.unionByName(counts, allowMissingColumns=True)


def business_key_outcomes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """new and stored: (report_id, checksum) -> created, duplicate, or conflict."""
    known = stored.select("report_id", F.col("checksum").alias("stored_checksum"))
    same = F.col("checksum") == F.col("stored_checksum")
    outcome = (
        F.when(F.col("stored_checksum").isNull(), "created")
        .when(same, "duplicate")
        .otherwise("POP_BUSINESS_KEY_CONFLICT")
    )
    return new.join(known, "report_id", "left").select("report_id", "checksum", outcome.alias("outcome"))


def bundle_issues(standardized: DataFrame) -> DataFrame:
    return explode_issues(standardized, F.col("issues"), "bundle_id")


def persistable(standardized: DataFrame) -> DataFrame:
    """Reports without any error; only these are stored."""
    return standardized.filter(~F.exists("issues", lambda i: i["severity"] == ERROR))
