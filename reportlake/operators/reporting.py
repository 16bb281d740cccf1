"""Draft reports: lines, payloads, template filling, evidence checks and review."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.scalars import to_decimal
from reportlake.functions.text import placeholders
from reportlake.settings import SYNTHETIC

# Labels and sentences of the draft.
POPULATION_LABELS = {
    "population_opening": "Dân số thường trú đầu kỳ",
    "population_closing": "Dân số thường trú cuối kỳ",
    "birth_registered": "Tổng khai sinh đăng ký",
    "birth_local_resident": "Khai sinh thuộc dân cư thường trú của xã",
    "death_registered": "Tổng khai tử đăng ký",
    "death_local_resident": "Khai tử thuộc dân cư thường trú của xã",
    "permanent_in": "Đăng ký thường trú đến",
    "permanent_out": "Xóa/chuyển thường trú đi",
    "temporary_opening": "Người tạm trú đầu kỳ",
    "temporary_new": "Đăng ký tạm trú mới",
    "temporary_removed": "Xóa/hết tạm trú",
    "temporary_closing": "Người tạm trú cuối kỳ",
}
TITLE = "BÁO CÁO NHÁP – CẦN KIỂM TRA"
MARK = "SYNTHETIC_TEST_DATA · NOT_OFFICIAL"
NO_ISSUES = "Không phát hiện lỗi theo bộ quy tắc thử nghiệm đã mã hóa."
CLOSING_NOTE = (
    "Báo cáo này chưa tương thích được xác nhận với biểu mẫu chính thức "
    "và phải được người có thẩm quyền kiểm tra."
)
HEADER_LABELS = (
    ("Lĩnh vực", "domain"), ("Kỳ báo cáo", "period_label"), ("Đơn vị", "organization_name"),
    ("Nguồn dữ liệu vận hành", "report_id"),
)
DECISIONS = ("approved", "rejected")


def field_label(domain: Column, field: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in POPULATION_LABELS.items() for x in pair])
    return F.when(domain == "population", F.coalesce(labels[field], field)).otherwise(field)


def report_lines(reports: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Draft of each synthetic report as lines (report_id, section, ord, item, label, value).

    reports: report_id, domain, classification, period_label, organization_name, values (map of
    field to text), issues (array of struct). records: (report_id, record_no, fields map) in long
    form, because a report may have any number of them. Without a label the period's start is shown,
    where there is such a column. Official reports have no draft."""
    drafted = reports.filter(F.col("classification") == SYNTHETIC)
    line = lambda section, ord_, label, value: F.struct(
        F.lit(section).alias("section"), ord_.cast("int").alias("ord"),
        label.cast("string").alias("label"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    header = [line("header", F.lit(0), none, F.lit(TITLE)), line("header", F.lit(1), none, F.lit(MARK))]
    shown = {c: F.col(c) for _, c in HEADER_LABELS}
    if "period_start" in reports.columns:
        period = F.nullif(F.col("period_label"), F.lit(""))
        shown["period_label"] = F.coalesce(period, F.col("period_start").cast("string"))
    header += [
        line("header", F.lit(i), F.lit(label), shown[c])
        for i, (label, c) in enumerate(HEADER_LABELS, 2)
    ]
    values = F.transform(
        F.map_entries("values"),
        lambda e, i: line("values", i, field_label(F.col("domain"), e["key"]),
                          F.coalesce(e["value"], F.lit(""))))
    shown = F.transform(
        "issues",
        lambda x, i: line("issues", i, x["code"], F.concat(
            F.lit("["), x["severity"], F.lit("] "), x["code"], F.lit(": "), x["message"])))
    none_found = F.array(line("issues", F.lit(0), none, F.lit(NO_ISSUES)))
    checks = F.when(F.size("issues") > 0, shown).otherwise(none_found)
    note = F.array(line("closing", F.lit(0), none, F.lit(CLOSING_NOTE)))
    lines = drafted.select(
        "report_id", F.explode(F.concat(F.array(*header), values, checks, note)).alias("l"))
    result = lines.select(
        "report_id", "l.section", "l.ord", F.lit(None).cast("bigint").alias("item"), "l.label", "l.value")
    if records is None:
        return result
    return result.unionByName(_record_lines(drafted, records))


def _record_lines(drafted: DataFrame, records: DataFrame) -> DataFrame:
    """A cell per record and header; headers are the report's keys by first appearance."""
    mine = records.join(drafted.select("report_id"), "report_id", "left_semi")
    cells = mine.select("report_id", "record_no", F.posexplode(F.map_entries("fields")).alias("i", "e"))
    headers = (
        cells.groupBy("report_id", F.col("e.key").alias("label"))
        .agg(F.min(F.struct("record_no", "i")).alias("seen"))
    )
    ordered = headers.groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.struct("seen", "label"))).alias("headers"))
    rows = mine.join(ordered, "report_id").select(
        "report_id", F.col("record_no").alias("item"), "fields", F.posexplode("headers").alias("ord", "h"))
    return rows.select(
        "report_id", F.lit("records").alias("section"), F.col("ord").cast("int").alias("ord"),
        F.col("item").cast("bigint").alias("item"), F.col("h.label").alias("label"),
        F.coalesce(F.try_element_at(F.col("fields"), F.col("h.label")), F.lit("")).alias("value"))


def numeric_values_valid(values: DataFrame) -> DataFrame:
    """(report_id, numeric_sources_valid) over long values (report_id, kind, value_text)."""
    number = F.col("kind").isin("integer", "decimal")
    valid = ~number | F.col("value_text").isNull() | to_decimal(F.col("value_text")).isNotNull()
    return values.groupBy("report_id").agg(F.bool_and(valid).alias("numeric_sources_valid"))


def report_payload(reports: DataFrame) -> Column:
    """A stored report as JSON text."""
    return F.to_json(F.struct(
        "report_id", "domain", "classification", "original_filename", "processing_status",
        F.struct(F.col("period_kind").alias("kind"), F.col("period_start").alias("start"),
                 F.col("period_end").alias("end"), F.col("period_label").alias("label")
                 ).alias("reporting_period"),
        F.struct("organization_id", "organization_name").alias("organization"),
        *[c for c in ("values", "records", "provenance", "issues", "created_at") if c in reports.columns],
    ), {"ignoreNullFields": "false"})


def bundle_view(standardized: DataFrame, canonical: list[str], calculated: list[str]) -> DataFrame:
    """Response of a bundle: canonical and calculated values, validity, status."""
    return standardized.select(
        "bundle_id", "report_id",
        F.struct(*canonical).alias("canonical_values"),
        F.struct(*calculated).alias("calculated_values"),
        (~F.exists("issues", lambda i: i["severity"] == "error")).alias("valid"),
        "status", "issues",
    )


def population_source_rows(records: DataFrame) -> DataFrame:
    return records.filter("record_type = 'population_source'")


def fill_template(text: Column, replacements: Column) -> Column:
    """Replace `{{name}}` and `{{ name }}` by the entries of a map, in map order."""
    return F.aggregate(
        F.map_entries(replacements), text,
        lambda t, e: F.replace(
            F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]),
            F.concat(F.lit("{{ "), e["key"], F.lit(" }}")), e["value"]))


# --- checks -------------------------------------------------------------------------------------


def missing_placeholders(templates: DataFrame) -> DataFrame:
    """templates (template_id, text, required) -> a row per required name the text lacks."""
    absent = F.array_sort(F.array_except("required", placeholders(F.col("text"))))
    return templates.select("template_id", F.explode(absent).alias("location")).select(
        "template_id", F.lit("missing_placeholder").alias("code"), "location")


def unsupported_citations(citations: DataFrame, allowed: DataFrame) -> DataFrame:
    """citations (report_id, location, source_id) that are not allowed (report_id, source_id)."""
    return citations.join(allowed, ["report_id", "source_id"], "left_anti").select(
        "report_id", F.lit("unsupported_citation").alias("code"), "location",
        F.concat(F.lit("Source was not retrieved: "), "source_id").alias("message"))


def numeric_mismatches(references: DataFrame, values: DataFrame) -> DataFrame:
    """references (report_id, location, field_name, value) against report values
    (report_id, field_name, source_value): missing, not numeric or different."""
    joined = references.join(values, ["report_id", "field_name"], "left")
    equal = to_decimal(F.col("source_value")) == to_decimal(F.col("value"))
    return joined.filter(~F.coalesce(equal, F.lit(False))).select(
        "report_id", F.lit("numeric_source_mismatch").alias("code"), "location",
        F.concat(F.lit("Value does not match operational field: "), "field_name").alias("message"))


def review_required(drafts: DataFrame) -> DataFrame:
    return drafts.filter(~F.col("human_review_required")).select(
        "report_id", F.lit("human_review_required").alias("code"),
        F.lit(None).cast("string").alias("location"),
        F.lit("Report publication requires human review.").alias("message"))


def evidence_issues(drafts, citations, allowed, references, values) -> DataFrame:
    return (
        unsupported_citations(citations, allowed)
        .unionByName(numeric_mismatches(references, values))
        .unionByName(review_required(drafts))
    )


def duplicate_templates(templates: DataFrame) -> DataFrame:
    return templates.groupBy("template_id").agg(F.count("*").alias("n")).filter("n > 1")


def review_decisions(events: DataFrame) -> DataFrame:
    """events (report_id, ts, seq, status, reviewer): the first approval or rejection of a report
    is applied, later ones are conflicts, other states are invalid."""
    decision = F.col("status").isin(*DECISIONS)
    first = events.filter(decision).groupBy("report_id").agg(
        F.min(F.struct("ts", "seq")).alias("first"))
    joined = events.join(first, "report_id", "left")
    outcome = (
        F.when(~decision, "invalid")
        .when(F.struct("ts", "seq") == F.col("first"), "applied")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("first")


def review_states(reports: DataFrame, events: DataFrame) -> DataFrame:
    """Current status per report: needs_review until the first valid decision."""
    decision = F.when(F.col("status").isin(*DECISIONS), F.struct("ts", "seq"))
    first = events.groupBy("report_id").agg(
        F.min_by(F.struct("status", "reviewer", "ts"), decision).alias("d"))
    return reports.select("report_id").join(first, "report_id", "left").select(
        "report_id", F.coalesce(F.col("d.status"), F.lit("needs_review")).alias("status"),
        F.col("d.reviewer").alias("reviewed_by"), F.col("d.ts").alias("reviewed_at"))


def orphan_reports(generated: DataFrame, operational: DataFrame) -> DataFrame:
    """Generated reports whose operational report does not exist."""
    known = operational.select(F.col("report_id").alias("operational_report_id"))
    return generated.join(known, "operational_report_id", "left_anti")


def report_lookup(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """Requests with the report they name; schema and rule set follow from its field names."""
    canonical = (F.col("domain") == "population") & F.map_contains_key("values", F.lit("population_opening"))
    canonical = F.coalesce(canonical, F.lit(False))
    found = requests.join(reports, "report_id", "left")
    exists = F.col("domain").isNotNull()
    return found.withColumns({
        "success": exists,
        "population_schema": F.when(exists & canonical, "population-canonical-v1").when(
            exists, "legacy-compatible"),
        "ruleset": F.when(exists & canonical, "POPULATION_CANONICAL_DETERMINISTIC_V1").when(
            exists, "SYNTHETIC_NON_PRODUCTION_RULE"),
    })


def official_data_conflicts(results: DataFrame) -> DataFrame:
    """results (request_id, step, data as text): the first official data of a request stays; a
    different later one is refused and flags the request."""
    kept = results.groupBy("request_id").agg(
        F.min_by("data", "step").alias("operational_data"),
        (F.min("data") != F.max("data")).alias("human_review_required"))
    warning = F.when(F.col("human_review_required"), F.lit("official_data_overwrite_rejected"))
    return kept.withColumn("warning", warning)
