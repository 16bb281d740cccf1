import pytest
from pyspark.sql import functions as F

from reportlake.operators import bundle, extract, kpi, reporting, rules
from reportlake.operators.rules import Definition, Operand

BASE = dict(
    population_opening=12430, population_closing=12458, birth_registered=20, birth_local_resident=18,
    death_registered=8, death_local_resident=7, permanent_in=42, permanent_out=25,
    temporary_opening=1120, temporary_new=85, temporary_removed=31, temporary_closing=1174)


def canonical(spark, **changes):
    values = BASE | changes
    schema = "report_id string, classification string, " + ", ".join(f"{k} bigint" for k in values)
    return spark.createDataFrame([("r", "SYNTHETIC_TEST_DATA", *values.values())], schema)


@pytest.mark.parametrize(
    ("changes", "codes"),
    [
        ({"birth_local_resident": 20, "death_local_resident": 8, "population_closing": 12459}, set()),
        ({}, {"POP_BIRTH_REGISTRATION_SCOPE_DIFFERS", "POP_DEATH_REGISTRATION_SCOPE_DIFFERS"}),
        ({"permanent_in": None}, {"POP_REQUIRED_FIELD_MISSING", "POP_BIRTH_REGISTRATION_SCOPE_DIFFERS",
                                  "POP_DEATH_REGISTRATION_SCOPE_DIFFERS"}),
        ({"temporary_new": -1}, {"POP_NEGATIVE_VALUE", "POP_TEMPORARY_BALANCE_MISMATCH",
                                 "POP_BIRTH_REGISTRATION_SCOPE_DIFFERS", "POP_DEATH_REGISTRATION_SCOPE_DIFFERS"}),
        ({"birth_local_resident": 21}, {"POP_BIRTH_LOCAL_EXCEEDS_REGISTERED", "POP_CANONICAL_BALANCE_MISMATCH",
                                        "POP_DEATH_REGISTRATION_SCOPE_DIFFERS"}),
    ])
def test_canonical_rules(spark, changes, codes):
    row = rules.validate_population(canonical(spark, **changes)).first()
    assert {i["code"] for i in row["issues"]} == codes


def test_gate_and_status(spark):
    official = canonical(spark).withColumn("classification", F.lit("OFFICIAL_CANDIDATE"))
    row = rules.validate_population(official).first()
    assert [i["code"] for i in row["issues"]] == ["OFFICIAL_RULES_UNAVAILABLE"]
    assert row["status"] == "needs_review"
    before = canonical(spark)
    after = rules.validate_population(before).select(before.columns)
    assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_text_values_are_read_leniently(spark):
    text = canonical(spark).select(
        "report_id", "classification", *[F.col(f).cast("string").alias(f) for f in BASE])
    broken = text.withColumn("permanent_in", F.lit("không rõ"))
    assert "POP_REQUIRED_FIELD_MISSING" in {
        i["code"] for i in rules.validate_population(broken).first()["issues"]}


def test_tasks_and_definitions(spark):
    task = spark.sql("""select 'NV-1' as task_id, '' as lead_unit, '120' as progress_percent, date'2026-01-05' as assignment_date,
        date'2026-01-03' as completion_date, date'2026-01-02' as due_date, 'Hoàn thành' as status, '' as completion_result""")
    found = rules.validate_tasks(task, F.lit("2026-01-31").cast("date")).first()["issues"]
    assert {i["code"] for i in found} == {
        "TASK_LEAD_UNIT_REQUIRED", "TASK_PROGRESS_RANGE", "TASK_COMPLETION_BEFORE_ASSIGNMENT",
        "TASK_RESULT_REQUIRED", "TASK_COMPLETED_LATE_STATUS"}
    reports = spark.sql("""select 'r' as report_id, 'SYNTHETIC_TEST_DATA' as classification,
        map('alpha', '20', 'beta', '15') as values
        union all select 'o', 'OFFICIAL_CANDIDATE', map('alpha', '20', 'beta', '15')""")
    definitions = [
        Definition("diff", "subtract", Operand("alpha"), Operand("beta")),
        Definition("zero", "divide", Operand("alpha"), Operand(constant=0)),
        Definition("ok", "greater_or_equal", Operand("alpha"), Operand("beta"), production_approved=True)]
    values = {(r["report_id"], r["kpi_id"]): (r["value"], r["issue"])
              for r in rules.evaluate_kpis(reports, definitions[:2]).collect()}
    assert values["r", "diff"] == (5, None)
    assert values["r", "zero"] == (None, "ZERO_DENOMINATOR")
    assert values["o", "diff"] == (None, "DEFINITION_NOT_APPROVED")
    assert rules.evaluate_rules(reports, definitions[2:]).count() == 0
    with pytest.raises(ValueError):
        Operand()


def test_kpis(spark):
    rows = {r["kpi_id"]: r["value"] for r in kpi.catalogue_kpis(canonical(spark), "population").collect()}
    assert rows["population_net_change"] == 28
    assert float(rows["population_change_rate_percent"]) == pytest.approx(28 * 100 / 12430)
    assert rows["birth_registered_outside_local_residence"] == 2
    empty = spark.sql("select 'r' as report_id, 'SYNTHETIC_TEST_DATA' as classification, 0L as received_cases, 1L as resolved_cases")
    assert kpi.catalogue_kpis(empty, "complaints").first()["issue"] == "ZERO_DENOMINATOR"
    assert kpi.rendered(kpi.catalogue_kpis(canonical(spark), "population")).first()["value"] == "28"


CELLS = "file_id string, domain string, sheet_no int, sheet string, row int, col int, value string"


def grid(spark, domain, rows, file_id="f"):
    return spark.createDataFrame(
        [(file_id, domain, 1, "S", r, c, v) for r, row in enumerate(rows, 1) for c, v in enumerate(row)], CELLS)


def test_fields_and_records(spark):
    cells = grid(spark, "population", [["Tổng dân số", "18.621 người"], ["NỮ:", "9.000"], ["Nam", ""], ["nam ", "7"]])
    found = {r["field"]: r["value_num"] for r in extract.map_fields(cells).collect()}
    assert found == {"population_total": 18621, "female": 9000, "male": 7}
    rows = [["Tổng số nhiệm vụ", "18", None], ["Mã", "Nội dung nhiệm vụ", "Ngày giao"], ["x", "y", None],
            ["NV-1", "A", "05/01/2026"], ["nv-2", "B", None], ["Cộng", "", ""], ["NV-3", "C", None],
            ["Quá hạn chưa hoàn thành", "4", None]]
    cells = grid(spark, "tasks", rows)
    records = extract.task_records(cells).orderBy("row").collect()
    assert [r["task_id"] for r in records] == ["NV-1", "nv-2"]
    assert str(records[0]["assignment_date"]) == "2026-01-05"
    assert [r["field"] for r in extract.map_fields(cells).collect()] == ["task_total"]


def test_roles(spark):
    codes = [[f, "x", "1"] for f in extract.ROLE_FIELDS["CIVIL_STATUS"]]
    both = codes + [[f, "x", "1"] for f in extract.ROLE_FIELDS["OPENING_BALANCE"]]
    cells = grid(spark, "population", codes).unionByName(grid(spark, "population", both, "g"))
    found = {r["file_id"]: (r["role"], r["issue"]) for r in extract.detect_roles(cells).collect()}
    assert found == {"f": ("CIVIL_STATUS", None), "g": (None, "POP_SOURCE_ROLE_UNDETERMINED")}
    expected = spark.createDataFrame([("f", "OPENING_BALANCE")], "file_id string, role string")
    assert extract.role_mismatches(extract.detect_roles(cells), expected).count() == 1


def bundle_tables(spark, roles=("OPENING_BALANCE", "CIVIL_STATUS", "RESIDENCE_MOVEMENT"), extra=()):
    sources = spark.createDataFrame(
        [("b", f"f{i}", r, ("month", None, None, "m"), "org", "Xã", "SYNTHETIC_TEST_DATA", "aa")
         for i, r in enumerate(roles)],
        "bundle_id string, source_file_id string, role string, period struct<kind:string,start:date,end:date,label:string>, "
        "organization_id string, organization_name string, classification string, sha256 string")
    rows = [("b", f"f{i}", r, f, BASE[f]) for i, r in enumerate(roles) for f in extract.ROLE_FIELDS[r]]
    values = spark.createDataFrame(
        rows + [("b", "f9", "x", f, v) for f, v in extra],
        "bundle_id string, source_file_id string, role string, field string, value long")
    return sources, values


def test_bundle(spark):
    row = bundle.standardize(*bundle_tables(spark)).first()
    assert (row["population_closing"], row["temporary_closing"]) == (12458, 1174)
    assert {i["code"] for i in row["issues"]} == {
        "POP_BIRTH_REGISTRATION_SCOPE_DIFFERS", "POP_DEATH_REGISTRATION_SCOPE_DIFFERS"}
    assert row["status"] == "needs_review"
    conflict = bundle.standardize(*bundle_tables(spark, extra=[("population_opening", 999)])).first()
    assert [i["code"] for i in conflict["issues"]] == ["POP_CANONICAL_FIELD_CONFLICT"]
    assert conflict["population_closing"] is None
    missing = bundle.standardize(*bundle_tables(spark, roles=("OPENING_BALANCE", "OPENING_BALANCE"))).first()
    assert [i["code"] for i in missing["issues"]] == [
        "POP_SOURCE_ROLE_DUPLICATE", "POP_SOURCE_ROLE_MISSING", "POP_SOURCE_ROLE_MISSING", "POP_SOURCE_COUNT_INVALID"]
    terms = bundle.closing_provenance(bundle_tables(spark)[1])
    assert terms.filter("field = 'temporary_closing'").count() == 3


def test_evidence(spark):
    drafts = spark.createDataFrame([("d", True)], "report_id string, human_review_required boolean")
    allowed = spark.createDataFrame([("d", "SOURCE_1")], "report_id string, source_id string")
    cite = lambda s: spark.createDataFrame([("d", "sections[0]", s)], "report_id string, location string, source_id string")
    ref = lambda v: spark.createDataFrame([("d", "sections[0]", "metric_alpha", v)], "report_id string, location string, field_name string, value string")
    values = spark.createDataFrame([("d", "metric_alpha", "20.0")], "report_id string, field_name string, source_value string")
    assert reporting.evidence_issues(drafts, cite("SOURCE_1"), allowed, ref("20"), values).count() == 0
    bad = reporting.evidence_issues(drafts, cite("SOURCE_99"), allowed, ref("999"), values)
    assert {r["code"] for r in bad.collect()} == {"unsupported_citation", "numeric_source_mismatch"}


def test_empty_reports_have_a_no_issue_line(spark):
    report = spark.sql(f"""select 'r' as report_id, 'population' as domain, 'SYNTHETIC_TEST_DATA' as classification, 'p' as period_label,
        'u' as organization_name, map('permanent_in', '4', 'x', null) as values, cast(array() as array<{rules.ISSUE}>) as issues""")
    lines = reporting.report_lines(report).collect()
    assert [r["value"] for r in lines if r["section"] == "issues"] == [reporting.NO_ISSUES]
    assert [(r["label"], r["value"]) for r in lines if r["section"] == "values"] == [
        ("Đăng ký thường trú đến", "4"), ("x", "")]


def test_text_in_a_required_field_is_no_missing_field(spark):
    report = spark.sql("""select 'r' as report_id, 'SYNTHETIC_TEST_DATA' as classification, 'không rõ' as received_cases,
        cast(null as string) as resolved_cases""")
    missing = {i["field_path"] for i in rules.validate_complaints(report).first()["issues"]
               if i["code"] == "REQUIRED_FIELD_MISSING"}
    assert "received_cases" not in missing and "resolved_cases" in missing


def test_official_tasks_get_one_warning(spark):
    task = spark.sql("""select 'NV-1' as task_id, '' as lead_unit, '120' as progress_percent, date'2026-01-05' as assignment_date,
        cast(null as date) as completion_date, date'2026-01-02' as due_date, '' as status, '' as completion_result,
        'OFFICIAL_CANDIDATE' as classification""")
    found = rules.validate_tasks(task, F.lit("2026-01-31").cast("date")).first()["issues"]
    assert [i["code"] for i in found] == ["OFFICIAL_RULES_UNAVAILABLE"]


def test_large_results_are_kept_or_reported(spark):
    row = spark.sql("""select 'r' as report_id, 'SYNTHETIC_TEST_DATA' as classification,
        map('a', '12345678901234567890', 'b', '1', 'c', '9999999999999999999999999999', 'd', '0.5') as values""")
    of = lambda name, op, x, y: Definition(name, op, Operand(x), Operand(y))
    found = rules.evaluate_kpis(row, [
        of("sum", "add", "a", "b"), of("less", "subtract", "b", "a"), of("beyond", "multiply", "c", "c"), of("half", "multiply", "b", "d")])
    got = {r["kpi_id"]: (r["value"] and str(r["value"].normalize()), r["issue"]) for r in found.collect()}
    assert got == {"sum": ("12345678901234567891", None), "less": ("-12345678901234567889", None),
                   "beyond": (None, "RESULT_OUT_OF_RANGE"), "half": ("0.5", None)}
