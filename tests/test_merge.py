import datetime as dt

from pyspark.sql import functions as F

from reportlake.operators import approvals, bundle, lineage, statuses

PERIOD = ("month", dt.date(2026, 6, 1), dt.date(2026, 6, 30), "Tháng 06/2026")
VALUES = {
    "OPENING_BALANCE": dict(population_opening=12430, temporary_opening=1120),
    "CIVIL_STATUS": dict(birth_registered=18, birth_local_resident=18, death_registered=7, death_local_resident=7),
    "RESIDENCE_MOVEMENT": dict(permanent_in=42, permanent_out=25, temporary_new=85, temporary_removed=31)}


def made(spark, values=VALUES):
    sources = spark.createDataFrame(
        [("b", f"{role}.xlsx", role, PERIOD, "o", "Xã", "SYNTHETIC_TEST_DATA", "0" * 64) for role in VALUES],
        "bundle_id string, source_file_id string, role string, period struct<kind: string, start: date, end: date, label: string>, "
        "organization_id string, organization_name string, classification string, sha256 string")
    rows = [("b", f"{role}.xlsx", role, f, v) for role, own in values.items() for f, v in own.items()]
    return sources, spark.createDataFrame(rows, "bundle_id string, source_file_id string, role string, field string, value bigint")


def warned(spark, *rows):
    return spark.createDataFrame(
        [("b", f"{role}.xlsx", role, n, code, None, "m") for role, n, code in rows],
        "bundle_id string, source_file_id string, role string, ord int, code string, field_path string, message string")


def test_source_warnings_stand_between_errors_and_warnings(spark):
    sources, values = made(spark, VALUES | {"CIVIL_STATUS": dict(
        birth_registered=18, birth_local_resident=20, death_registered=9, death_local_resident=7)})
    warnings = warned(spark, ("RESIDENCE_MOVEMENT", 1, "Z"), ("RESIDENCE_MOVEMENT", 0, "Y"), ("OPENING_BALANCE", 5, "X"), ("OPENING_BALANCE", 6, "X"))
    row = bundle.standardize(sources, values, warnings).first()
    codes = [i["code"] for i in row["issues"]]
    first, last = codes.index("X"), codes.index("Z")
    assert codes[first:last + 1] == ["X", "Y", "Z"]
    assert {i["severity"] for i in row["issues"][:first]} == {"error"} and row["status"] == "failed"
    assert {i["severity"] for i in row["issues"][first:]} == {"warning"} and last < len(codes) - 1


def test_one_source_warning_asks_for_review(spark):
    sources, values = made(spark)
    assert bundle.standardize(sources, values).first()["status"] == "validated"
    assert bundle.standardize(sources, values, warned(spark)).first()["status"] == "validated"
    row = bundle.standardize(sources, values, warned(spark, ("CIVIL_STATUS", 0, "X"))).first()
    assert row["status"] == "needs_review" and [i["code"] for i in row["issues"]] == ["X"]
    assert bundle.persistable(bundle.standardize(sources, values, warned(spark, ("CIVIL_STATUS", 0, "X")))).count() == 1


def test_source_warnings_of_a_refused_bundle_are_not_told(spark):
    sources, values = made(spark)
    row = bundle.standardize(sources.filter("role <> 'CIVIL_STATUS'"), values, warned(spark, ("OPENING_BALANCE", 0, "X"))).first()
    assert {i["code"] for i in row["issues"]} == {"POP_SOURCE_ROLE_MISSING", "POP_SOURCE_COUNT_INVALID"}


def origins(spark, *rows):
    return spark.createDataFrame(
        [("b", f"{role}.xlsx", f, n, "S1", row, "m", f) for role, f, n, row in rows],
        "bundle_id string, source_file_id string, field string, ord int, sheet string, row bigint, method string, evidence string")


def test_lineage_follows_the_winning_source(spark):
    both = VALUES | {"RESIDENCE_MOVEMENT": VALUES["RESIDENCE_MOVEMENT"] | {"population_opening": 12430}}
    sources, values = made(spark, both)
    given = origins(spark, ("OPENING_BALANCE", "population_opening", 0, 4), ("RESIDENCE_MOVEMENT", "population_opening", 0, 9),
                    ("RESIDENCE_MOVEMENT", "permanent_in", 0, 5), ("RESIDENCE_MOVEMENT", "permanent_in", 1, 6))
    found = lineage.value_provenance(bundle.standardize(sources, values), values, given)
    rows = {(r["field"], r["term"], r["term_no"], r["source_file_id"], r["row"]) for r in found.collect()}
    m = "RESIDENCE_MOVEMENT.xlsx"
    assert rows == {
        ("population_opening", "population_opening", 0, m, 9), ("permanent_in", "permanent_in", 0, m, 5), ("permanent_in", "permanent_in", 0, m, 6),
        ("population_closing", "population_opening", 0, m, 9), ("population_closing", "permanent_in", 2, m, 5), ("population_closing", "permanent_in", 2, m, 6)}
    sources, values = made(spark, VALUES | {"RESIDENCE_MOVEMENT": {"permanent_in": 42}})
    assert lineage.value_provenance(bundle.standardize(sources, values), values, given).count() == 0


def test_unknown_fields(spark):
    sources, values = made(spark)
    known = lineage.long_values(bundle.standardize(sources, values), (*bundle.INPUT_FIELDS, *bundle.CLOSING))
    assert known.count() == 12
    given = spark.createDataFrame([("b", "permanent_in"), ("b", "note"), ("b", "note"), ("c", "permanent_in")], "bundle_id string, field string")
    assert {tuple(r) for r in lineage.unknown_fields(given, known, "bundle_id").collect()} == {
        ("b", "note", "PROVENANCE_UNKNOWN_FIELD"), ("c", "permanent_in", "PROVENANCE_UNKNOWN_FIELD")}


def test_approvals_hold_for_their_time(spark):
    day = dt.date(2026, 6, 1)
    rows = [(1, "population", "OFFICIAL_CANDIDATE", day), (2, "population", "SYNTHETIC_TEST_DATA", day), (3, "tasks", "OFFICIAL_CANDIDATE", day),
            (4, "population", "OFFICIAL_CANDIDATE", None), (5, None, None, day), (6, "population", "OFFICIAL_CANDIDATE", dt.date(2026, 8, 1))]
    files = spark.createDataFrame(rows, "file_id int, domain string, classification string, period_start date")
    all_official = {1, 3, 4, 5, 6}
    assert {r["file_id"] for r in approvals.unapproved(files, "file_id").collect()} == all_official
    given = spark.createDataFrame(
        [("population", "OFFICIAL_CANDIDATE", dt.date(2026, 5, 1), dt.date(2026, 6, 1)), ("population", "OFFICIAL_CANDIDATE", None, dt.date(2026, 6, 30)),
         ("tasks", "OFFICIAL_CANDIDATE", dt.date(2026, 6, 2), None)], "domain string, classification string, valid_from date, valid_to date")
    found = approvals.unapproved(files, "file_id", given).collect()
    assert {r["file_id"] for r in found} == {3, 4, 5, 6} and {r["severity"] for r in found} == {"warning"}


def test_aliases_are_followed_to_their_end(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("a9", "X"), ("l1", "l2"), ("l2", "l3"), ("l3", "l2"), ("self", "self"), ("o", "nowhere"),
             ("twice", "X"), ("twice", "Y"), ("behind", "twice"), ("same", "Y"), ("same", "Y"), ("Y", "X"), (None, "X"), ("z", None)]
    aliases = spark.createDataFrame(links, "alias string, target string")
    done, issues = statuses.resolve_aliases(aliases, spark.createDataFrame([("X",), ("Y",)], "code string"))
    assert {tuple(r) for r in done.collect()} == {(f"a{i}", "X", 10 - i) for i in range(10)} | {("same", "Y", 1)}
    assert {tuple(r) for r in issues.collect()} == {
        ("l1", "ALIAS_CYCLE"), ("l2", "ALIAS_CYCLE"), ("l3", "ALIAS_CYCLE"), ("self", "ALIAS_CYCLE"), ("o", "ALIAS_UNKNOWN_TARGET"),
        ("twice", "ALIAS_AMBIGUOUS"), ("behind", "ALIAS_UNKNOWN_TARGET")}
    done, issues = statuses.resolve_aliases(aliases.limit(0), spark.createDataFrame([("X",)], "code string"))
    assert done.count() == issues.count() == 0


def test_statuses_and_what_they_ask(spark):
    d = dt.date
    rows = [(1, "  HOÀN THÀNH đúng hạn: ", d(2026, 1, 5), d(2026, 1, 5), "x"), (2, "completed", d(2026, 1, 5), d(2026, 1, 6), " "),
            (3, "delayed", d(2026, 1, 5), None, None), (4, "delayed", d(2026, 1, 5), d(2026, 1, 9), "x"), (5, "completed", None, None, None),
            (6, "in_progress", None, d(2026, 1, 1), None), (7, None, None, None, None), (8, "COMPLETED_LATE", d(2026, 1, 5), None, None), (9, "xong", d(2026, 1, 5), d(2026, 1, 5), "x")]
    tasks = spark.createDataFrame(rows, "id int, status string, due_date date, completion_date date, completion_result string")
    aliases = spark.createDataFrame([("Xong", "Rồi"), ("rồi", "completed")], "alias string, target string")
    found = {r["id"]: (r["status_code"], [i["code"].removeprefix("TASK_STATUS_") for i in r["issues"]])
             for r in statuses.status_issues(statuses.with_status(tasks, aliases)).collect()}
    assert found == {
        1: ("COMPLETED_ON_TIME", []), 2: ("COMPLETED_LATE", ["REQUIRES_COMPLETION_RESULT"]), 3: ("OVERDUE", []), 4: ("COMPLETED_LATE", []),
        5: (None, ["UNKNOWN"]), 6: ("IN_PROGRESS", ["EXCLUDES_COMPLETION_DATE"]), 7: (None, []),
        8: ("COMPLETED_LATE", ["REQUIRES_COMPLETION_DATE", "REQUIRES_COMPLETION_RESULT"]), 9: ("COMPLETED_ON_TIME", [])}
    assert statuses.with_status(tasks).filter(F.col("id") == 9).first()["status_code"] is None


def test_alias_rounds_follow_the_longest_chain(spark, monkeypatch):
    """A thousand names in chains of nine, and a cycle with a name behind it: as many rounds as a chain of
    nine takes, not as many as a thousand names could."""
    from reportlake.operators import statuses

    rounds, keep = [], statuses.materialize
    monkeypatch.setattr(statuses, "materialize", lambda df, **o: rounds.append(1) or keep(df, **o))
    links = [(f"n{i}", "end" if i % 9 == 0 else f"n{i - 1}") for i in range(999)]
    links += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "nowhere")]
    done, issues = statuses.resolve_aliases(
        spark.createDataFrame(links, "alias string, target string"), spark.createDataFrame([("end",)], "code string"))
    assert len(rounds) <= 1 + 6
    assert {(r["alias"], r["code"], r["steps"]) for r in done.collect()} == {(f"n{i}", "end", i % 9 + 1) for i in range(999)}
    assert {(r["alias"], r["issue"]) for r in issues.collect()} == {
        *[(n, "ALIAS_CYCLE") for n in "abcd"], ("e", "ALIAS_UNKNOWN_TARGET")}
