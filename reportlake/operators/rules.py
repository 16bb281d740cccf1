"""Validation rules as data: each rule is a condition that raises one issue.

All rules of a report are evaluated in one projection; no rule costs a shuffle or a join."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.scalars import to_decimal
from reportlake.settings import SYNTHETIC

ERROR, WARNING = "error", "warning"
ISSUE = "struct<code:string,severity:string,field_path:string,message:string>"

# Field lists of the report kinds.
CANONICAL_FIELDS = (
    "population_opening", "population_closing", "birth_registered", "birth_local_resident",
    "death_registered", "death_local_resident", "permanent_in", "permanent_out",
    "temporary_opening", "temporary_new", "temporary_removed", "temporary_closing",
)
LEGACY_POPULATION_FIELDS = (
    "population_start", "arrivals", "departures", "births", "deaths", "population_total",
    "male", "female", "permanent", "temporary",
)
COMPLAINT_FIELDS = (
    "received_cases", "complaint_cases", "denunciation_cases", "petition_cases",
    "within_authority", "outside_authority", "resolved_cases",
)
COMPLAINT_BALANCE = ("beginning_cases", "ending_cases")


@dataclass(frozen=True)
class Rule:
    code: str
    condition: Column
    field: str | Column | None = None
    severity: str = ERROR
    message: str = ""


def issue(rule: Rule) -> Column:
    path = rule.field if isinstance(rule.field, Column) else F.lit(rule.field)
    return F.when(
        rule.condition,
        F.struct(
            F.lit(rule.code).alias("code"),
            F.lit(rule.severity).alias("severity"),
            path.cast("string").alias("field_path"),
            F.lit(rule.message).alias("message"),
        ).cast(ISSUE),
    )


def issues_of(rules: Iterable[Rule]) -> Column:
    """Array of raised issues in rule order; a condition that is null raises nothing."""
    return F.filter(F.array(*[issue(rule) for rule in rules]), lambda i: i.isNotNull())


def explode_issues(df: DataFrame, issues: Column, *keys: str) -> DataFrame:
    raised = df.select(*keys, F.posexplode(issues).alias("ord", "issue"))
    return raised.select(*keys, "ord", "issue.*")


def status_of(issues: Column) -> Column:
    """failed with any error, else needs_review with any warning, else validated."""
    has = lambda level: F.exists(issues, lambda i: i["severity"] == level)
    return (
        F.when(has(ERROR), F.lit("failed"))
        .when(has(WARNING), F.lit("needs_review"))
        .otherwise(F.lit("validated"))
    )


def status_rollup(reports: DataFrame, issues: DataFrame, key: str = "report_id") -> DataFrame:
    """The same roll-up over a long issue table; reports without issues are validated."""
    worst = issues.groupBy(key).agg(
        F.max(F.when(F.col("severity") == ERROR, 2).when(F.col("severity") == WARNING, 1)).alias("w")
    )
    status = F.when(F.col("w") == 2, "failed").when(F.col("w") == 1, "needs_review")
    return reports.join(worst, key, "left").select(
        key, F.coalesce(status, F.lit("validated")).alias("status")
    )


def with_numbers(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Fields as numbers under `_n_<field>`, and under `_null_<field>` whether they hold nothing at
    all; a field the table lacks is missing everywhere.

    Integers and decimals are taken as they are, text is parsed once per row."""
    types = dict(df.dtypes)

    def number(field: str) -> Column:
        kind = types.get(field)
        if kind is None:
            return F.lit(None).cast("bigint")
        exact = kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal")
        return F.col(field) if exact else to_decimal(F.col(field))

    absent = lambda f: F.col(f).isNull() if f in types else F.lit(True)
    fields = list(fields)
    return df.withColumns({f"_n_{f}": number(f) for f in fields} | {f"_null_{f}": absent(f) for f in fields})


def without_numbers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_n_", "_null_"))])


class _Numbers(dict):
    def __missing__(self, field: str) -> Column:
        return F.col(f"_n_{field}")


def _total(v: dict[str, Column], plus: tuple[str, ...], minus: tuple[str, ...] = ()) -> Column:
    total = v[plus[0]]
    for name in plus[1:]:
        total = total + v[name]
    for name in minus:
        total = total - v[name]
    return total


def _required(missing, fields, code: str) -> list[Rule]:
    """A rule per field; `missing` says of a field whether it is."""
    return [Rule(code, missing(f), f, message="Thiếu trường bắt buộc.") for f in fields]


def _no_number(field: str) -> Column:
    return F.col(f"_n_{field}").isNull()


def _no_value(field: str) -> Column:
    """Null as read: text that is no number is a value too."""
    return F.col(f"_null_{field}")


def canonical_population_rules() -> list[Rule]:
    v = _Numbers()
    rules = []
    for f in CANONICAL_FIELDS:
        rules += _required(_no_number, [f], "POP_REQUIRED_FIELD_MISSING")
        rules.append(
            Rule("POP_NEGATIVE_VALUE", v[f] < 0, f,
                 message="Chỉ tiêu phải là số nguyên không âm.")
        )
    for event, kind in (("birth", "khai sinh"), ("death", "khai tử")):
        local, registered = v[f"{event}_local_resident"], v[f"{event}_registered"]
        name = f"POP_{event.upper()}"
        field = f"{event}_local_resident"
        rules += [
            Rule(f"{name}_LOCAL_EXCEEDS_REGISTERED", local > registered, field,
                 message=f"{kind.capitalize()} thuộc dân cư thường trú không được lớn hơn "
                         f"tổng {kind} đăng ký."),
            Rule(f"{name}_REGISTRATION_SCOPE_DIFFERS", local < registered, field, WARNING,
                 f"Tổng {kind} đăng ký khác số thuộc dân cư thường trú của xã."),
        ]
    closing = _total(v, ("population_opening", "birth_local_resident", "permanent_in"),
                     ("death_local_resident", "permanent_out"))
    temporary = _total(v, ("temporary_opening", "temporary_new"), ("temporary_removed",))
    rules += [
        Rule("POP_CANONICAL_BALANCE_MISMATCH", closing != v["population_closing"],
             "population_closing",
             message="Dân số thường trú cuối kỳ không khớp công thức canonical."),
        Rule("POP_TEMPORARY_BALANCE_MISMATCH", temporary != v["temporary_closing"],
             "temporary_closing",
             message="Số người tạm trú cuối kỳ không khớp công thức canonical."),
    ]
    return rules


def legacy_population_rules() -> list[Rule]:
    v = _Numbers()
    expected = _total(v, ("population_start", "arrivals", "births"), ("departures", "deaths"))
    parts = "Tổng thành phần không khớp dân số cuối kỳ."
    total = v["population_total"]
    return _required(_no_value, LEGACY_POPULATION_FIELDS, "REQUIRED_FIELD_MISSING") + [
        Rule("POP_BALANCE_MISMATCH", expected != total, "population_total",
             message="Dân số cuối kỳ không khớp biến động."),
        Rule("POP_GENDER_TOTAL_MISMATCH", v["male"] + v["female"] != total,
             "population_total", message=parts),
        Rule("POP_RESIDENCE_TOTAL_MISMATCH", v["permanent"] + v["temporary"] != total,
             "population_total", message=parts),
    ]


def complaint_rules() -> list[Rule]:
    v = _Numbers()
    parts = "Tổng phân loại không khớp số đơn tiếp nhận."
    received = v["received_cases"]
    types = _total(v, ("complaint_cases", "denunciation_cases", "petition_cases"))
    authority = _total(v, ("within_authority", "outside_authority"))
    left = _total(v, ("beginning_cases", "received_cases"), ("resolved_cases",))
    return _required(_no_value, COMPLAINT_FIELDS, "REQUIRED_FIELD_MISSING") + [
        Rule("COM_TYPE_TOTAL_MISMATCH", types != received, "received_cases", message=parts),
        Rule("COM_AUTHORITY_TOTAL_MISMATCH", authority != received, "received_cases",
             message=parts),
        Rule("COM_BALANCE_MISMATCH", left != v["ending_cases"], "ending_cases",
             message="Đơn tồn cuối kỳ không khớp."),
    ]


def validate_tasks(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Task records with `issues`; `as_of` is the end of their reporting period.

    Where the records tell the `classification` of their report, only synthetic ones are judged;
    the others carry the one warning that no official rules are there."""
    rules = task_rules(as_of)
    if "classification" in tasks.columns:
        rules = official_gate(rules, F.col("classification"))
    judged = with_numbers(tasks, ["progress_percent"]).withColumn("issues", issues_of(rules))
    return without_numbers(judged)


def task_rules(as_of: Column) -> list[Rule]:
    """Rules of one task record."""
    status = F.lower(F.coalesce(F.col("status"), F.lit("")))
    done, late = status.startswith("hoàn thành"), status.contains("quá hạn")
    progress = F.col("_n_progress_percent")
    assigned, due, completed = (F.col(c) for c in ("assignment_date", "due_date", "completion_date"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return [
        Rule("TASK_LEAD_UNIT_REQUIRED", blank("lead_unit"), "lead_unit",
             message="Nhiệm vụ phải có đơn vị chủ trì."),
        Rule("TASK_PROGRESS_MISSING", progress.isNull(), "progress_percent", WARNING,
             "Thiếu tiến độ."),
        Rule("TASK_PROGRESS_RANGE", ~progress.between(0, 100), "progress_percent",
             message="Tiến độ phải từ 0 đến 100."),
        Rule("TASK_COMPLETION_BEFORE_ASSIGNMENT", completed < assigned, "completion_date",
             message="Ngày hoàn thành không được trước ngày giao."),
        Rule("TASK_RESULT_REQUIRED", done & blank("completion_result"), "completion_result",
             message="Nhiệm vụ hoàn thành phải có kết quả."),
        Rule("TASK_OVERDUE_STATUS", (due < as_of) & completed.isNull() & ~done & ~late,
             "status", WARNING, "Nhiệm vụ quá hạn phải được đánh dấu quá hạn."),
        Rule("TASK_COMPLETED_LATE_STATUS", (completed > due) & ~late, "status",
             message="Hoàn thành sau hạn phải có trạng thái hoàn thành quá hạn."),
    ]


def official_gate(rules: list[Rule], classification: Column) -> list[Rule]:
    """Rules apply to synthetic data only; other reports get one warning instead."""
    synthetic = F.coalesce(classification == SYNTHETIC, F.lit(False))
    gated = [Rule(r.code, synthetic & r.condition, r.field, r.severity, r.message) for r in rules]
    unavailable = Rule(
        "OFFICIAL_RULES_UNAVAILABLE", ~synthetic, "metadata.classification", WARNING,
        "Official validation rules are unavailable; human review is required.",
    )
    return [unavailable, *gated]


def validate_population(reports: DataFrame) -> DataFrame:
    """Reports with `issues` and `status`. The canonical vocabulary decides where it is present:
    a table with `population_opening` is canonical, else legacy."""
    if "population_opening" in reports.columns:
        return _validated(reports, CANONICAL_FIELDS, canonical_population_rules())
    return _validated(reports, LEGACY_POPULATION_FIELDS, legacy_population_rules())


def validate_complaints(reports: DataFrame) -> DataFrame:
    return _validated(reports, COMPLAINT_FIELDS + COMPLAINT_BALANCE, complaint_rules())


def _validated(reports: DataFrame, fields: Iterable[str], rules: list[Rule]) -> DataFrame:
    issues = issues_of(official_gate(rules, F.col("classification")))
    judged = with_numbers(reports, fields).withColumn("issues", issues)
    return without_numbers(judged).withColumn("status", status_of(F.col("issues")))


def missing_task_lists(reports: DataFrame, tasks: DataFrame) -> DataFrame:
    """Reports of the task domain without any record."""
    return reports.join(tasks, "report_id", "left_anti").select(
        "report_id", F.lit("TASK_LIST_MISSING").alias("code"), F.lit(ERROR).alias("severity"),
        F.lit("records").alias("field_path"),
        F.lit("Không tìm thấy danh sách nhiệm vụ.").alias("message"),
    )


# --- defined expressions ------------------------------------------------------------------------


@dataclass(frozen=True)
class Operand:
    """A field of the report or a constant, exactly one of the two."""

    field: str | None = None
    constant: object = None

    def __post_init__(self) -> None:
        if (self.field is None) == (self.constant is None):
            raise ValueError("an operand needs exactly one of field and constant")

    def value(self, values: Column) -> Column:
        """Text of the operand; values is a map from field to text."""
        if self.field is not None:
            return values[self.field]
        return F.lit(str(self.constant))

    def absent(self, values: Column) -> Column:
        if self.field is None:
            return F.lit(False)
        return ~F.map_contains_key(values, F.lit(self.field))


ARITHMETIC = ("add", "subtract", "multiply", "divide")
COMPARISONS = ("equal", "not_equal", "greater_than", "greater_or_equal", "less_than",
               "less_or_equal")


def arithmetic(operator: str, left: Column, right: Column) -> Column:
    """Result of a whitelisted operation; null for division by zero and where 38 digits do not hold it.

    Whole numbers of more than 18 digits are taken without fractional digits."""
    if operator not in ARITHMETIC:
        raise ValueError(f"unknown operator: {operator}")
    long = [v.try_cast("decimal(38,0)") for v in (left, right)]
    whole = (long[0] == left) & (long[1] == right)
    narrow = [v.try_cast("decimal(18,4)") for v in (left, right)]
    left, right = left.try_cast("decimal(28,10)"), right.try_cast("decimal(28,10)")
    # A product of narrow factors keeps all of its digits.
    exact = (narrow[0] == left) & (narrow[1] == right)
    result = {
        "add": lambda: F.try_add(left, right),
        "subtract": lambda: F.try_subtract(left, right),
        "multiply": lambda: F.when(exact, F.try_multiply(*narrow).cast("decimal(38,10)")).otherwise(
            F.try_multiply(left, right).try_cast("decimal(38,10)")),
        "divide": lambda: F.try_divide(left, right),
    }[operator]().try_cast("decimal(38,10)")
    wide = {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply, "divide": F.try_divide}[operator]
    return F.coalesce(result, F.when(whole, wide(*long).try_cast("decimal(38,10)")))


def compare(operator: str, left: Column, right: Column, x: Column, y: Column) -> Column:
    """Equality on any scalar (numbers by value), order on numbers only; null if not comparable.

    x and y are the operands as numbers, null where they are none."""
    if operator not in COMPARISONS:
        raise ValueError(f"unknown operator: {operator}")
    equal = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(left.eqNullSafe(right))
    return {
        "equal": lambda: equal,
        "not_equal": lambda: ~equal,
        "greater_than": lambda: x > y,
        "greater_or_equal": lambda: x >= y,
        "less_than": lambda: x < y,
        "less_or_equal": lambda: x <= y,
    }[operator]()


@dataclass(frozen=True)
class Definition:
    """A defined rule or KPI; the operator tells which."""

    id: str
    operator: str
    left: Operand
    right: Operand
    severity: str = ERROR
    message: str = ""
    production_approved: bool = False
    label: str = "SYNTHETIC_NON_PRODUCTION_RULE"

    @property
    def source_fields(self) -> list[str]:
        return [o.field for o in (self.left, self.right) if o.field]


def allowed(definition: Definition, classification: Column) -> Column:
    """Unapproved definitions run on synthetic data only."""
    return F.lit(definition.production_approved) | F.coalesce(
        classification == SYNTHETIC, F.lit(False)
    )


def evaluate_rules(reports: DataFrame, definitions: list[Definition]) -> DataFrame:
    """One row per raised issue over `values` (map of field to text) of each report.

    A missing field or a value that cannot be compared raises DEFINITION_FIELD_MISSING or
    DEFINITION_NOT_NUMERIC, a refused definition DEFINITION_NOT_APPROVED."""
    rules, staged = [], _with_operands(reports, definitions)
    for n, d in enumerate(definitions):
        may, absent, passed = (F.col(f"_d{n}.{part}") for part in ("may", "absent", "passed"))
        rules += [
            Rule("DEFINITION_NOT_APPROVED", ~may, d.id),
            Rule("DEFINITION_FIELD_MISSING", may & absent, d.id),
            Rule("DEFINITION_NOT_NUMERIC", may & ~absent & passed.isNull(), d.id),
            Rule(d.id, may & ~absent & ~passed, d.left.field, d.severity, d.message),
        ]
    return explode_issues(staged, issues_of(rules), "report_id")


def _with_operands(reports: DataFrame, definitions: list[Definition]) -> DataFrame:
    """One struct per definition with its resolved operands, each parsed once."""
    values = F.col("values")
    resolved = reports.withColumns({
        f"_o{n}": F.struct(
            d.left.value(values).alias("left"), d.right.value(values).alias("right"),
            to_decimal(d.left.value(values)).alias("x"), to_decimal(d.right.value(values)).alias("y"))
        for n, d in enumerate(definitions)
    })
    o = lambda n, part: F.col(f"_o{n}.{part}")
    return resolved.withColumns({
        f"_d{n}": F.struct(
            allowed(d, F.col("classification")).alias("may"),
            (d.left.absent(values) | d.right.absent(values)).alias("absent"),
            (compare(d.operator, o(n, "left"), o(n, "right"), o(n, "x"), o(n, "y"))
             if d.operator in COMPARISONS else F.lit(None).cast("boolean")).alias("passed"),
            o(n, "x").alias("x"), o(n, "y").alias("y"))
        for n, d in enumerate(definitions)
    })


def evaluate_kpis(reports: DataFrame, definitions: list[Definition]) -> DataFrame:
    """(report_id, kpi_id, value, source_fields, label, issue) for every report and definition. A result
    that 38 digits do not hold is null with the issue RESULT_OUT_OF_RANGE."""
    results, staged = [], _with_operands(reports, definitions)
    for n, d in enumerate(definitions):
        may, absent, left, right = (F.col(f"_d{n}.{p}") for p in ("may", "absent", "x", "y"))
        problem = (
            F.when(~may, "DEFINITION_NOT_APPROVED")
            .when(absent, "DEFINITION_FIELD_MISSING")
            .when(left.isNull() | right.isNull(), "DEFINITION_NOT_NUMERIC")
            .when(F.lit(d.operator == "divide") & (right == 0), "ZERO_DENOMINATOR")
        )
        value = arithmetic(d.operator, left, right)
        problem = problem.when(value.isNull(), "RESULT_OUT_OF_RANGE")
        results.append(
            F.struct(
                F.lit(d.id).alias("kpi_id"),
                F.when(problem.isNull(), value).alias("value"),
                F.array(*[F.lit(f) for f in d.source_fields]).cast("array<string>").alias("source_fields"),
                F.lit(d.label).alias("label"),
                problem.alias("issue"),
            )
        )
    return staged.select("report_id", F.explode(F.array(*results)).alias("r")).select(
        "report_id", "r.*"
    )


def values_map(df: DataFrame, fields: Iterable[str]) -> Column:
    """Wide columns as the open field map of a report; null values stay as keys."""
    pairs = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    return F.create_map(*pairs)


# --- rules that exist as data only --------------------------------------------------------------

# Id, severity, guard, assertion over named fields.
DATA_RULES = (
    ("RULE_KNTC_01", "warning", None,
     "tong_so_don = don_khieu_nai + don_to_cao + don_kien_nghi_phan_anh"),
    ("RULE_KNTC_02", "error", None,
     "don_thuoc_tham_quyen = don_da_giai_quyet + don_dang_giai_quyet + "
     "don_qua_han_chua_giai_quyet"),
    ("RULE_DEMO_01", "error", None, "so_khai_sinh_dung_han <= so_khai_sinh"),
    ("RULE_DEMO_02", "error", None, "so_khai_tu_dung_han <= so_khai_tu"),
    ("RULE_TTHC_01", "warning", "ho_so_da_giai_quyet > 0",
     "abs(ty_le_dung_han - (ho_so_dung_han / ho_so_da_giai_quyet) * 100) < 0.1"),
    ("RULE_TTHC_02", "warning", None,
     "tong_ho_so_tiep_nhan = ho_so_da_giai_quyet + ho_so_dang_giai_quyet"),
)


def data_rules(ids: Iterable[str]) -> list[Rule]:
    """Rules of the data files by id, each id once."""
    wanted, rules = set(ids), []
    for code, severity, guard, assertion in DATA_RULES:
        if code in wanted:
            applies = F.expr(guard) if guard else F.lit(True)
            # Guarded: the assertion is evaluated only where the guard holds.
            rules.append(Rule(code, F.when(applies, ~F.expr(assertion)), None, severity))
    return rules


def derive_task_status(evaluation: Column) -> Column:
    """Status by priority: overdue unless suspended, completed late, completed on time.

    The due day itself is not overdue; without due or evaluation date there is no status."""
    due, completed = F.col("due_date"), F.col("completion_date")
    suspended = F.coalesce(F.col("status_code") == "SUSPENDED", F.lit(False))
    return (
        F.when((evaluation > due) & completed.isNull() & ~suspended, F.lit("OVERDUE"))
        .when(completed > due, F.lit("COMPLETED_LATE"))
        .when(completed <= due, F.lit("COMPLETED_ON_TIME"))
    )


def deadline_rules(evaluation: Column) -> list[Rule]:
    """Consistency of dates and status codes; an assertion that is not true fails."""
    assigned, due, completed = (F.col(c) for c in ("assignment_date", "due_date", "completion_date"))
    code = F.col("status_code")
    holds = lambda assertion: F.coalesce(assertion, F.lit(False))
    return [
        Rule("DUE_DATE_NOT_BEFORE_ASSIGNMENT_DATE", ~holds(due >= assigned), "due_date"),
        Rule("COMPLETION_NOT_BEFORE_ASSIGNMENT",
             completed.isNotNull() & ~holds(completed >= assigned), "completion_date"),
        Rule("OVERDUE_STATUS_CONSISTENCY",
             (code == "OVERDUE") & ~holds(completed.isNull() & (evaluation > due)), "status"),
        Rule("LATE_STATUS_CONSISTENCY",
             (code == "COMPLETED_LATE") & ~holds(completed > due), "status"),
        Rule("ON_TIME_STATUS_CONSISTENCY",
             (code == "COMPLETED_ON_TIME") & ~holds(completed <= due), "status"),
    ]


# --- constraint checks of envelopes -------------------------------------------------------------


def envelope_rules(
    allowed_values: dict[str, Iterable[str]] | None = None,
    lengths: dict[str, tuple[int, int]] | None = None,
    ranges: dict[str, tuple[float, float]] | None = None,
) -> list[Rule]:
    """Allowed values, text lengths and number ranges of columns."""
    rules = []
    for name, values in (allowed_values or {}).items():
        rules.append(Rule("VALUE_NOT_ALLOWED", ~F.col(name).isin(*values), name))
    for name, (low, high) in (lengths or {}).items():
        rules.append(Rule("LENGTH_OUT_OF_RANGE", ~F.length(name).between(low, high), name))
    for name, (low, high) in (ranges or {}).items():
        rules.append(Rule("NUMBER_OUT_OF_RANGE", ~F.col(name).between(low, high), name))
    return rules


def period_rule(start: str = "period_start", end: str = "period_end") -> Rule:
    return Rule("PERIOD_END_BEFORE_START", F.col(end) < F.col(start), end)
