"""Rules and KPIs over the given tables seen as reports."""

from pyspark.sql import functions as F

from reportlake.operators import kpi, rules
from reportlake.operators.rules import Definition, Operand
from reportlake.plans import adapters
from reportlake.plans.registry import query

POPULATION = adapters.plain(adapters.POPULATION)
COMPLAINTS = adapters.plain(adapters.COMPLAINTS)
TASKS = adapters.plain(adapters.TASKS)
GATED = "classification = 'SYNTHETIC_TEST_DATA' and "


def sql_issues(source: str, key: str, checks: list[tuple[str, str, str, str]]) -> str:
    """checks: (code, severity, field, condition)."""
    parts = [
        f"select {key}, '{code}' as code, '{severity}' as severity, '{field}' as field_path "
        f"from src where {condition}"
        for code, severity, field, condition in checks
    ]
    return f"with src as ({source}) " + " union all ".join(parts)


POPULATION_CHECKS = (
    [("OFFICIAL_RULES_UNAVAILABLE", "warning", "metadata.classification",
      "classification <> 'SYNTHETIC_TEST_DATA'")]
    + [("POP_REQUIRED_FIELD_MISSING", "error", f, f"{GATED} {f} is null")
       for f in rules.CANONICAL_FIELDS]
    + [("POP_NEGATIVE_VALUE", "error", f, f"{GATED} {f} < 0") for f in rules.CANONICAL_FIELDS]
    + [(f"POP_{e.upper()}_LOCAL_EXCEEDS_REGISTERED", "error", f"{e}_local_resident",
        f"{GATED} {e}_local_resident > {e}_registered") for e in ("birth", "death")]
    + [(f"POP_{e.upper()}_REGISTRATION_SCOPE_DIFFERS", "warning", f"{e}_local_resident",
        f"{GATED} {e}_local_resident < {e}_registered") for e in ("birth", "death")]
    + [("POP_CANONICAL_BALANCE_MISMATCH", "error", "population_closing",
        f"{GATED} population_opening + birth_local_resident + permanent_in - death_local_resident "
        "- permanent_out <> population_closing"),
       ("POP_TEMPORARY_BALANCE_MISMATCH", "error", "temporary_closing",
        f"{GATED} temporary_opening + temporary_new - temporary_removed <> temporary_closing")]
)


def exploded(df, key="report_id"):
    return rules.explode_issues(df, F.col("issues"), key).drop("ord", "message")


@query(sql_issues(POPULATION, "report_id", POPULATION_CHECKS))
def rules_population(t):
    return exploded(rules.validate_population(adapters.population_reports(t)))


@query(
    f"""with issues as ({sql_issues(POPULATION, 'report_id', POPULATION_CHECKS)}),
    worst as (select report_id, bool_or(severity = 'error') as e from issues group by report_id)
    select r.report_id, case when e then 'failed' when not e then 'needs_review'
      else 'validated' end as status
    from ({POPULATION}) r left join worst using (report_id)"""
)
def status_rollup(t):
    reports = rules.validate_population(adapters.population_reports(t))
    return rules.status_rollup(reports, exploded(reports))


LEGACY = f"""select report_id, classification, population_opening as population_start,
  permanent_in as arrivals, permanent_out as departures, birth_local_resident as births,
  death_local_resident as deaths,
  case when day(period_start) <> 8 then population_closing end as population_total,
  population_closing - 500 as male, 500 + unit % 3 as female, population_closing as permanent,
  case when unit % 4 = 0 then 0 else temporary_closing end as temporary
from ({{source}})"""


@query(
    sql_issues(
        LEGACY.format(source=POPULATION), "report_id",
        [("OFFICIAL_RULES_UNAVAILABLE", "warning", "metadata.classification",
          "classification <> 'SYNTHETIC_TEST_DATA'")]
        + [("REQUIRED_FIELD_MISSING", "error", f, f"{GATED} {f} is null")
           for f in rules.LEGACY_POPULATION_FIELDS]
        + [("POP_BALANCE_MISMATCH", "error", "population_total",
            f"{GATED} population_start + arrivals - departures + births - deaths "
            "<> population_total"),
           ("POP_GENDER_TOTAL_MISMATCH", "error", "population_total",
            f"{GATED} male + female <> population_total"),
           ("POP_RESIDENCE_TOTAL_MISMATCH", "error", "population_total",
            f"{GATED} permanent + temporary <> population_total")],
    )
)
def rules_population_legacy(t):
    legacy = t.spark.sql(LEGACY.format(source="{reports}"), reports=adapters.population_reports(t))
    return exploded(rules.validate_population(legacy))


@query(
    sql_issues(
        COMPLAINTS, "report_id",
        [("REQUIRED_FIELD_MISSING", "error", f, f"{f} is null") for f in rules.COMPLAINT_FIELDS]
        + [("COM_TYPE_TOTAL_MISMATCH", "error", "received_cases",
            "complaint_cases + denunciation_cases + petition_cases <> received_cases"),
           ("COM_AUTHORITY_TOTAL_MISMATCH", "error", "received_cases",
            "within_authority + outside_authority <> received_cases")],
    )
)
def rules_complaints(t):
    return exploded(rules.validate_complaints(adapters.complaint_reports(t)))


AS_OF = "date '1998-12-31'"
TASK_CHECKS = [
    ("TASK_LEAD_UNIT_REQUIRED", "error", "lead_unit", "lead_unit is null"),
    ("TASK_PROGRESS_MISSING", "warning", "progress_percent", "progress_percent is null"),
    ("TASK_PROGRESS_RANGE", "error", "progress_percent", "progress_percent not between 0 and 100"),
    ("TASK_COMPLETION_BEFORE_ASSIGNMENT", "error", "completion_date",
     "completion_date < assignment_date"),
    ("TASK_RESULT_REQUIRED", "error", "completion_result",
     "status like 'hoàn thành%' and completion_result is null"),
    ("TASK_OVERDUE_STATUS", "warning", "status",
     f"due_date < {AS_OF} and completion_date is null and status not like 'hoàn thành%' "
     "and status not like '%quá hạn%'"),
    ("TASK_COMPLETED_LATE_STATUS", "error", "status",
     "completion_date > due_date and status not like '%quá hạn%'"),
]


@query(sql_issues(TASKS, "task_id", TASK_CHECKS))
def rules_tasks(t):
    return exploded(rules.validate_tasks(adapters.tasks(t), F.expr(AS_OF)), "task_id")


@query(
    f"""select report_id, 'TASK_LIST_MISSING' as code, 'error' as severity, 'records' as field_path
    from (select distinct c_custkey % 1000 as unit, concat('unit-', c_custkey % 1000) as report_id
      from customer)
    where unit not in (select o_custkey % 1000 from orders join lineitem on o_orderkey = l_orderkey
      where o_orderstatus = 'P')"""
)
def task_list_missing(t):
    unit = F.concat(F.lit("unit-"), (F.col("key") % 1000).cast("string")).alias("report_id")
    reports = t.customer.select(F.col("c_custkey").alias("key")).select(unit).distinct()
    open_orders = t.orders.filter("o_orderstatus = 'P'")
    open_tasks = open_orders.join(t.lineitem, F.expr("o_orderkey = l_orderkey"), "left_semi")
    records = open_tasks.select(F.col("o_custkey").alias("key")).select(unit)
    return rules.missing_task_lists(reports, records).drop("message")


DEFINED_RULES = [
    Definition("R1", "greater_or_equal", Operand("permanent_in"), Operand("permanent_out"),
               message="in < out"),
    Definition("R2", "equal", Operand("birth_registered"), Operand("birth_local_resident"),
               severity="warning", message="scope"),
    Definition("R3", "less_than", Operand("temporary_new"), Operand(constant=10),
               production_approved=True),
    Definition("R4", "not_equal", Operand("unit"), Operand(constant="3"), severity="info"),
    Definition("R5", "greater_than", Operand("no_such_field"), Operand(constant=0)),
    Definition("R6", "less_or_equal", Operand("classification"), Operand(constant=0)),
]
DEFINED_FIELDS = rules.CANONICAL_FIELDS + ("unit", "classification")
_NO = "classification <> 'SYNTHETIC_TEST_DATA'"


def with_values(reports):
    return reports.select(
        "report_id", "classification", rules.values_map(reports, DEFINED_FIELDS).alias("values")
    )


@query(
    sql_issues(
        POPULATION, "report_id",
        [("DEFINITION_NOT_APPROVED", "error", r, _NO) for r in ("R1", "R2", "R4", "R5", "R6")]
        + [("R1", "error", "permanent_in", f"{GATED} permanent_in < permanent_out"),
           ("R2", "warning", "birth_registered",
            f"{GATED} birth_registered <> birth_local_resident"),
           ("R3", "error", "temporary_new", "temporary_new >= 10"),
           ("R4", "info", "unit", f"{GATED} unit = 3"),
           ("DEFINITION_FIELD_MISSING", "error", "R5", f"not ({_NO})"),
           ("DEFINITION_NOT_NUMERIC", "error", "R6", f"not ({_NO})")],
    )
)
def rules_defined(t):
    reports = with_values(adapters.population_reports(t))
    return rules.evaluate_rules(reports, DEFINED_RULES).drop("ord", "message")


DEFINED_KPIS = [
    Definition("net", "subtract", Operand("permanent_in"), Operand("permanent_out")),
    Definition("both", "add", Operand("birth_registered"), Operand("death_registered")),
    Definition("double", "multiply", Operand("temporary_new"), Operand(constant=2)),
    Definition("ratio", "divide", Operand("birth_local_resident"), Operand("birth_registered"),
               production_approved=True),
    Definition("zero", "divide", Operand("permanent_in"), Operand(constant=0)),
    Definition("lost", "add", Operand("no_such_field"), Operand(constant=1)),
]


def sql_kpis(entries: list[tuple[str, str, str]], source: str) -> str:
    """entries: (kpi_id, value, issue)."""
    parts = [
        f"select report_id, '{k}' as kpi_id, case when {i} is null then round(cast({v} as double), 6)"
        f" end as value, {i} as issue from src"
        for k, v, i in entries
    ]
    return f"with src as ({source}) " + " union all ".join(parts)


_GATE = f"case when {_NO} then 'DEFINITION_NOT_APPROVED'"


@query(
    sql_kpis(
        [("net", "permanent_in - permanent_out", f"{_GATE} end"),
         ("both", "birth_registered + death_registered", f"{_GATE} end"),
         ("double", "temporary_new * 2", f"{_GATE} end"),
         ("ratio", "birth_local_resident / birth_registered",
          "case when birth_registered = 0 then 'ZERO_DENOMINATOR' end"),
         ("zero", "0", f"{_GATE} else 'ZERO_DENOMINATOR' end"),
         ("lost", "0", f"{_GATE} else 'DEFINITION_FIELD_MISSING' end")],
        POPULATION,
    )
)
def kpi_defined(t):
    found = rules.evaluate_kpis(with_values(adapters.population_reports(t)), DEFINED_KPIS)
    return shown(found).drop("source_fields", "label")


def shown(df, *columns):
    return df.withColumns(
        {c: F.round(F.col(c).cast("double"), 6) for c in (columns or ("value",))}
    )


_OFFICIAL = f"case when {_NO} then 'OFFICIAL_DEFINITIONS_NOT_APPROVED'"
CATALOGUE = [
    ("population_net_change", "population_closing - population_opening", f"{_OFFICIAL} end"),
    ("population_change_rate_percent",
     "(population_closing - population_opening) * 100 / population_opening",
     f"{_OFFICIAL} when population_opening = 0 then 'ZERO_DENOMINATOR' end"),
    ("permanent_net_migration", "permanent_in - permanent_out", f"{_OFFICIAL} end"),
    ("temporary_net_change", "temporary_closing - temporary_opening", f"{_OFFICIAL} end"),
] + [
    entry for e in ("birth", "death") for entry in (
        (f"{e}_registered_count", f"{e}_registered", f"{_OFFICIAL} end"),
        (f"{e}_local_resident_count", f"{e}_local_resident", f"{_OFFICIAL} end"),
        (f"{e}_registered_outside_local_residence", f"{e}_registered - {e}_local_resident",
         f"{_OFFICIAL} end"),
    )
]


@query(sql_kpis(CATALOGUE, POPULATION))
def kpi_population(t):
    return shown(kpi.catalogue_kpis(adapters.population_reports(t), "population"))


@query(
    sql_kpis(
        [("complaint_resolution_rate_percent", "resolved_cases * 100 / received_cases",
          "case when received_cases = 0 then 'ZERO_DENOMINATOR' end")], COMPLAINTS)
)
def kpi_complaints(t):
    return shown(kpi.catalogue_kpis(adapters.complaint_reports(t), "complaints"))


@query(
    sql_kpis(
        [("population_net_change", "population_total - population_start",
          f"{_OFFICIAL} when population_total is null then 'FIELD_MISSING' end"),
         ("population_change_rate_percent",
          "(population_total - population_start) * 100 / population_start",
          f"{_OFFICIAL} when population_total is null then 'FIELD_MISSING' end")],
        LEGACY.format(source=POPULATION))
)
def kpi_population_legacy(t):
    legacy = t.spark.sql(LEGACY.format(source="{reports}"), reports=adapters.population_reports(t))
    return shown(kpi.catalogue_kpis(legacy, "population"))


STATUS_CODE = """case when o_orderkey % 29 = 0 then 'SUSPENDED'
  when status like 'hoàn thành%' and o_orderkey % 3 = 0 then 'COMPLETED_LATE'
  when status like 'hoàn thành%' then 'COMPLETED_ON_TIME'
  when status = 'quá hạn' then 'OVERDUE' else 'IN_PROGRESS' end"""
CODED_TASKS = f"""select *, {STATUS_CODE} as status_code from
  (select *, cast(substring(task_id, 4) as bigint) as o_orderkey from ({{tasks}}) x) y"""
CODED = CODED_TASKS.format(tasks=TASKS)
EVALUATION = "date '1998-06-30'"
DERIVED = f"""case when {EVALUATION} > due_date and completion_date is null
    and status_code <> 'SUSPENDED' then 'OVERDUE'
  when completion_date > due_date then 'COMPLETED_LATE'
  when completion_date <= due_date then 'COMPLETED_ON_TIME' end"""


def coded_tasks(t):
    return t.spark.sql(CODED_TASKS.format(tasks="select * from {tasks}"), tasks=adapters.tasks(t))


@query(f"select task_id, status_code, {DERIVED} as derived_status from ({CODED})")
def task_status(t):
    derived = rules.derive_task_status(F.expr(EVALUATION)).alias("derived_status")
    return coded_tasks(t).select("task_id", "status_code", derived)


@query(
    sql_issues(
        CODED, "task_id",
        [("DUE_DATE_NOT_BEFORE_ASSIGNMENT_DATE", "error", "due_date", "due_date < assignment_date"),
         ("COMPLETION_NOT_BEFORE_ASSIGNMENT", "error", "completion_date",
          "completion_date < assignment_date"),
         ("OVERDUE_STATUS_CONSISTENCY", "error", "status", "status_code = 'OVERDUE' and not "
          f"(completion_date is null and {EVALUATION} > due_date)"),
         ("LATE_STATUS_CONSISTENCY", "error", "status", "status_code = 'COMPLETED_LATE' and not "
          "coalesce(completion_date > due_date, false)"),
         ("ON_TIME_STATUS_CONSISTENCY", "error", "status", "status_code = 'COMPLETED_ON_TIME' and "
          "not coalesce(completion_date <= due_date, false)")],
    )
)
def task_deadlines(t):
    tasks = coded_tasks(t)
    found = rules.issues_of(rules.deadline_rules(F.expr(EVALUATION)))
    return rules.explode_issues(tasks, found, "task_id").drop("ord", "message")


@query(
    f"""with src as (select coalesce(lead_unit, 'none') as unit, task_id, status_code,
      case when completion_date < assignment_date then 'ERROR' else 'OK' end as validation_status,
      progress_percent as p from ({CODED})),
    a as (select unit, count(distinct case when validation_status <> 'ERROR' then task_id end) as v,
      count_if(status_code in ('COMPLETED_ON_TIME', 'COMPLETED_LATE')) as d,
      count_if(status_code = 'COMPLETED_ON_TIME') as o, count_if(status_code = 'OVERDUE') as u,
      sum(case when p between 0 and 100 then p end) as s,
      count_if(p between 0 and 100) as n, count(*) as c from src group by unit)
    select unit, v as total_valid_tasks, d as completed_tasks, o as completed_on_time_tasks,
      u as overdue_unfinished_tasks, round(d * 100 / nullif(v, 0), 6) as completion_rate_percent,
      round(o * 100 / nullif(d, 0), 6) as on_time_completion_rate_percent,
      round(u * 100 / nullif(v, 0), 6) as overdue_rate_percent,
      round(s / nullif(n, 0), 6) as average_progress_percent, c - n as missing_progress_count
    from a"""
)
def task_kpis(t):
    tasks = coded_tasks(t).select(
        F.coalesce("lead_unit", F.lit("none")).alias("unit"), "task_id", "status_code",
        "progress_percent",
        F.when(F.expr("completion_date < assignment_date"), "ERROR").otherwise("OK").alias(
            "validation_status"),
    )
    rates = [c + "_percent" for c in
             ("completion_rate", "on_time_completion_rate", "overdue_rate", "average_progress")]
    return shown(kpi.task_kpis(tasks, ["unit"]), *rates).drop("warnings")


@query(
    f"""select unit, 'POP_TEMPORARY' as indicator_code, 'sum' as aggregation,
      cast(sum(temporary_closing) as double) as value from ({POPULATION}) group by unit
    union all select unit, 'POP_TOTAL', 'last_value',
      cast(arg_max(population_closing, period_start) as double) from ({POPULATION}) group by unit
    union all select unit, 'COM_RECEIVED', 'sum', cast(sum(received_cases) as double)
      from ({COMPLAINTS}) group by unit
    union all select unit, 'COM_RESOLVED', 'sum', cast(sum(resolved_cases) as double)
      from ({COMPLAINTS}) group by unit
    union all select cast(o_orderkey % 7 as bigint), 'TASK_TOTAL', 'count',
      cast(count(*) as double) from ({CODED}) group by 1
    union all select cast(o_orderkey % 7 as bigint), 'TASK_OVERDUE', 'count',
      cast(count_if(status_code = 'OVERDUE') as double) from ({CODED}) group by 1"""
)
def indicator_rollup(t):
    population, complaints = adapters.population_reports(t), adapters.complaint_reports(t)

    def long(df, domain, **fields):
        pairs = [F.struct(F.lit(k).alias("field"), v.cast("decimal(18,4)").alias("value"))
                 for k, v in fields.items()]
        return df.select(
            F.col("unit").cast("bigint").alias("unit"), F.lit(domain).alias("domain"),
            F.col("period_start").alias("period_end"), F.explode(F.array(*pairs)).alias("f"),
        ).select("unit", "domain", "period_end", "f.*")

    tasks = coded_tasks(t).withColumns(
        {"unit": F.col("o_orderkey") % 7, "period_start": F.col("due_date")})
    values = (
        long(population, "population", population_total=F.col("population_closing"),
             population_temporary=F.col("temporary_closing"))
        .unionByName(long(complaints, "complaints", received_cases=F.col("received_cases"),
                          resolved_cases=F.col("resolved_cases")))
        .unionByName(long(tasks, "tasks", task_id=F.lit(1),
                          status=F.when(F.col("status_code") == "OVERDUE", 1)))
    )
    return shown(kpi.indicator_rollup(values, kpi.indicator_table(t.spark), ["unit"]))


DATA_FIELDS = f"""select report_id, received_cases as tong_so_don,
  complaint_cases as don_khieu_nai, denunciation_cases as don_to_cao,
  petition_cases as don_kien_nghi_phan_anh, within_authority as don_thuoc_tham_quyen,
  resolved_cases as don_da_giai_quyet, unit % 5 as don_dang_giai_quyet,
  0 as don_qua_han_chua_giai_quyet, resolved_cases as ho_so_dung_han,
  received_cases - unit % 3 as ho_so_da_giai_quyet, unit % 3 as ho_so_dang_giai_quyet,
  received_cases as tong_ho_so_tiep_nhan,
  cast(case when received_cases > unit % 3 then resolved_cases * 100 / (received_cases - unit % 3)
    else 0 end as double) + unit % 2 as ty_le_dung_han,
  complaint_cases as so_khai_sinh_dung_han, petition_cases as so_khai_sinh,
  denunciation_cases as so_khai_tu_dung_han, received_cases as so_khai_tu
from ({{source}})"""


@query(
    f"""with src as ({DATA_FIELDS.format(source=COMPLAINTS)})
    select report_id, 'RULE_KNTC_01' as code, 'warning' as severity from src
      where tong_so_don <> don_khieu_nai + don_to_cao + don_kien_nghi_phan_anh
    union all select report_id, 'RULE_KNTC_02', 'error' from src where don_thuoc_tham_quyen
      <> don_da_giai_quyet + don_dang_giai_quyet + don_qua_han_chua_giai_quyet
    union all select report_id, 'RULE_DEMO_01', 'error' from src
      where so_khai_sinh_dung_han > so_khai_sinh
    union all select report_id, 'RULE_DEMO_02', 'error' from src
      where so_khai_tu_dung_han > so_khai_tu
    union all select report_id, 'RULE_TTHC_01', 'warning' from src where ho_so_da_giai_quyet > 0
      and abs(ty_le_dung_han - ho_so_dung_han / ho_so_da_giai_quyet * 100) >= 0.1
    union all select report_id, 'RULE_TTHC_02', 'warning' from src
      where tong_ho_so_tiep_nhan <> ho_so_da_giai_quyet + ho_so_dang_giai_quyet"""
)
def rules_as_data(t):
    reports = t.spark.sql(
        DATA_FIELDS.format(source="{reports}"), reports=adapters.complaint_reports(t))
    found = rules.issues_of(rules.data_rules(code for code, *_ in rules.DATA_RULES))
    return rules.explode_issues(reports, found, "report_id").select("report_id", "code", "severity")


@query(
    """select o_orderkey, 'VALUE_NOT_ALLOWED' as code, 'o_orderstatus' as field_path from orders
      where o_orderstatus not in ('F', 'O')
    union all select o_orderkey, 'LENGTH_OUT_OF_RANGE', 'o_orderpriority' from orders
      where length(o_orderpriority) not between 1 and 8
    union all select o_orderkey, 'NUMBER_OUT_OF_RANGE', 'o_totalprice' from orders
      where o_totalprice not between 0 and 400000
    union all select o_orderkey, 'PERIOD_END_BEFORE_START', 'period_end' from
      (select o_orderkey, o_orderdate as s, max(l_shipdate) as e from orders
       join lineitem on o_orderkey = l_orderkey group by all) where e < s"""
)
def envelope_checks(t):
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("period_end"))
    orders = t.orders.withColumn("period_start", F.col("o_orderdate")).join(
        shipped, "o_orderkey", "left")
    checks = rules.envelope_rules(
        {"o_orderstatus": ("F", "O")}, {"o_orderpriority": (1, 8)}, {"o_totalprice": (0, 400000)})
    found = rules.issues_of([*checks, rules.period_rule()])
    return rules.explode_issues(orders, found, "o_orderkey").select(
        "o_orderkey", "code", "field_path")
