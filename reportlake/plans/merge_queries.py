"""Merged reports: source warnings, lineage, approvals; and the status dimension."""

from pyspark.sql import functions as F

from reportlake.operators import approvals, bundle, lineage, statuses
from reportlake.plans import adapters
from reportlake.plans.extract_queries import _BUNDLE_ISSUES, _USABLE, POPULATION, bundle_sources
from reportlake.plans.registry import query

_DERIVED = "(unit + day(period_start)) % 3 = 0"


def source_warnings(t, sources):
    """Official sources are not approved; in every third week a movement was derived from details."""
    official = sources.withColumn("domain", F.lit("population")).withColumn("period_start", F.col("period.start"))
    found = approvals.unapproved(official, "source_file_id", message=approvals.SOURCE_MESSAGE)
    named = sources.select("bundle_id", "source_file_id", "role")
    unapproved = found.join(named, "source_file_id").select(
        *named.columns, F.lit(1).alias("ord"), "code", "field_path", "message")
    start = F.col("period.start")
    unit = F.split("bundle_id", "/")[0].cast("int")
    derived = sources.filter((F.col("role") == "RESIDENCE_MOVEMENT") & ((unit + F.day(start)) % 3 == 0)).select(
        *named.columns, F.lit(0).alias("ord"), F.lit("POP_SUMMARY_VALUE_DERIVED_FROM_DETAIL").alias("code"),
        F.lit("permanent_in").alias("field_path"), F.lit("").alias("message"))
    return unapproved.unionByName(derived)


@query(
    f"""{_BUNDLE_ISSUES},
    w as (select report_id, code, severity, field_path, case when severity = 'error' then 0 else 2 end as part,
        case code when 'POP_SOURCE_COUNT_INVALID' then 1 when 'POP_DEATH_REGISTRATION_SCOPE_DIFFERS' then 1 else 0 end as turn from i
      union all select report_id, 'UNAPPROVED_OFFICIAL_MAPPING', 'warning', null, 1, 0 from r where m = 5
      union all select report_id, 'POP_SUMMARY_VALUE_DERIVED_FROM_DETAIL', 'warning', 'permanent_in', 1, 1
        from r where {_USABLE} and {_DERIVED}),
    s as (select report_id, case when bool_or(severity = 'error') then 'failed' else 'needs_review' end as status from w group by all)
    select report_id as bundle_id, cast(row_number() over (partition by report_id order by part, turn) - 1 as integer) as ord,
      code, severity, field_path, coalesce(status, 'validated') as status
    from r left join w using (report_id) left join s using (report_id)"""
)
def bundle_source_warnings(t):
    """Issues of every bundle in order, with its status; one row for bundles without any."""
    sources, values = bundle_sources(t)
    done = bundle.standardize(sources, values, source_warnings(t, sources))
    issues = done.select("bundle_id", "status", F.posexplode_outer("issues").alias("ord", "i"))
    return issues.select(
        "bundle_id", F.coalesce("ord", F.lit(0)).alias("ord"), "i.code", "i.severity", "i.field_path", "status")


_FIELDS = [(f, role, n) for role, fields in bundle.ROLE_FIELDS.items() for n, f in enumerate(fields)]


def origins(values):
    """Every value is found in a summary row, every second one in a detail table too."""
    number = F.create_map(*[x for f, _, n in _FIELDS for x in (F.lit(f), F.lit(n))])[F.col("field")]
    places = F.array_compact(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("S1").alias("sheet"), (number + 4).cast("bigint").alias("row")),
        F.when(number % 2 == 1, F.struct(F.lit(1).alias("ord"), F.lit("S2").alias("sheet"), F.lit(1).cast("bigint").alias("row")))))
    return values.select("bundle_id", "source_file_id", "field", F.explode(places).alias("p")).select(
        "bundle_id", "source_file_id", "field", "p.*", F.lit("reconciliation").alias("method"), F.col("field").alias("evidence"))


def repeated_values(sources, values):
    """In bundles with m = 0 the movement source gives the registered births once more."""
    again = values.filter("field = 'birth_registered'").drop("source_file_id", "role")
    movement = sources.filter("role = 'RESIDENCE_MOVEMENT' and cast(split(bundle_id, '/')[0] as int) % 6 = 0")
    more = movement.select("bundle_id", "source_file_id", "role").join(again, "bundle_id")
    return values.unionByName(more.select(values.columns))


def _uses() -> str:
    rows = [(f, f, 0) for f, _, _ in _FIELDS]
    rows += [(closing, term, n) for closing, (plus, minus) in bundle.CLOSING.items() for n, term in enumerate((*plus, *minus))]
    return ", ".join(f"('{field}', '{term}', {n})" for field, term, n in rows)


@query(
    f"""with r as (select *, unit % 6 as m from ({POPULATION})),
    f(term, role, n) as (values {', '.join(f"('{f}', '{role}', {n})" for f, role, n in _FIELDS)}),
    u(field, term, term_no) as (values {_uses()}),
    o(ord) as (values (0), (1))
    select report_id as bundle_id, field, term, term_no, concat(report_id, '/',
        case when m = 0 and term = 'birth_registered' then 'RESIDENCE_MOVEMENT' else role end, '/') as source_file_id,
      ord, case ord when 0 then 'S1' else 'S2' end as sheet, cast(case ord when 0 then n + 4 else 1 end as bigint) as "row", term as evidence
    from r, u join f using (term), o where {_USABLE} and (ord = 0 or n % 2 = 1)"""
)
def bundle_provenance(t):
    """Origins of all twelve values of the merged reports."""
    sources, values = bundle_sources(t)
    values = repeated_values(sources, values)
    found = lineage.value_provenance(bundle.standardize(sources, values), values, origins(values))
    return found.drop("method")


@query(
    f"""with r as (select *, unit % 6 as m from ({POPULATION}))
    select report_id as bundle_id, 'ghi_chú' as field, 'PROVENANCE_UNKNOWN_FIELD' as issue from r where {_USABLE} and unit % 4 = 1"""
)
def provenance_unknown(t):
    """Origins of a field that the report has no value of."""
    sources, values = bundle_sources(t)
    done = bundle.standardize(sources, values)
    found = lineage.value_provenance(done, values, origins(values))
    stray = done.filter("report_id is not null and cast(split(bundle_id, '/')[0] as int) % 4 = 1").select(
        "bundle_id", F.lit("ghi_chú").alias("field"))
    given = found.select("bundle_id", "field").unionByName(stray)
    return lineage.unknown_fields(given, lineage.long_values(done, (*bundle.INPUT_FIELDS, *bundle.CLOSING)), "bundle_id")


_APPROVED = """select 'population' as domain, 'OFFICIAL_CANDIDATE' as classification, valid_from, valid_from + 6 as valid_to
  from (select distinct cast(date_trunc('week', ts) as date) as valid_from from {events}) where day(valid_from) % 2 = 0"""


@query(
    f"""select report_id, 'UNAPPROVED_OFFICIAL_MAPPING' as code, 'warning' as severity, '{approvals.REPORT_MESSAGE}' as message
    from ({POPULATION}) where classification = 'OFFICIAL_CANDIDATE' and day(period_start) % 2 <> 0"""
)
def unapproved_mappings(t):
    """Official reports of weeks in which the mapping was not approved."""
    reports = adapters.population_reports(t).withColumn("domain", F.lit("population"))
    found = approvals.unapproved(reports, "report_id", t.sql(_APPROVED, "events"))
    return found.drop("field_path")


_STATUS = """case when cast(substr(task_id, 4) as bigint) % 7 = 0 then 'Xong  V1:' when cast(substr(task_id, 4) as bigint) % 7 = 1 then 'vòng'
  when cast(substr(task_id, 4) as bigint) % 7 = 2 then 'ON_HOLD' when cast(substr(task_id, 4) as bigint) % 7 = 3 then 'Hoàn thành quá hạn' else status end"""
# Chains of renames; `vòng` goes round.
ALIASES = [("xong v1", "xong v2"), ("xong v2", "hoàn thành"), ("hoàn thành", "completed"), ("quá hạn", "delayed"),
           ("vòng", "vòng 2"), ("vòng 2", "vòng")]
_DIMENSION = ", ".join(f"('{c}', '{label}', {t}, {d}, {r})" for c, label, t, d, r in statuses.STATUSES)


@query(
    f"""with x as (select *, cast(substr(task_id, 4) as bigint) % 7 as k from ({adapters.plain(adapters.TASKS)})),
    n as (select *, case when k = 0 or k > 3 and status = 'hoàn thành' then 'completed' when k > 3 and status = 'quá hạn' then 'delayed'
      when k = 2 then 'on_hold' when k = 3 then 'late' when k = 1 then 'vòng' else status end as name from x),
    c as (select *, case name when 'completed' then case when completion_date > due_date then 'COMPLETED_LATE'
        when completion_date <= due_date then 'COMPLETED_ON_TIME' end
      when 'delayed' then case when completion_date is null then 'OVERDUE' when completion_date > due_date then 'COMPLETED_LATE' end
      when 'on_hold' then 'SUSPENDED' when 'late' then 'COMPLETED_LATE' when 'đang thực hiện' then 'IN_PROGRESS' end as status_code from n),
    d(status_code, status_label, is_terminal, requires_date, requires_result) as (values {_DIMENSION})
    select task_id, status_code, status_label, is_terminal, requires_date, requires_result, concat_ws(',',
      case when status_code is null then 'TASK_STATUS_UNKNOWN' end,
      case when requires_date and completion_date is null then 'TASK_STATUS_REQUIRES_COMPLETION_DATE' end,
      case when requires_result and coalesce(completion_result, '') = '' then 'TASK_STATUS_REQUIRES_COMPLETION_RESULT' end,
      case when not is_terminal and completion_date is not null then 'TASK_STATUS_EXCLUDES_COMPLETION_DATE' end) as codes
    from c left join d using (status_code)"""
)
def task_status_dimension(t):
    """Codes, flags and missed requirements of all tasks, with older names resolved."""
    tasks = adapters.tasks(t).withColumn("status", F.expr(_STATUS))
    aliases = t.spark.createDataFrame(ALIASES, "alias string, target string")
    found = statuses.status_issues(statuses.with_status(tasks, aliases))
    return found.select(
        "task_id", "status_code", "status_label", "is_terminal", "requires_date", "requires_result",
        F.concat_ws(",", F.transform("issues", lambda i: i["code"])).alias("codes"))


_RENAMED = """select concat('c', cast(c_custkey as string)) as alias, case
    when c_custkey % 10 = 0 then c_mktsegment when c_custkey % 100 = 57 then concat('c', cast(c_custkey + 2 as string))
    when c_custkey % 100 = 31 then 'nowhere' else concat('c', cast(c_custkey - 1 as string)) end as target from {customer}
  union all select concat('c', cast(c_custkey as string)), 'other' from {customer} where c_custkey % 100 = 75"""


@query(
    f"""with recursive given as ({adapters.plain(_RENAMED)}),
    single as (select alias, min(target) as target from given group by alias having count(*) = 1),
    segments as (select distinct c_mktsegment as code from customer),
    walk as (select alias, target, 1 as steps from single
      union all select w.alias, s.target, steps + 1 from walk w join single s on w.target = s.alias where steps < 40),
    done as (select alias, target as code, steps from walk join segments on target = code),
    loop as (select distinct alias from walk where steps = 40)
    select alias, code, cast(steps as bigint) as steps, null::varchar as issue from done
    union all select alias, null, null, case when alias in (select alias from given group by alias having count(*) > 1) then 'ALIAS_AMBIGUOUS'
      when alias in (select alias from loop) then 'ALIAS_CYCLE' else 'ALIAS_UNKNOWN_TARGET' end
    from (select distinct alias from given) where alias not in (select alias from done)"""
)
def status_aliases(t):
    """Customers renamed after each other down to their segment, with cycles and loose ends."""
    renamed = t.sql(_RENAMED, "customer")
    done, issues = statuses.resolve_aliases(renamed, t.customer.select(F.col("c_mktsegment").alias("code")))
    return done.withColumn("issue", F.lit(None).cast("string")).unionByName(issues, allowMissingColumns=True)
