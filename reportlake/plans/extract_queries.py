"""Extraction and bundles, with the given tables rendered as report cells."""

from pyspark.sql import functions as F

from reportlake.operators import bundle, extract
from reportlake.operators.distribution import materialize
from reportlake.plans import adapters
from reportlake.plans.registry import query

POPULATION = adapters.plain(adapters.POPULATION)
COMPLAINTS = adapters.plain(adapters.COMPLAINTS)

LABELS = (
    ("received_cases", "  Đơn  tiếp nhận trong kỳ: "), ("complaint_cases", "ĐƠN KHIẾU NẠI"),
    ("denunciation_cases", "Đơn tố cáo:"), ("petition_cases", "Đơn kiến nghị/phản ánh"),
    ("within_authority", "Đơn thuộc thẩm quyền"), ("outside_authority", "Đơn không thuộc thẩm"),
    ("resolved_cases", "đơn đã giải quyết"),
)


def complaint_cells(t):
    """A label row per field; the resolved field comes twice and the last row counts."""
    reports = adapters.complaint_reports(t)

    def shown(value):
        text = value.cast("string")
        return (
            F.when(F.col("unit") % 4 == 0, F.concat(text, F.lit(" đơn")))
            .when(F.col("unit") % 4 == 1, F.concat(F.lit("1."), F.lpad(value % 1000, 3, "0")))
            .when(F.col("unit") % 4 == 2, F.concat(text, F.lit(",5")))
            .otherwise(text)
        )

    rows = [("resolved_cases", "Đơn đã giải quyết", F.lit("không rõ"))]
    rows += [(f, label, shown(F.col(f))) for f, label in LABELS]
    rows += [("none", "Ghi chú", F.lit("x"))]
    cells = F.array(*[
        F.struct(F.lit(i).alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value"))
        for i, (_, label, value) in enumerate(rows, 1)
        for c, v in ((0, F.lit(label)), (1, value))
    ])
    return reports.select(
        F.col("report_id").alias("file_id"), F.lit("complaints").alias("domain"),
        F.lit(1).alias("sheet_no"), F.lit("Sheet1").alias("sheet"), F.explode(cells).alias("c"),
    ).select("file_id", "domain", "sheet_no", "sheet", "c.*")


@query(
    " union all ".join(
        f"""select report_id as file_id, '{field}' as field, case when unit % 4 = 2 then 'decimal'
        else 'integer' end as kind, case unit % 4 when 1 then 1000.0::double + {field} % 1000
        when 2 then {field} + 0.5::double else {field}::double end as value, {i} as "row"
        from ({COMPLAINTS})"""
        for i, (field, _) in enumerate(LABELS, 2)
    )
)
def alias_map(t):
    found = extract.map_fields(materialize(complaint_cells(t)))
    return found.select(
        "file_id", "field", "kind", F.col("value_num").cast("double").alias("value"), "row")


@query(
    """select o_orderkey, case o_orderkey % 7 when 0 then 'date' when 1 then 'date'
      when 2 then 'integer' when 3 then 'decimal' when 4 then 'text' when 5 then 'integer' end as kind,
      case when o_orderkey % 7 in (0, 1) and o_orderkey % 5 <> 0 then cast(o_orderdate as date) end
        as value_date,
      case o_orderkey % 7 when 2 then o_orderkey * 1000.0::double when 3 then o_custkey + 0.25::double
        when 5 then o_custkey::double end as value_num,
      case when o_orderkey % 7 = 4 then o_orderpriority end as value_text,
      case when o_orderkey % 7 in (0, 1) and o_orderkey % 5 = 0 then 'INVALID_DATE' end as issue
    from orders"""
)
def scalar_parse(t):
    from reportlake.functions.scalars import parse_cells

    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    bad = key % 5 == 0
    grouped = F.concat(F.regexp_replace(F.format_number(key * 1000, 0), ",", "."), F.lit(" người"))
    text = (
        F.when((key % 7 == 0) & bad, F.lit("31/02/2026"))
        .when(key % 7 == 0, F.date_format(day, "d/M/yyyy"))
        .when((key % 7 == 1) & bad, F.lit("2025-13-01"))
        .when(key % 7 == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 7 == 2, F.when(key == 0, F.lit("0")).otherwise(grouped))
        .when(key % 7 == 3, F.concat(F.col("o_custkey").cast("string"), F.lit(",25 %")))
        .when(key % 7 == 4, F.concat(F.lit("  "), F.col("o_orderpriority")))
        .when(key % 7 == 5, F.concat(F.lit("+"), F.col("o_custkey").cast("string"), F.lit(" vụ")))
    )
    parsed = parse_cells(t.orders.select("o_orderkey", text.alias("cell")), "cell")
    return parsed.select(
        "o_orderkey", "kind", "value_date", F.col("value_num").cast("double").alias("value_num"),
        "value_text", "issue")


@query(
    """select o_orderkey, case when o_orderkey % 3 < 2 then cast(date_trunc('month', o_orderdate) as date)
      end as period_start, case when o_orderkey % 3 < 2 then last_day(cast(o_orderdate as date)) end
      as period_end, case when o_orderkey % 3 < 2 then strftime(o_orderdate, 'Tháng %m/%Y') end as label,
      case when o_orderkey % 2 = 0 then 'Xã ' || o_custkey else 'Đơn vị chưa xác định' end as organization
    from orders"""
)
def period_parse(t):
    from reportlake.functions.scalars import organization, report_month

    key = F.col("o_orderkey")
    month = F.date_format("o_orderdate", "M")
    year = F.date_format("o_orderdate", "yyyy")
    name = F.when(key % 3 == 0, F.concat(F.lit("bao_cao_thang_"), month, F.lit("_"), year, F.lit(".xlsx")))
    name = name.otherwise(F.lit("bao_cao.xlsx"))
    text = F.concat(
        F.when(key % 2 == 0, F.concat(F.lit("CƠ QUAN BÁO CÁO: Xã "), F.col("o_custkey"), F.lit("\n")))
        .otherwise(F.lit("")),
        F.when(key % 3 == 1, F.concat(F.lit("KỲ BÁO CÁO: "), month, F.lit("/"), year))
        .otherwise(F.lit("không có kỳ")),
    )
    found = t.orders.select(
        "o_orderkey", report_month(text, name).alias("p"), organization(text).alias("organization"))
    return found.select(
        "o_orderkey", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"),
        "p.label", "organization")


@query(
    f"""with x as (select doc_id, page_number, ord, case when ord % 3 = 2 then cast(ord as varchar)
        || ',5' else trim(line) end as line from ({adapters.LINES})),
    p as (select *, lead(line, 1) over w as a, lead(line, 2) over w as b, lead(line, 3) over w as c
      from x window w as (partition by doc_id, page_number order by ord))
    select doc_id as file_id, page_number, ord as line_no, line as label, coalesce(
      case when regexp_full_match(a, '[-+]?\\d+(?:[.,]\\d+)?') then a end,
      case when regexp_full_match(b, '[-+]?\\d+(?:[.,]\\d+)?') then b end,
      case when regexp_full_match(c, '[-+]?\\d+(?:[.,]\\d+)?') then c end, a) as value
    from p where a is not null"""
)
def label_value_lines(t):
    o = F.col("ord")
    line = F.when(o % 3 == 2, F.concat(o.cast("string"), F.lit(",5"))).otherwise(F.trim("line"))
    lines = adapters.lines(t).select(
        F.col("doc_id").alias("file_id"), "page_number", o.alias("line_no"), line.alias("line"))
    return extract.label_value_lines(lines)


GRID = (("Mã nhiệm vụ", "id"), ("Nội dung nhiệm vụ", "text"), ("ĐƠN VỊ CHỦ TRÌ", "unit"),
        ("Ngày giao", "given"), ("Tiến độ (%)", "progress"))


def task_cells(t):
    """A grid per unit: title, header, one row per order; some rows are no records."""
    key = F.col("o_orderkey")
    rows = t.orders.select(
        F.concat(F.lit("unit-"), (F.col("o_custkey") % 25).cast("string")).alias("file_id"),
        (key + 3).cast("int").alias("row"),
        F.when(key % 397 == 5, F.lit("Cộng")).otherwise(F.concat(F.lit("nv-"), key)).alias("id"),
        F.concat(F.lit("Task "), key).alias("text"),
        F.col("o_custkey").cast("string").alias("unit"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("given"),
        F.concat((key % 100).cast("string"), F.lit(" %")).alias("progress"),
    )
    head = t.orders.select(
        F.concat(F.lit("unit-"), (F.col("o_custkey") % 25).cast("string")).alias("file_id")
    ).distinct()
    cell = lambda c, v: F.struct(F.lit(c).alias("col"), v.alias("value"))
    body = rows.select("file_id", "row", F.explode(F.array(
        *[cell(i, F.col(name)) for i, (_, name) in enumerate(GRID)])).alias("c"))
    titles = head.select("file_id", F.lit(2).alias("row"), F.explode(F.array(
        *[cell(i, F.lit(label)) for i, (label, _) in enumerate(GRID)])).alias("c"))
    return body.unionByName(titles).select(
        "file_id", F.lit("tasks").alias("domain"), F.lit(1).alias("sheet_no"),
        F.lit("Sheet1").alias("sheet"), "row", "c.*")


@query(
    """with g as (select concat('unit-', o_custkey % 25) as file_id, o_orderkey % 397 = 5 as bad, *
      from orders),
    s as (select file_id, min(o_orderkey) as start from g where not bad group by file_id),
    e as (select file_id, min(o_orderkey) as stop from g join s using (file_id)
      where bad and o_orderkey > start group by file_id)
    select file_id, cast(o_orderkey + 3 as integer) as "row", 'nv-' || o_orderkey as task_id,
      'Task ' || o_orderkey as task_description, cast(o_custkey as varchar) as lead_unit,
      cast(o_orderdate as date) as assignment_date, (o_orderkey % 100)::double as progress_percent
    from g join s using (file_id) left join e using (file_id)
    where o_orderkey >= start and (stop is null or o_orderkey < stop)"""
)
def record_run(t):
    found = extract.task_records(materialize(task_cells(t)))
    return found.select(
        "file_id", "row", "task_id", "task_description", "lead_unit", "assignment_date",
        F.col("progress_percent").cast("double").alias("progress_percent"))


# --- population workbooks from events -----------------------------------------------------------

WEEK = "cast(date_trunc('week', ts) as date)"


def workbook_cells(t):
    """Three workbooks per unit and week: a summary sheet and a detail sheet of the events.

    Changes: unit % 5 = 0 adds one to a summary, unit % 5 = 1 leaves one out, unit 19 names no
    organization, unit 18 has no detail header, unit 17 lacks a code, unit 16 has a bad number."""
    events = t.events.selectExpr(
        "user_id % 20 as unit", f"{WEEK} as week", "event_id", "user_id", "event_type", "value")
    file = lambda role: F.concat_ws("/", F.col("unit"), F.col("week"), F.lit(role))

    def cells(df, role, sheet_no, rows):
        """rows: list of (row, [values])."""
        parts = [
            F.struct(r.cast("bigint").alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value"))
            for r, values in rows for c, v in enumerate(values)
        ]
        return df.select(
            file(role).alias("file_id"), F.lit(sheet_no).alias("sheet_no"),
            F.lit(f"S{sheet_no}").alias("sheet"), F.explode(F.array(*parts)).alias("c"),
        ).select("file_id", "sheet_no", "sheet", "c.*")

    u, text = F.col("unit"), lambda s: F.lit(s)
    count = lambda c: F.count_if(F.expr(c))
    per_user = events.groupBy("unit", "week", "user_id").agg(
        F.count("*").alias("p"), count("value < 50").alias("q"))
    totals = events.groupBy("unit", "week").agg(
        F.count("*").alias("population_opening"), count("value < 50").alias("temporary_opening"),
        count("event_type = 'signup'").alias("birth_registered"),
        count("event_type = 'signup' and value < 50").alias("birth_local_resident"),
        count("event_type = 'error'").alias("death_registered"),
        count("event_type = 'error' and value < 50").alias("death_local_resident"),
        count("event_type = 'view'").alias("permanent_in"),
        count("event_type = 'click'").alias("permanent_out"),
        count("event_type = 'purchase' and event_id % 2 = 0").alias("temporary_new"),
        count("event_type = 'purchase' and event_id % 2 = 1").alias("temporary_removed"),
    )
    parts = []
    for role, fields in extract.ROLE_FIELDS.items():
        first = fields[0]
        rows = [
            (F.lit(1), [text("SYNTHETIC_TEST_DATA"), F.lit(None)]),
            (F.lit(2), [text("Kỳ báo cáo:"), F.date_format("week", "'Tháng' MM/yyyy")]),
            (F.lit(3), [F.when(u == 19, text("Đơn vị")).otherwise(text("Đơn vị tổng hợp")),
                        F.concat(text("Xã "), u)]),
        ]
        for i, f in enumerate(fields):
            value = F.col(f)
            if f == first:
                value = F.when(u % 5 == 0, value + 1).when(u % 5 != 1, value)
            code = F.when(u == 17, text("khác")).otherwise(text(f)) if f == first else text(f)
            rows.append((F.lit(4 + i), [code, text("nhãn"), value]))
        parts.append(cells(totals, role, 1, rows))
    no_header = lambda h: F.when(u == 18, text("?")).otherwise(text(h))
    heads = {
        "OPENING_BALANCE": ("Mã địa bàn", "Tổng thường trú", "Tổng tạm trú"),
        "CIVIL_STATUS": ("Mã sự kiện", "Loại sự kiện", "Thuộc dân cư thường trú xã"),
        "RESIDENCE_MOVEMENT": ("Mã biến động", "Loại biến động"),
    }
    for role, (first, *others) in heads.items():
        parts.append(cells(totals, role, 2, [(F.lit(1), [no_header(first), *map(text, others)])]))
    users = F.when(u == 16, text("x")).otherwise(F.col("p").cast("string"))
    parts.append(cells(per_user, "OPENING_BALANCE", 2, [
        (F.col("user_id") + 2, [F.concat(text("DB-"), "user_id"), users, F.col("q")])]))
    parts.append(cells(totals, "OPENING_BALANCE", 2, [
        (F.lit(1 << 40), [text("TỔNG CỘNG"), F.lit(7), F.lit(7)]),
        (F.lit((1 << 40) + 1), [text("sau"), F.lit(9), F.lit(9)])]))
    civil = F.expr("case event_type when 'signup' then 'khai_sinh' when 'error' then 'KHAI_TU' end")
    parts.append(cells(events, "CIVIL_STATUS", 2, [(F.col("event_id") + 2, [
        F.col("event_id"), civil, F.expr("case when value < 50 then 'Có' else 'Không' end")])]))
    moved = F.expr("""case when event_type = 'view' then 'THUONG_TRU_DEN'
        when event_type = 'click' then 'thuong_tru_di'
        when event_type = 'purchase' and event_id % 2 = 0 then 'TAM_TRU_MOI'
        when event_type = 'purchase' then 'TAM_TRU_KET_THUC' end""")
    parts.append(cells(events, "RESIDENCE_MOVEMENT", 2, [
        (F.col("event_id") + 2, [F.col("event_id"), moved])]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


BOOKS = f"""
totals as (select user_id % 20 as unit, {WEEK} as week, count(*) as population_opening,
  count_if(value < 50) as temporary_opening, count_if(event_type = 'signup') as birth_registered,
  count_if(event_type = 'signup' and value < 50) as birth_local_resident,
  count_if(event_type = 'error') as death_registered,
  count_if(event_type = 'error' and value < 50) as death_local_resident,
  count_if(event_type = 'view') as permanent_in, count_if(event_type = 'click') as permanent_out,
  count_if(event_type = 'purchase' and event_id % 2 = 0) as temporary_new,
  count_if(event_type = 'purchase' and event_id % 2 = 1) as temporary_removed
  from events group by all),
books as (select unit, week, role, concat(unit, '/', week, '/', role) as file_id, t.* exclude (unit, week)
  from totals t, (values ('OPENING_BALANCE'), ('CIVIL_STATUS'), ('RESIDENCE_MOVEMENT')) r(role))"""


@query(
    f"""with {BOOKS} select file_id, case when unit <> 17 then role end as role,
    case when unit = 17 then 'POP_SOURCE_ROLE_UNDETERMINED' end as issue from books"""
)
def role_detect(t):
    return extract.detect_roles(materialize(workbook_cells(t)))


@query(
    f"""with {BOOKS} select file_id, cast(date_trunc('month', week) as date) as period_start,
    last_day(week) as period_end, case when unit <> 19 then 'Xã ' || unit end as organization_name,
    case when unit = 19 then 'POP_REPORTING_ORGANIZATION_MISSING' end as issue,
    'SYNTHETIC_TEST_DATA' as classification from books"""
)
def workbook_heads(t):
    cells = materialize(workbook_cells(t))
    periods = extract.workbook_periods(cells).select(
        "file_id", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"))
    names = extract.workbook_organizations(cells).drop("organization_id")
    return periods.join(names, "file_id").join(extract.classify_files(cells), "file_id")


@query(
    f"""with {BOOKS} select file_id, case when unit not in (16, 18) then population_opening end as a,
      case when unit <> 18 then temporary_opening end as b, cast(null as bigint) as c, cast(null as bigint) as d,
      case unit when 18 then 'POP_DETAIL_TABLE_MISSING' when 16 then 'POP_DETAIL_VALUE_INVALID' end as issue
      from books where role = 'OPENING_BALANCE'
    union all select file_id, case when unit <> 18 then birth_registered end,
      case when unit <> 18 then birth_local_resident end, case when unit <> 18 then death_registered end,
      case when unit <> 18 then death_local_resident end,
      case unit when 18 then 'POP_DETAIL_TABLE_MISSING' end from books where role = 'CIVIL_STATUS'
    union all select file_id, case when unit <> 18 then permanent_in end,
      case when unit <> 18 then permanent_out end, case when unit <> 18 then temporary_new end,
      case when unit <> 18 then temporary_removed end,
      case unit when 18 then 'POP_DETAIL_TABLE_MISSING' end from books
      where role = 'RESIDENCE_MOVEMENT'"""
)
def detail_counts(t):
    cells = materialize(workbook_cells(t))
    of = lambda role: cells.filter(F.col("file_id").endswith(role))
    none = F.lit(None).cast("bigint")
    opening = extract.opening_counts(of("OPENING_BALANCE")).select(
        "file_id",
        F.when(F.coalesce(F.col("issue"), F.lit("")) != "POP_DETAIL_VALUE_INVALID",
               F.col("population_opening")).alias("a"),
        F.col("temporary_opening").alias("b"), none.alias("c"), none.alias("d"), "issue")
    civil = extract.civil_counts(of("CIVIL_STATUS")).select(
        "file_id", F.col("birth_registered").alias("a"), F.col("birth_local_resident").alias("b"),
        F.col("death_registered").alias("c"), F.col("death_local_resident").alias("d"), "issue")
    moved = extract.movement_counts(of("RESIDENCE_MOVEMENT")).select(
        "file_id", F.col("permanent_in").alias("a"), F.col("permanent_out").alias("b"),
        F.col("temporary_new").alias("c"), F.col("temporary_removed").alias("d"), "issue")
    return opening.unionByName(civil).unionByName(moved)


def _reconciled(role: str) -> str:
    first = extract.ROLE_FIELDS[role][0]
    parts = []
    for f in extract.ROLE_FIELDS[role]:
        summary = f"case when unit % 5 = 0 then {f} + 1 when unit % 5 <> 1 then {f} end" if f == first else f
        lost = "unit = 18" + (" or unit = 16" if role == "OPENING_BALANCE" else "")
        parts.append(
            f"select file_id, role, '{f}' as field, {summary} as summary, "
            f"case when not ({lost}) then {f} end as detail from books where role = '{role}' "
            "and unit <> 17")
    return " union all ".join(parts)


@query(
    f"""with {BOOKS}, r as ({' union all '.join(_reconciled(r) for r in extract.ROLE_FIELDS)}),
    c as (select *, case when summary <> detail then 'POP_SUMMARY_DETAIL_MISMATCH'
      when coalesce(summary, detail) is null then 'POP_REQUIRED_FIELD_MISSING'
      when summary is null then 'POP_SUMMARY_VALUE_DERIVED_FROM_DETAIL' end as code from r)
    select file_id, role, field, summary, detail, code, case when code like '%DERIVED%' then 'warning'
      when code is not null then 'error' end as severity,
      case when code is null or code like '%DERIVED%' then coalesce(summary, detail) end as value
    from c"""
)
def summary_detail(t):
    cells = materialize(workbook_cells(t))
    of = lambda role: cells.filter(F.col("file_id").endswith(role))
    detail = extract.detail_values(extract.opening_counts(of("OPENING_BALANCE")), "OPENING_BALANCE")
    detail = detail.unionByName(
        extract.detail_values(extract.civil_counts(of("CIVIL_STATUS")), "CIVIL_STATUS"))
    detail = detail.unionByName(extract.detail_values(
        extract.movement_counts(of("RESIDENCE_MOVEMENT")), "RESIDENCE_MOVEMENT"))
    return extract.reconcile(extract.detect_roles(cells), extract.summary_values(cells), detail)


# --- bundles ------------------------------------------------------------------------------------

FIELD_LISTS = extract.ROLE_FIELDS


def bundle_sources(t):
    """Sources and values of one bundle per unit and week.

    unit % 6: 1 no movement source, 2 the opening source twice, 3 another period in the civil
    source, 4 a second opening value, 5 one official source."""
    reports = adapters.population_reports(t)
    u = F.col("unit")
    role = lambda r, tag="": F.struct(F.lit(r).alias("role"), F.lit(tag).alias("tag"))
    roles = F.array_compact(F.array(
        role("OPENING_BALANCE"), role("CIVIL_STATUS"),
        F.when(u % 6 != 1, role("RESIDENCE_MOVEMENT")),
        F.when(u % 6 == 2, role("OPENING_BALANCE", "b"))))
    rows = reports.withColumn("r", F.explode(roles)).withColumn("role", F.col("r.role"))
    shift = F.when((u % 6 == 3) & (F.col("role") == "CIVIL_STATUS"), 1).otherwise(0)
    start = F.date_add("period_start", shift)
    name = F.concat(F.lit("Xã "), u.cast("string"))
    base = rows.withColumns({
        "bundle_id": F.col("report_id"),
        "source_file_id": F.concat_ws("/", "report_id", "role", "r.tag"),
        "period": F.struct(F.lit("week").alias("kind"), start.alias("start"),
                           F.date_add(start, 6).alias("end"), start.cast("string").alias("label")),
        "organization_name": name,
        "organization_id": F.sha2(name, 256),
        "sha256": F.sha2(F.concat_ws("/", "report_id", "role", "r.tag"), 256),
        "classification": F.when((u % 6 == 5) & (F.col("role") == "CIVIL_STATUS"),
                                 "OFFICIAL_CANDIDATE").otherwise("SYNTHETIC_TEST_DATA"),
    })
    sources = base.select("bundle_id", "source_file_id", "role", "period", "organization_id",
                          "organization_name", "classification", "sha256")
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("bigint").alias("value"))
    pairs = None
    for r, fields in FIELD_LISTS.items():
        given = [pair(f, F.col(f)) for f in fields]
        if r == "RESIDENCE_MOVEMENT":
            given.append(F.when(u % 6 == 4, pair("population_opening", F.lit(999))))
        array = F.array_compact(F.array(*given))
        pairs = F.when(F.col("role") == r, array) if pairs is None else pairs.when(F.col("role") == r, array)
    values = base.select("bundle_id", "source_file_id", "role", F.explode(pairs).alias("p")).select(
        "bundle_id", "source_file_id", "role", "p.*")
    return sources, values


_BUNDLE_ISSUES = f"""
with r as (select *, unit % 6 as m from ({POPULATION})),
i as (select report_id, 'POP_SOURCE_ROLE_MISSING' as code, 'error' as severity, 'sources' as field_path
    from r where m = 1
  union all select report_id, 'POP_SOURCE_ROLE_DUPLICATE', 'error', 'sources' from r where m = 2
  union all select report_id, 'POP_SOURCE_COUNT_INVALID', 'error', 'sources' from r where m in (1, 2)
  union all select report_id, 'POP_REPORTING_PERIOD_MISMATCH', 'error', 'sources.reporting_period'
    from r where m = 3
  union all select report_id, 'POP_CANONICAL_FIELD_CONFLICT', 'error', 'population_opening' from r
    where m = 4 and population_opening <> 999
  union all select report_id, 'POP_BIRTH_REGISTRATION_SCOPE_DIFFERS', 'warning', 'birth_local_resident'
    from r where m in (0, 5) and birth_local_resident < birth_registered
  union all select report_id, 'POP_DEATH_REGISTRATION_SCOPE_DIFFERS', 'warning', 'death_local_resident'
    from r where m in (0, 5) and death_local_resident < death_registered)"""


@query(f"{_BUNDLE_ISSUES} select report_id as bundle_id, code, severity, field_path from i")
def bundle_issues(t):
    found = bundle.bundle_issues(bundle.standardize(*bundle_sources(t)))
    return found.select("bundle_id", "code", "severity", "field_path")


_SUMS = {
    "population_closing": "population_opening + birth_local_resident + permanent_in "
                          "- death_local_resident - permanent_out",
    "temporary_closing": "temporary_opening + temporary_new - temporary_removed",
}
_USABLE = "m in (0, 5)"


@query(
    f"""{_BUNDLE_ISSUES}, s as (select report_id, bool_or(severity = 'error') as e from i group by all)
    select r.report_id as bundle_id, case when m = 5 then 'OFFICIAL_CANDIDATE' else 'SYNTHETIC_TEST_DATA'
      end as classification, case when {_USABLE} then {_SUMS['population_closing']} end as population_closing,
      case when {_USABLE} then {_SUMS['temporary_closing']} end as temporary_closing,
      case when {_USABLE} then permanent_in end as permanent_in,
      case when e then 'failed' when not e then 'needs_review' else 'validated' end as status,
      case when {_USABLE} then regexp_replace(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') ||
        encode(concat('population-bundle:', sha256('Xã ' || unit), ':', period_start, ':', period_start + 6))),
        '^(.{{8}})(.{{4}}).(.{{3}}).(.{{3}})(.{{12}}).*$', '\\1-\\2-5\\3-\\4-\\5') end as report_id_parts
    from r left join s on r.report_id = s.report_id"""
)
def bundle_standardize(t):
    done = bundle.standardize(*bundle_sources(t))
    parts = F.regexp_replace("report_id", "-(.{3,4})-(.{4})-.(.{3})-", "-$1-$2-$3-")
    return done.select(
        "bundle_id", "classification", "population_closing", "temporary_closing", "permanent_in",
        "status", parts.alias("report_id_parts"))


@query(
    f"""with c as (select report_id, unit, list(sha256(concat(report_id, '/', role, '/')) order by role) as l
      from ({POPULATION}), (values ('OPENING_BALANCE'), ('CIVIL_STATUS'), ('RESIDENCE_MOVEMENT')) x(role)
      where unit % 6 not in (1, 2) group by all)
    select report_id as bundle_id, sha256(concat('CIVIL_STATUS', l[1], 'OPENING_BALANCE', l[2],
      'RESIDENCE_MOVEMENT', l[3])) as checksum from c"""
)
def bundle_checksums(t):
    return bundle.bundle_checksums(bundle_sources(t)[0])


@query(
    f"""select report_id, case when unit % 3 = 0 then 'created' when unit % 3 = 1 then 'duplicate'
      else 'POP_BUSINESS_KEY_CONFLICT' end as outcome from ({POPULATION})"""
)
def business_keys(t):
    reports = adapters.population_reports(t)
    checksum = F.sha2(F.col("report_id"), 256)
    new = reports.select("report_id", checksum.alias("checksum"))
    stored = reports.filter("unit % 3 <> 0").select(
        "report_id", F.when(F.col("unit") % 3 == 1, checksum).otherwise(F.lit("other")).alias("checksum"))
    return bundle.business_key_outcomes(new, stored).drop("checksum")
