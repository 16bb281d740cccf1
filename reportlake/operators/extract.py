"""From report cells to fields, records, roles, periods and reconciled counts.

Cells are rows (file_id, sheet_no, sheet, row, col, value), one per grid position, empty positions
included with a null value; rows and columns count from 1 and 0 as the grid reader gives them.
A file may hold any share of all cells: rows are grouped by their own key, positions are found by
aggregation, and no step orders a whole file in one task."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reportlake.functions import scalars
from reportlake.functions.text import label_key, strip
from reportlake.operators.distribution import materialize
from reportlake.settings import OFFICIAL, SYNTHETIC

# Report labels and the fields they name.
FIELD_ALIASES = {
    "population": {
        "population_start": ["Dân số đầu kỳ"],
        "arrivals": ["Chuyển đến trong kỳ"],
        "departures": ["Chuyển đi trong kỳ"],
        "births": ["Số trẻ sinh"],
        "deaths": ["Số người chết"],
        "population_total": ["Dân số cuối kỳ", "Tổng số nhân khẩu", "Tổng dân số"],
        "households": ["Số hộ"],
        "male": ["Nam"],
        "female": ["Nữ"],
        "permanent": ["Thường trú"],
        "temporary": ["Tạm trú", "Số người tạm trú"],
        "temporarily_absent": ["Tạm vắng"],
    },
    "complaints": {
        "beginning_cases": ["Đơn tồn đầu kỳ"],
        "received_cases": [
            "Đơn tiếp nhận trong kỳ", "Tổng số đơn tiếp nhận", "Số đơn tiếp nhận"],
        "complaint_cases": ["Đơn khiếu nại"],
        "denunciation_cases": ["Đơn tố cáo"],
        "petition_cases": ["Đơn kiến nghị/phản ánh"],
        "within_authority": ["Đơn thuộc thẩm quyền"],
        "outside_authority": ["Đơn không thuộc thẩm quyền", "Đơn không thuộc thẩm"],
        "resolved_cases": ["Đơn đã giải quyết"],
        "ending_cases": ["Đơn tồn cuối kỳ"],
        "citizen_receptions": ["Số lượt tiếp công dân"],
        "citizens_received": ["Số người được tiếp"],
        "crowd_cases": ["Vụ việc đông người"],
    },
    "tasks": {
        "task_total": ["Tổng số nhiệm vụ", "Tổng số nhiệm vụ theo dõi"],
        "completed_on_time": ["Hoàn thành đúng hạn"],
        "completed_late": ["Hoàn thành quá hạn"],
        "in_progress": ["Đang thực hiện"],
        "not_started": ["Chưa thực hiện"],
        "overdue": ["Quá hạn chưa hoàn thành"],
        "completion_rate": ["Tỷ lệ hoàn thành"],
        "average_progress": ["Tiến độ bình quân"],
    },
}
TASK_HEADERS = {
    "task_id": ["Mã nhiệm vụ", "Mã"],
    "task_description": ["Nội dung nhiệm vụ"],
    "lead_unit": ["Đơn vị chủ trì"],
    "coordinating_units": ["Đơn vị phối hợp"],
    "assignment_date": ["Ngày giao"],
    "due_date": ["Hạn hoàn thành"],
    "status": ["Trạng thái"],
    "progress_percent": ["Tiến độ (%)", "Tiến độ"],
    "completion_date": ["Ngày hoàn thành"],
    "completion_result": ["Kết quả", "Kết quả/Ghi chú"],
}
ROLE_FIELDS = {
    "OPENING_BALANCE": ("population_opening", "temporary_opening"),
    "CIVIL_STATUS": (
        "birth_registered", "birth_local_resident", "death_registered", "death_local_resident"),
    "RESIDENCE_MOVEMENT": ("permanent_in", "permanent_out", "temporary_new", "temporary_removed"),
}
PERIOD_LABEL, ORGANIZATION_LABEL, TOTAL_LABEL = "kỳ báo cáo", "đơn vị tổng hợp", "tổng cộng"
OPENING_HEADERS = ("mã địa bàn", "tổng thường trú", "tổng tạm trú")
CIVIL_HEADERS = ("mã sự kiện", "loại sự kiện", "thuộc dân cư thường trú xã")
MOVEMENT_HEADERS = ("mã biến động", "loại biến động")
CIVIL_EVENTS = {"KHAI_SINH": "birth", "KHAI_TU": "death"}
MOVEMENTS = {
    "THUONG_TRU_DEN": "permanent_in",
    "THUONG_TRU_DI": "permanent_out",
    "TAM_TRU_MOI": "temporary_new",
    "TAM_TRU_KET_THUC": "temporary_removed",
}
TASK_ID = "(?i)^NV-"

LINE_VALUE = r"(?U)^[-+]?\d+(?:[.,]\d+)?$"
_POSITION = ["sheet_no", "row"]


def _text(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit("")))


def alias_table(spark: SparkSession) -> DataFrame:
    """(domain, key, field): a fixed, small dimension."""
    rows = [
        (domain, label, field)
        for domain, fields in FIELD_ALIASES.items()
        for field, labels in fields.items()
        for label in labels
    ]
    raw = spark.createDataFrame(rows, "domain string, label string, field string")
    return raw.select("domain", label_key(F.col("label")).alias("key"), "field")


def header_table(spark: SparkSession) -> DataFrame:
    rows = [(label, field) for field, labels in TASK_HEADERS.items() for label in labels]
    raw = spark.createDataFrame(rows, "label string, field string")
    return raw.select(label_key(F.col("label")).alias("key"), "field")


def role_table(spark: SparkSession) -> DataFrame:
    rows = [(role, field, len(fields)) for role, fields in ROLE_FIELDS.items() for field in fields]
    return spark.createDataFrame(rows, "role string, field string, needed long")


def _place() -> Column:
    return F.struct("sheet_no", "row")


def _first_headers(cells: DataFrame) -> DataFrame:
    """(file_id, header, columns): first row of a file that names task id and description."""
    known = header_table(cells.sparkSession)
    keyed = cells.select("file_id", "sheet_no", "row", "col", label_key(F.col("value")).alias("key"))
    named = keyed.join(F.broadcast(known), "key")
    rows = named.groupBy("file_id", *_POSITION).agg(
        F.collect_list(F.struct("col", "field")).alias("columns"),
        F.max(F.col("field") == "task_id").alias("has_id"),
        F.max(F.col("field") == "task_description").alias("has_text"),
    )
    complete = rows.filter("has_id and has_text")
    return complete.groupBy("file_id").agg(
        F.min(_place()).alias("header"), F.min_by("columns", _place()).alias("columns")
    )


def map_fields(cells: DataFrame) -> DataFrame:
    """Label/value rows to typed fields; `cells` also has `domain`.

    The last row wins per field; in the task domain only rows above the record table count.
    Result: file_id, domain, field, kind, value_text, value_num, value_date, issue, sheet, row,
    evidence."""
    rows = cells.groupBy("file_id", "domain", "sheet_no", "sheet", "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("value"))).alias("label"),
        F.max(F.when(F.col("col") == 1, F.col("value"))).alias("value"),
        F.max("col").alias("last_col"),
    )
    paired = rows.filter("last_col >= 1").withColumn("key", label_key(F.col("label")))
    named = paired.join(F.broadcast(alias_table(cells.sparkSession)), ["domain", "key"])
    headers = _first_headers(cells.filter("domain = 'tasks'")).select("file_id", "header")
    above = (
        named.join(headers, "file_id", "left")
        .filter((F.col("domain") != "tasks") | F.col("header").isNull()
                | (_place() < F.col("header")))
    )
    last = above.groupBy("file_id", "domain", "field").agg(
        F.max_by(F.struct("value", "sheet", "row", "label"), _place()).alias("v")
    )
    flat = last.select(
        "file_id", "domain", "field", F.col("v.value").alias("value"),
        F.col("v.sheet").alias("sheet"), F.col("v.row").alias("row"),
        F.col("v.label").alias("evidence"),
    )
    return scalars.parse_cells(flat, "value").drop("value")


def task_records(cells: DataFrame) -> DataFrame:
    """Records of the task table of each file: the first contiguous run of rows after the header
    whose id starts with `NV-` and whose description is filled."""
    headers = _first_headers(cells)
    columns = (
        headers.select("file_id", "header", F.explode("columns").alias("c"))
        .groupBy("file_id", "header", "c.field")
        .agg(F.max("c.col").alias("col"))
    )
    placed = cells.join(columns, ["file_id", "col"]).filter(_place() > F.col("header"))
    wide = placed.groupBy("file_id", *_POSITION).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in TASK_HEADERS]
    )
    named = F.coalesce(F.col("task_id").rlike(TASK_ID), F.lit(False))
    described = F.coalesce(F.col("task_description"), F.lit("")) != ""
    # Read three times below: written once.
    marked = materialize(wide.withColumns({"ok": named & described, "place": _place()}))
    starts = marked.filter("ok").groupBy("file_id").agg(F.min("place").alias("start"))
    after = marked.join(starts, "file_id").filter("place >= start")
    ends = after.filter("not ok").groupBy("file_id").agg(F.min("place").alias("stop"))
    run = after.join(ends, "file_id", "left").filter("stop is null or place < stop")

    def typed(field: str) -> Column:
        value = strip(F.col(field))
        if field.endswith("_date"):
            return scalars.parse_date(value).alias(field)
        if field == "progress_percent":
            return scalars.to_decimal(scalars.bare_number(value)).alias(field)
        return value.alias(field)

    return run.select("file_id", "sheet_no", "row", *[typed(f) for f in TASK_HEADERS])


def label_value_lines(lines: DataFrame) -> DataFrame:
    """Pair each text line of a page with its value: the first number among the next three lines,
    else the next line; the last line of a page has no pair. Groups are single pages."""
    page = Window.partitionBy("file_id", "page_number").orderBy("line_no")
    following = [F.lead("line", n).over(page) for n in (1, 2, 3)]
    number = [F.when(x.rlike(LINE_VALUE), x) for x in following]
    return (
        lines.withColumns({"_next": following[0], "value": F.coalesce(*number, following[0])})
        .filter("_next is not null")
        .select("file_id", "page_number", "line_no", F.col("line").alias("label"), "value")
    )


def classify_files(cells: DataFrame, markers=scalars.SYNTHETIC_MARKERS) -> DataFrame:
    """(file_id, classification): synthetic where any cell carries a marker."""
    marked = cells.groupBy("file_id").agg(
        F.bool_or(scalars.has_synthetic_marker(F.col("value"), markers)).alias("synthetic")
    )
    label = F.when(F.col("synthetic"), SYNTHETIC).otherwise(OFFICIAL)
    return marked.select("file_id", label.alias("classification"))


# --- population workbooks -----------------------------------------------------------------------


def detect_roles(cells: DataFrame) -> DataFrame:
    """(file_id, role, issue): the one role whose codes are all in the first column."""
    files = cells.select("file_id").distinct()
    codes = cells.filter("col = 0").select("file_id", _text(F.col("value")).alias("field"))
    held = (
        codes.join(F.broadcast(role_table(cells.sparkSession)), "field")
        .groupBy("file_id", "role", "needed")
        .agg(F.count_distinct("field").alias("found"))
        .filter("found = needed")
        .groupBy("file_id")
        .agg(F.count("*").alias("roles"), F.max("role").alias("role"))
    )
    unique = F.coalesce(F.col("roles") == 1, F.lit(False))
    return files.join(held, "file_id", "left").select(
        "file_id",
        F.when(unique, F.col("role")).alias("role"),
        F.when(~unique, F.lit("POP_SOURCE_ROLE_UNDETERMINED")).alias("issue"),
    )


def role_mismatches(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose role is not the one they were handed in for (file_id, role)."""
    wanted = expected.select("file_id", F.col("role").alias("expected_role"))
    return detected.join(wanted, "file_id").filter("role <> expected_role").select(
        "file_id", "role", "expected_role", F.lit("POP_SOURCE_ROLE_MISMATCH").alias("issue")
    )


def _neighbours(cells: DataFrame) -> DataFrame:
    """Cells with their label key, and the cell to the right where there is one."""
    row = Window.partitionBy("file_id", *_POSITION).orderBy("col")
    right = F.lead(F.struct("value")).over(row)
    return cells.withColumn("right", right).withColumn("key", label_key(F.col("value")))


def workbook_periods(cells: DataFrame) -> DataFrame:
    """(file_id, period, issue): cells right of the period label first, the last such label
    before the earlier ones, then every cell in reading order."""
    near = _neighbours(cells)
    labelled = (F.col("key") == PERIOD_LABEL) & F.col("right").isNotNull()
    order = lambda p, sign: F.struct(
        F.lit(p).alias("p"), *[(sign * F.col(c)).alias(c) for c in ("sheet_no", "row", "col")]
    )
    candidates = near.select(
        "file_id",
        F.when(labelled, F.col("right.value")).otherwise(F.col("value")).alias("text"),
        F.when(labelled, order(0, -1)).otherwise(order(1, 1)).alias("place"),
    ).withColumn("period", scalars.cell_month(F.col("text")))
    best = candidates.groupBy("file_id").agg(
        F.min_by("period", F.when(F.col("period").isNotNull(), F.col("place"))).alias("period")
    )
    issue = F.when(F.col("period").isNull(), F.lit("POP_REPORTING_PERIOD_MISSING"))
    return best.withColumn("issue", issue)


def workbook_organizations(cells: DataFrame) -> DataFrame:
    """(file_id, organization_name, organization_id, issue): first filled cell right of the label."""
    near = _neighbours(cells).withColumn("name", F.nullif(_text(F.col("right.value")), F.lit("")))
    hit = (F.col("key") == ORGANIZATION_LABEL) & F.col("name").isNotNull()
    place = F.struct("sheet_no", "row", "col")
    best = near.groupBy("file_id").agg(
        F.min_by("name", F.when(hit, place)).alias("organization_name")
    )
    name = F.col("organization_name")
    return best.select(
        "file_id",
        "organization_name",
        F.when(name.isNotNull(), scalars.organization_id(name)).alias("organization_id"),
        F.when(name.isNull(), F.lit("POP_REPORTING_ORGANIZATION_MISSING")).alias("issue"),
    )


def summary_values(cells: DataFrame) -> DataFrame:
    """(file_id, field, summary, sheet, row): integer in the third column of a code row, the last
    readable one per code."""
    fields = [f for role in ROLE_FIELDS.values() for f in role]
    rows = cells.filter("col in (0, 2)").groupBy("file_id", "sheet_no", "sheet", "row").agg(
        F.max(F.when(F.col("col") == 0, _text(F.col("value")))).alias("field"),
        F.max(F.when(F.col("col") == 2, F.col("value"))).alias("value"),
    )
    read = rows.filter(F.col("field").isin(*fields)).withColumn(
        "summary", scalars.to_integer(F.col("value"))
    )
    return (
        read.filter("summary is not null")
        .groupBy("file_id", "field")
        .agg(F.max_by(F.struct("summary", "sheet", "row"), _place()).alias("v"))
        .select("file_id", "field", "v.*")
    )


def find_header(cells: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(file_id, sheet_no, header_row, key, col): first row of each file that has all headers."""
    keyed = cells.filter("value is not null").select(
        "file_id", *_POSITION, "col", label_key(F.col("value")).alias("key")
    )
    wanted = keyed.filter(F.col("key").isin(*required))
    rows = wanted.groupBy("file_id", *_POSITION, "key").agg(F.max("col").alias("col"))
    complete = (
        rows.groupBy("file_id", *_POSITION)
        .agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("key", "col"))).alias("cols"))
        .filter(F.col("n") == len(required))
    )
    first = complete.groupBy("file_id").agg(
        F.min(_place()).alias("place"), F.min_by("cols", _place()).alias("cols")
    )
    return first.select(
        "file_id", F.col("place.sheet_no").alias("sheet_no"),
        F.col("place.row").alias("header_row"), F.explode("cols").alias("key", "col"),
    )


def _detail_rows(cells: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Rows below the header, one column per required header (c0, c1, …)."""
    header = find_header(cells, required)
    below = cells.join(header, ["file_id", "sheet_no", "col"]).filter("row > header_row")
    return below.groupBy("file_id", "row").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"c{i}")
          for i, k in enumerate(required)]
    )


def _with_all_files(counts: DataFrame, cells: DataFrame, required) -> DataFrame:
    """Files with a header but no counted row have zero counts; files without a header an issue."""
    found = find_header(cells, required).select("file_id").distinct().withColumn("found", F.lit(True))
    files = cells.select("file_id").distinct()
    joined = files.join(found, "file_id", "left").join(counts, "file_id", "left")
    names = [c for c in counts.columns if c not in ("file_id", "invalid")]
    value = lambda c: F.when(F.col("found"), F.coalesce(F.col(c), F.lit(0)))
    invalid = F.col("invalid") if "invalid" in counts.columns else F.lit(None).cast("boolean")
    return joined.select(
        "file_id", *[value(c).alias(c) for c in names],
        F.when(F.col("found").isNull(), F.lit("POP_DETAIL_TABLE_MISSING"))
        .when(invalid, F.lit("POP_DETAIL_VALUE_INVALID")).alias("issue"),
    )


def opening_counts(cells: DataFrame) -> DataFrame:
    """Sums of the area table above its first total row."""
    rows = _detail_rows(cells, OPENING_HEADERS).withColumn("id", _text(F.col("c0")))
    rows = materialize(rows.withColumn("is_total", label_key(F.col("id")) == TOTAL_LABEL))
    cut = rows.filter("is_total").groupBy("file_id").agg(F.min("row").alias("cut"))
    kept = rows.join(cut, "file_id", "left").filter("(cut is null or row < cut) and id <> ''")
    numbers = kept.withColumns(
        {"p": scalars.to_integer(F.col("c1")), "t": scalars.to_integer(F.col("c2"))}
    )
    counts = numbers.groupBy("file_id").agg(
        F.sum("p").alias("population_opening"),
        F.sum("t").alias("temporary_opening"),
        F.count("*").alias("detail_record_count"),
        F.bool_or(F.col("p").isNull() | F.col("t").isNull()).alias("invalid"),
    )
    return _with_all_files(counts, cells, OPENING_HEADERS)


def civil_counts(cells: DataFrame) -> DataFrame:
    """Events per kind, and of those the local ones."""
    rows = _detail_rows(cells, CIVIL_HEADERS).filter(_text(F.col("c0")) != "")
    rows = rows.withColumns(
        {"event": F.upper(_text(F.col("c1"))), "local": label_key(F.col("c2")) == "có"}
    ).filter(F.col("event").isin(*CIVIL_EVENTS))
    counts = rows.groupBy("file_id").agg(
        *[
            F.count_if(condition).alias(f"{name}_{suffix}")
            for code, name in CIVIL_EVENTS.items()
            for suffix, condition in (
                ("registered", F.col("event") == code),
                ("local_resident", (F.col("event") == code) & F.col("local")),
            )
        ],
        F.count("*").alias("detail_record_count"),
    )
    return _with_all_files(counts, cells, CIVIL_HEADERS)


def movement_counts(cells: DataFrame) -> DataFrame:
    """Movements per accepted kind."""
    rows = _detail_rows(cells, MOVEMENT_HEADERS).filter(_text(F.col("c0")) != "")
    rows = rows.withColumn("kind", F.upper(_text(F.col("c1")))).filter(
        F.col("kind").isin(*MOVEMENTS)
    )
    counts = rows.groupBy("file_id").agg(
        *[F.count_if(F.col("kind") == code).alias(f) for code, f in MOVEMENTS.items()],
        F.count("*").alias("detail_record_count"),
    )
    return _with_all_files(counts, cells, MOVEMENT_HEADERS)


def detail_values(counts: DataFrame, role: str) -> DataFrame:
    """Counts of one role in long form (file_id, field, detail)."""
    pairs = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("detail"))
          for f in ROLE_FIELDS[role]]
    )
    return counts.filter("issue is null").select("file_id", F.explode(pairs).alias("p")).select(
        "file_id", "p.*"
    )


def reconcile(roles: DataFrame, summary: DataFrame, detail: DataFrame) -> DataFrame:
    """Summary against detail for every field of the file's role.

    Equal or one side only gives the value; a difference or nothing at all is an error."""
    wanted = roles.filter("role is not null").join(
        F.broadcast(role_table(roles.sparkSession)), "role"
    ).select("file_id", "role", "field")
    both = (
        summary.select("file_id", "field", "summary")
        .join(detail, ["file_id", "field"], "full_outer")
    )
    joined = wanted.join(both, ["file_id", "field"], "left")
    s, d = F.col("summary"), F.col("detail")
    value = F.coalesce(s, d)
    code = (
        F.when(s.isNotNull() & d.isNotNull() & (s != d), "POP_SUMMARY_DETAIL_MISMATCH")
        .when(value.isNull(), "POP_REQUIRED_FIELD_MISSING")
        .when(value < 0, "POP_NEGATIVE_VALUE")
        .when(s.isNull(), "POP_SUMMARY_VALUE_DERIVED_FROM_DETAIL")
    )
    severity = F.when(code == "POP_SUMMARY_VALUE_DERIVED_FROM_DETAIL", "warning").when(
        code.isNotNull(), "error"
    )
    return joined.select(
        "file_id", "role", "field", "summary", "detail",
        F.when(~severity.eqNullSafe(F.lit("error")), value)
        .alias("value"),
        code.alias("code"), severity.alias("severity"),
    )
