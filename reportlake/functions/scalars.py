"""Cell text to typed values."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.ids import uuid5
from reportlake.functions.text import label_key, strip

# Fixed values.
UNIT_SUFFIX = r"(?iU)\s*(?:người|hộ|đơn|lượt|vụ|nhiệm vụ|%)\s*$"
GROUPED_DIGITS = r"(?U)^[-+]?\d{1,3}(?:\.\d{3})+$"
DECIMAL_COMMA = r"(?U)^[-+]?\d+,\d+$"
LOCAL_DATE = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
ISO_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
NUMBER = r"^[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?$"
MONTH_IN_NAME = r"(?iU)thang[_\s-]*(\d{1,2})[_-](\d{4})"
MONTH_IN_TEXT = r"(?iU)(?:tháng|kỳ báo cáo)\s*:?[ _-]*(\d{1,2})[/_-](\d{4})"
MONTH_IN_CELL = r"(?iU)tháng\s*(\d{1,2})\s*[/_-]\s*(\d{4})"
ORGANIZATION = r"(?iU)(?:Đơn vị báo cáo|Cơ quan báo cáo)\s*:?\s*([^\n]+)"
UNKNOWN_ORGANIZATION = "Đơn vị chưa xác định"
SYNTHETIC_MARKERS = ("DỮ LIỆU GIẢ LẬP", "SYNTHETIC_TEST_DATA")
DECIMAL = "decimal(38,10)"


def to_decimal(value: Column) -> Column:
    """Lenient number: null when the text is not one."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast(DECIMAL))


def to_integer(value: Column) -> Column:
    """Strict integer cell: blanks inside are ignored, anything else is refused."""
    text = F.replace(strip(value.cast("string")), F.lit(" "), F.lit(""))
    return F.when(text.rlike(r"(?U)^-?\d+$"), text.try_cast("bigint"))


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_date(text: Column) -> Column:
    """Date of a d/m/Y or Y-m-d text; null for anything else."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    return F.when(
        text.rlike(LOCAL_DATE), _date(part(LOCAL_DATE, 3), part(LOCAL_DATE, 2), part(LOCAL_DATE, 1))
    ).when(text.rlike(ISO_DATE), _date(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)))


def bare_number(text: Column) -> Column:
    """Number text without its unit and with dots and comma as a number has them."""
    bare = F.regexp_replace(text, UNIT_SUFFIX, "")
    return (
        F.when(bare.rlike(GROUPED_DIGITS), F.replace(bare, F.lit("."), F.lit("")))
        .when(bare.rlike(DECIMAL_COMMA), F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(bare)
    )


def parse_cells(df: DataFrame, column: str) -> DataFrame:
    """Add kind, value_text, value_num, value_date and issue for a column of cell text.

    kind is null for an empty cell, else date, integer, decimal or text. A text shaped like a date
    that is none yields kind `date`, a null value and an issue. Each step is a projection of its
    own, so no pattern runs twice on a cell."""
    value = F.col(column).cast("string")
    empty = value.isNull() | (value == "")
    staged = df.withColumn("_text", F.when(~empty, strip(value)))
    staged = staged.withColumn(
        "_dated", F.col("_text").rlike(LOCAL_DATE) | F.col("_text").rlike(ISO_DATE))
    dated = F.col("_dated")
    staged = staged.withColumns({
        "value_date": F.when(dated, parse_date(F.col("_text"))),
        "_bare": F.when(~dated, bare_number(F.col("_text"))),
    }).withColumn("value_num", to_decimal(F.col("_bare")))
    kind = (
        F.when(F.col("_text").isNull(), F.lit(None).cast("string"))
        .when(dated, F.lit("date"))
        .when(F.col("value_num").isNull(), F.lit("text"))
        .when(F.col("value_num") == F.floor("value_num"), F.lit("integer"))
        .otherwise(F.lit("decimal"))
    )
    return staged.withColumn("kind", kind).withColumns({
        "value_text": F.when(F.col("kind") == "text", F.col("_text")),
        "issue": F.when(dated & F.col("value_date").isNull(), F.lit("INVALID_DATE")),
    }).drop("_text", "_dated", "_bare")


def _month(text: Column, pattern: str) -> Column:
    month, year = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    start = F.when(text.rlike(pattern), _date(year, month, F.lit("1")))
    return F.when(
        start.isNotNull(),
        F.struct(
            F.lit("month").alias("kind"),
            start.alias("start"),
            F.last_day(start).alias("end"),
            F.date_format(start, "'Tháng' MM/yyyy").alias("label"),
        ),
    )


def report_month(text: Column, file_name: Column) -> Column:
    """Reporting month: the file name decides, else the first match in the text."""
    named = file_name.rlike(MONTH_IN_NAME)
    return F.when(named, _month(file_name, MONTH_IN_NAME)).otherwise(_month(text, MONTH_IN_TEXT))


def cell_month(text: Column) -> Column:
    return _month(text, MONTH_IN_CELL)


def organization(text: Column) -> Column:
    found = F.nullif(strip(F.regexp_extract(text, ORGANIZATION, 1)), F.lit(""))
    return F.coalesce(found, F.lit(UNKNOWN_ORGANIZATION))


def organization_id(name: Column) -> Column:
    return uuid5(label_key(name))


def has_synthetic_marker(text: Column, markers=SYNTHETIC_MARKERS) -> Column:
    upper = F.upper(text)
    found = F.lit(False)
    for marker in markers:
        found = found | upper.contains(marker)
    return F.coalesce(found, F.lit(False))
