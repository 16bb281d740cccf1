"""KPI catalogue per domain, task KPIs and indicator roll-ups."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions.scalars import to_decimal
from reportlake.operators.rules import with_numbers
from reportlake.settings import SYNTHETIC

# How each indicator is combined over periods.
INDICATORS = (
    ("POP_TOTAL", "population", "population_total", "last_value"),
    ("POP_TEMPORARY", "population", "population_temporary", "sum"),
    ("COM_RECEIVED", "complaints", "received_cases", "sum"),
    ("COM_RESOLVED", "complaints", "resolved_cases", "sum"),
    ("TASK_TOTAL", "tasks", "task_id", "count"),
    ("TASK_OVERDUE", "tasks", "status", "count"),
)
COMPLETED = ("COMPLETED_ON_TIME", "COMPLETED_LATE")


def _value(name: str) -> Column:
    return F.col(f"_n_{name}").try_cast("decimal(24,4)")


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100, whole).cast("decimal(38,10)")


def kpi_columns(domain: str, columns: list[str]) -> dict[str, tuple[Column, list[str], str | None]]:
    """KPI id -> (value, source fields, denominator field) for a wide report table."""
    v = _value
    if domain == "population" and "population_opening" in columns:
        change = v("population_closing") - v("population_opening")
        result = {
            "population_net_change": (change, ["population_opening", "population_closing"], None),
            "population_change_rate_percent": (
                _percent(change, v("population_opening")),
                ["population_opening", "population_closing"], "population_opening",
            ),
            "permanent_net_migration": (
                v("permanent_in") - v("permanent_out"), ["permanent_in", "permanent_out"], None),
            "temporary_net_change": (
                v("temporary_closing") - v("temporary_opening"),
                ["temporary_opening", "temporary_closing"], None),
        }
        for event in ("birth", "death"):
            registered, local = f"{event}_registered", f"{event}_local_resident"
            result |= {
                f"{event}_registered_count": (v(registered), [registered], None),
                f"{event}_local_resident_count": (v(local), [local], None),
                f"{event}_registered_outside_local_residence": (
                    v(registered) - v(local), [registered, local], None),
            }
        return result
    if domain == "population":
        change = v("population_total") - v("population_start")
        fields = ["population_start", "population_total"]
        return {
            "population_net_change": (change, fields, None),
            "population_change_rate_percent": (
                _percent(change, v("population_start")), fields, "population_start"),
        }
    if domain == "complaints":
        return {
            "complaint_resolution_rate_percent": (
                _percent(v("resolved_cases"), v("received_cases")),
                ["resolved_cases", "received_cases"], "received_cases"),
        }
    return {
        "task_completion_rate_percent": (
            _percent(v("completed_on_time") + v("completed_late"), v("task_total")),
            ["completed_on_time", "completed_late", "task_total"], "task_total"),
        "task_average_progress_percent": (
            v("average_progress"), ["average_progress"], None),
    }


def catalogue_kpis(reports: DataFrame, domain: str) -> DataFrame:
    """(report_id, kpi_id, value, issue): null with an issue for official data, a missing field or
    a zero denominator."""
    official = ~F.coalesce(F.col("classification") == SYNTHETIC, F.lit(False))
    entries, defined = [], kpi_columns(domain, reports.columns)
    staged = with_numbers(reports, sorted({f for _, fields, _ in defined.values() for f in fields}))
    for kpi_id, (value, fields, denominator) in defined.items():
        missing = F.lit(False)
        for field in fields:
            missing = missing | _value(field).isNull()
        problem = F.when(official, "OFFICIAL_DEFINITIONS_NOT_APPROVED").when(missing, "FIELD_MISSING")
        if denominator:
            problem = problem.when(_value(denominator) == 0, "ZERO_DENOMINATOR")
        entries.append(
            F.struct(
                F.lit(kpi_id).alias("kpi_id"),
                F.when(problem.isNull(), value.cast("decimal(38,10)")).alias("value"),
                problem.alias("issue"),
            )
        )
    return staged.select("report_id", F.explode(F.array(*entries)).alias("k")).select(
        "report_id", "k.*"
    )


def task_kpis(tasks: DataFrame, group: list[str]) -> DataFrame:
    """Task KPIs per group over (task_id, status_code, validation_status, progress_percent).

    Two levels: distinct tasks first, so that one hot group is spread over its task ids."""
    progress = to_decimal(F.col("progress_percent"))
    usable = F.when(progress.between(0, 100), progress.cast("decimal(18,4)"))
    per_task = tasks.groupBy(*group, "task_id").agg(
        F.max(F.when(F.col("validation_status") != "ERROR", 1)).alias("valid"),
        F.count_if(F.col("status_code").isin(*COMPLETED)).alias("done"),
        F.count_if(F.col("status_code") == "COMPLETED_ON_TIME").alias("on_time"),
        F.count_if(F.col("status_code") == "OVERDUE").alias("overdue"),
        F.sum(usable).alias("progress"),
        F.count(usable).alias("n_progress"),
        F.count("*").alias("n"),
    )
    totals = per_task.groupBy(*group).agg(
        F.count("valid").alias("total_valid_tasks"),
        F.sum("done").alias("completed_tasks"),
        F.sum("on_time").alias("completed_on_time_tasks"),
        F.sum("overdue").alias("overdue_unfinished_tasks"),
        F.sum("progress").alias("progress"),
        F.sum("n_progress").alias("n_progress"),
        F.sum("n").alias("n"),
    )
    c = F.col
    return totals.select(
        *group, "total_valid_tasks", "completed_tasks", "completed_on_time_tasks",
        "overdue_unfinished_tasks",
        _percent(c("completed_tasks"), c("total_valid_tasks")).alias("completion_rate_percent"),
        _percent(c("completed_on_time_tasks"), c("completed_tasks")).alias(
            "on_time_completion_rate_percent"),
        _percent(c("overdue_unfinished_tasks"), c("total_valid_tasks")).alias("overdue_rate_percent"),
        F.try_divide(c("progress"), c("n_progress")).cast("decimal(38,10)").alias(
            "average_progress_percent"),
        (c("n") - c("n_progress")).alias("missing_progress_count"),
        F.array_compact(F.array(
            F.when(c("total_valid_tasks") == 0, F.lit("ZERO_DENOMINATOR:completion_rate_percent")),
            F.when(c("completed_tasks") == 0,
                   F.lit("ZERO_DENOMINATOR:on_time_completion_rate_percent")),
            F.when(c("total_valid_tasks") == 0, F.lit("ZERO_DENOMINATOR:overdue_rate_percent")),
        )).alias("warnings"),
    )


def indicator_rollup(values: DataFrame, indicators: DataFrame, group: list[str]) -> DataFrame:
    """values (group…, domain, field, period_end, value) combined by each indicator's own rule.

    All three rules are computed in one partial aggregation; the indicator picks its result."""
    combined = values.groupBy(*group, "domain", "field").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("period_end"))).alias("last"),
        F.sum("value").alias("sum"),
        F.count("value").alias("count"),
    )
    rule = F.col("aggregation")
    picked = (
        F.when(rule == "last_value", F.col("last"))
        .when(rule == "sum", F.col("sum"))
        .when(rule == "count", F.col("count"))
    )
    return combined.join(indicators, ["domain", "field"]).select(
        *group, "indicator_code", "aggregation", picked.cast("decimal(38,10)").alias("value")
    )


def indicator_table(spark) -> DataFrame:
    return spark.createDataFrame(
        INDICATORS, "indicator_code string, domain string, field string, aggregation string"
    )


def rendered(kpis: DataFrame) -> DataFrame:
    """KPI values as text without trailing zeros."""
    text = F.regexp_replace(
        F.regexp_replace(F.col("value").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return kpis.withColumn("value", text)
