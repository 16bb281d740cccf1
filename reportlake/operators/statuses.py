"""Task statuses: a dimension with flags, and older names resolved through chains of renames."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportlake.functions.text import label_key
from reportlake.operators.distribution import materialize
from reportlake.operators.rules import ERROR, WARNING, Rule, issues_of

# Code, label, terminal, completion date required, completion result required.
STATUSES = (
    ("NOT_STARTED", "Chưa thực hiện", False, False, False),
    ("IN_PROGRESS", "Đang thực hiện", False, False, False),
    ("COMPLETED_ON_TIME", "Hoàn thành đúng hạn", True, True, True),
    ("COMPLETED_LATE", "Hoàn thành quá hạn", True, True, True),
    ("OVERDUE", "Quá hạn chưa hoàn thành", False, False, False),
    ("SUSPENDED", "Tạm dừng", False, False, False),
)
# Older names that stand for one status.
LEGACY = (("not_started", "NOT_STARTED"), ("in_progress", "IN_PROGRESS"), ("on_hold", "SUSPENDED"))
# Older names that dates decide.
COMPLETED, DELAYED = "completed", "delayed"


def status_table(spark: SparkSession) -> DataFrame:
    """The fixed dimension, one row per code."""
    return spark.createDataFrame(
        STATUSES, "status_code string, status_label string, is_terminal boolean, requires_date boolean, requires_result boolean")


def resolve_aliases(aliases: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """aliases (alias, target), codes (code): ((alias, code, steps), (alias, issue)).

    A target may be another alias. Every round replaces a target by its own target, so a chain of n
    renames takes log2(n) rounds. As long as a chain is left, its next names end in the next round; where
    no fewer names move than in the round before, all that move are in or behind a cycle. Names that end nowhere are reported, and so are those in or behind a
    cycle, and names with several targets, which resolve to nothing."""
    given = aliases.filter("alias is not null and target is not null").distinct()
    count = given.groupBy("alias").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    unclear = count.filter("n > 1").select("alias", F.lit("ALIAS_AMBIGUOUS").alias("issue"))
    final = codes.select(F.col("code").alias("target")).distinct()
    links = count.filter("n = 1").select("alias", "target", F.lit(1).cast("bigint").alias("steps"))
    # A code is never renamed.
    links = materialize(links.join(final.withColumnRenamed("target", "alias"), "alias", "left_anti"), even=False)
    moving = None
    while moving != 0:
        step = links.select(F.col("alias").alias("target"), F.col("target").alias("next"), F.col("steps").alias("more"))
        # Sizes of compressed files say little of what a broadcast would take.
        joined = links.join(step.hint("merge"), "target", "left")
        links = materialize(joined.select(
            "alias", F.coalesce("next", "target").alias("target"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("next").isNotNull().alias("moved")), even=False)
        moved, links = links.filter("moved").count(), links.drop("moved")
        moving = 0 if moved == moving else moved
    done = links.join(final, "target", "left_semi").select("alias", F.col("target").alias("code"), "steps")
    names = links.select(F.col("alias").alias("target")).hint("merge")
    rest = links.join(final, "target", "left_anti")
    # What still points at a name that is renamed itself goes round.
    round_ = rest.join(names, "target", "left_semi")
    open_ = rest.join(names, "target", "left_anti")
    issues = unclear.unionByName(round_.select("alias", F.lit("ALIAS_CYCLE").alias("issue"))).unionByName(
        open_.select("alias", F.lit("ALIAS_UNKNOWN_TARGET").alias("issue")))
    return done, issues


def dated_status(key: Column, due: Column, completed: Column) -> Column:
    """The status that dates decide for `completed` and `delayed`; null where they do not decide."""
    late = F.when(completed > due, "COMPLETED_LATE").when(completed <= due, "COMPLETED_ON_TIME")
    return F.when(key == COMPLETED, late).when(
        key == DELAYED, F.when(completed.isNull(), "OVERDUE").when(completed > due, "COMPLETED_LATE"))


def with_status(tasks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """tasks (status, due_date, completion_date, …) with status_code, status_label and the flags.

    A status is read as a code, a label, an older name or an alias; case and spaces do not count. Both
    dimensions are small, their rows are the names of statuses."""
    spark = tasks.sparkSession
    table = status_table(spark)
    names = table.select(label_key(F.col("status_code")).alias("name"), F.col("status_code").alias("code")).unionByName(
        table.select(label_key(F.col("status_label")).alias("name"), F.col("status_code").alias("code")))
    legacy = spark.createDataFrame(LEGACY, "name string, code string")
    names = names.unionByName(legacy.join(names, "name", "left_anti"))
    if aliases is not None:
        keyed = aliases.select(label_key(F.col("alias")).alias("alias"), label_key(F.col("target")).alias("target"))
        ends = names.select(F.col("name").alias("code"))
        ends = ends.unionByName(spark.createDataFrame([(COMPLETED,), (DELAYED,)], "code string"))
        done, _ = resolve_aliases(keyed, ends)
        renamed = done.select(F.col("alias").alias("name"), F.col("code").alias("_to"))
        tasks = tasks.withColumn("_key", label_key(F.col("status"))).join(renamed, F.col("_key") == F.col("name"), "left").drop("name")
        tasks = tasks.withColumn("_key", F.coalesce("_to", "_key")).drop("_to")
    else:
        tasks = tasks.withColumn("_key", label_key(F.col("status")))
    dated = dated_status(F.col("_key"), F.col("due_date"), F.col("completion_date"))
    known = tasks.join(F.broadcast(names), F.col("_key") == F.col("name"), "left").drop("name")
    coded = known.withColumn("_code", F.coalesce(F.col("code"), dated)).drop("code", "_key")
    return coded.join(F.broadcast(table), F.col("_code") == F.col("status_code"), "left").drop("_code")


def requirement_rules() -> list[Rule]:
    """What a status asks of its task, after `with_status`."""
    date, result = F.col("completion_date"), F.trim(F.coalesce(F.col("completion_result"), F.lit("")))
    return [
        Rule("TASK_STATUS_UNKNOWN", F.col("status").isNotNull() & F.col("status_code").isNull(), "status", WARNING),
        Rule("TASK_STATUS_REQUIRES_COMPLETION_DATE", F.col("requires_date") & date.isNull(), "completion_date", ERROR),
        Rule("TASK_STATUS_REQUIRES_COMPLETION_RESULT", F.col("requires_result") & (result == ""), "completion_result", ERROR),
        Rule("TASK_STATUS_EXCLUDES_COMPLETION_DATE", ~F.col("is_terminal") & date.isNotNull(), "completion_date", WARNING),
    ]


def status_issues(tasks: DataFrame) -> DataFrame:
    """Tasks after `with_status`, with an `issues` array of the requirements they miss."""
    return tasks.withColumn("issues", issues_of(requirement_rules()))
