"""The given tables seen as reports, tasks and a searchable corpus.

Texts in braces are table names; Spark and the SQL checks share these statements."""

from pyspark.sql import DataFrame, functions as F

from reportlake.operators.distribution import spread
from reportlake.plans.registry import Tables

CORPUS = """
select cast(doc_id as string) as document_id,
  concat(cast(doc_id as string), '-chunk-00000') as chunk_id,
  concat('Document ', cast(doc_id as string)) as document_name,
  case doc_id % 3 when 0 then 'legal' when 1 then 'guideline' else 'template' end as document_type,
  case doc_id % 4 when 0 then 'population' when 1 then 'complaints' when 2 then 'tasks'
    else 'common' end as domain,
  case doc_id % 10 when 0 then 'expired' when 1 then 'draft' else 'active' end as document_status,
  concat(cast(doc_id % 90 + 10 as string), '/2024/QD-', cast(doc_id % 7 as string))
    as document_number,
  case when doc_id % 7 <> 0 then date '2024-01-01' + cast(doc_id % 365 as int) end
    as effective_date,
  case when doc_id % 5 = 0 then date '2024-07-01' + cast(doc_id % 365 as int) end as expiry_date,
  text as content
from {documents}
"""

POPULATION = """
with e as (
  select user_id % 20 as unit, cast(date_trunc('week', ts) as date) as period_start,
    event_id, event_type, value from {events}),
a as (select unit, period_start,
  1000 + 100 * unit as population_opening, 100 + unit as temporary_opening,
  count_if(event_type = 'signup') as birth_registered,
  count_if(event_type = 'signup' and value < 50) as birth_local_resident,
  count_if(event_type = 'error') as death_registered,
  count_if(event_type = 'error' and value < 50) as death_local_resident,
  count_if(event_type = 'view') as permanent_in, count_if(event_type = 'click') as permanent_out,
  count_if(event_type = 'purchase' and event_id % 2 = 0) as temporary_new,
  count_if(event_type = 'purchase' and event_id % 2 = 1) as temporary_removed
  from e group by unit, period_start)
select concat(cast(unit as string), '/', cast(period_start as string)) as report_id,
  case when unit % 7 = 6 then 'OFFICIAL_CANDIDATE' else 'SYNTHETIC_TEST_DATA' end as classification,
  a.*,
  population_opening + birth_local_resident + permanent_in - death_local_resident - permanent_out
    + case when (unit + day(period_start)) % 5 = 0 then 1 else 0 end as population_closing,
  temporary_opening + temporary_new - temporary_removed as temporary_closing
from a
"""

COMPLAINTS = """
select concat(cast(c.c_nationkey as string), '/',
    cast(cast(date_trunc('month', o_orderdate) as date) as string)) as report_id,
  'SYNTHETIC_TEST_DATA' as classification,
  c.c_nationkey as unit, cast(date_trunc('month', o_orderdate) as date) as period_start,
  count(*) + case when c.c_nationkey % 6 = 0 then 1 else 0 end as received_cases,
  count_if(o_orderpriority like '1%' or o_orderpriority like '2%') as complaint_cases,
  count_if(o_orderpriority like '3%') as denunciation_cases,
  count_if(o_orderpriority like '4%' or o_orderpriority like '5%') as petition_cases,
  count_if(o_orderstatus <> 'P') as within_authority,
  count_if(o_orderstatus = 'P') as outside_authority,
  count_if(o_orderstatus = 'F') as resolved_cases
from {orders} o join {customer} c on o.o_custkey = c.c_custkey
group by c.c_nationkey, cast(date_trunc('month', o_orderdate) as date)
"""

TASKS = """
select concat('NV-', cast(o_orderkey as string)) as task_id,
  concat('Task ', cast(o_orderkey as string)) as task_description,
  case when o_custkey % 50 <> 0 then concat('unit-', cast(o_custkey % 25 as string)) end
    as lead_unit,
  cast(o_orderdate as date) as assignment_date, cast(o_orderdate as date) + 60 as due_date,
  case when o_orderstatus = 'F' then cast(max(l_shipdate) as date) end as completion_date,
  case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then 120
    else cast(floor(100 * count_if(l_linestatus = 'F') / count(*)) as int) end as progress_percent,
  case o_orderstatus when 'F' then 'hoàn thành' when 'P' then 'đang thực hiện' else 'quá hạn' end
    as status,
  case when o_orderstatus = 'F' and o_orderkey % 11 <> 0 then 'done' end as completion_result
from {orders} join {lineitem} on o_orderkey = l_orderkey
group by o_orderkey, o_custkey, o_orderdate, o_orderstatus
"""


def corpus(t: Tables) -> DataFrame:
    return t.sql(CORPUS, "documents")


def population_reports(t: Tables) -> DataFrame:
    return t.sql(POPULATION, "events")


def complaint_reports(t: Tables) -> DataFrame:
    return t.sql(COMPLAINTS, "orders", "customer")


def tasks(t: Tables) -> DataFrame:
    return t.sql(TASKS, "orders", "lineitem")


def queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lines(t: Tables) -> DataFrame:
    """Text lines of the documents on pages of eight lines, blank ones left out."""
    texts = spread(t.documents.select("doc_id", "text"), "doc_id")
    split = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return split.filter(F.trim("line") != "").withColumn(
        "page_number", (1 + F.floor(F.col("ord") / 8)).cast("int")
    )


def structured_lines(t: Tables) -> DataFrame:
    """Lines with synthetic structure labels in front."""
    o = F.col("ord")
    label = (
        F.when(o % 40 == 0, F.lit("Chương II "))
        .when(o % 10 == 0, F.concat(F.lit("Điều "), o.cast("string"), F.lit(". ")))
        .when(o % 5 == 0, F.concat(o.cast("string"), F.lit(". ")))
        .when(o % 5 == 1, F.lit("a) "))
        .otherwise(F.lit(""))
    )
    return lines(t).withColumn("line", F.concat(label, "line"))


TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(statement: str) -> str:
    """An adapter statement with plain table names."""
    return statement.format(**{name: name for name in TABLE_NAMES})


# SQL of the line adapters, for the checks.
LINES = """
select doc_id, ord, line, cast(1 + (ord // 8) as integer) as page_number from (
  select doc_id, unnest(string_split(text, chr(10))) as line,
    cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as integer) as ord
  from documents)
where trim(line) <> ''
"""

STRUCTURED_LINES = f"""
select doc_id, ord, page_number, case when ord % 40 = 0 then 'Chương II '
  when ord % 10 = 0 then 'Điều ' || ord || '. ' when ord % 5 = 0 then ord || '. '
  when ord % 5 = 1 then 'a) ' else '' end || line as line
from ({LINES})
"""
