"""Operators over whole tables in one piece: all vectors as queries, one document of all texts, stored
tables that change, files, and what is refused."""

import uuid

from pyspark.sql import functions as F

from reportlake.functions import ids, text
from reportlake.operators import blocks, bundle, chunks, reporting, search
from reportlake.operators.distribution import working_folder
from reportlake.operators.search import Filters, SearchMode
from reportlake.plans import adapters
from reportlake.plans.extract_queries import POPULATION, bundle_sources
from reportlake.plans.registry import query
from reportlake.plans.search_queries import ACTIVE, RESULT, sql_bm25, sql_dense, shown, vectors
from reportlake.settings import Chunking
from reportlake.sources import files, store


@query(
    f"""with v as (select vec_id as chunk_id, list_transform(embedding, lambda x: cast(x as double)) as vector from embeddings),
    q as (select chunk_id as query_id, vector from v), {sql_dense('list_inner_product(q.vector, v.vector)', 3)}
    select query_id, chunk_id, rank, round(score, 5) as score from dense"""
)
def dense_all(t):
    """The nearest three of every vector."""
    asked = vectors(t).select(F.col("chunk_id").alias("query_id"), "vector")
    best = search.dense_search(vectors(t), asked, k=3, distance="DOT")
    return best.select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


TARGET = 20_000


@query(
    f"""with recursive b as (select doc_id, length(text) as size, doc_id % 97 = 0 as opens, row_number() over (order by doc_id) as rn
      from documents where text is not null),
    walk as (select rn, 0 as g, size + 2 as used from b where rn = 1
      union all select b.rn, case when opens or used + size > {TARGET} then g + 1 else g end,
        case when opens or used + size > {TARGET} then size + 2 else used + size + 2 end from walk w join b on b.rn = w.rn + 1)
    select g as "group", cast(count(*) as integer) as n_blocks, min(doc_id) as first, max(doc_id) as last, cast(sum(size) as bigint) as size
    from walk join b using (rn) group by g"""
)
def pack_one_document(t):
    """All texts as the blocks of one document, with a boundary of the user's."""
    whole = t.documents.filter("text is not null").select(
        F.lit("all").alias("document_id"), F.col("doc_id").cast("string").alias("block_id"), F.lit("paragraph").alias("block_type"), "text",
        F.lit(None).cast("int").alias("page_number"), F.col("doc_id").alias("source_order"), F.lit(None).cast(blocks.TABLE_TYPE).alias("table"))
    kind = whole.select("document_id").limit(1).withColumn("document_type", F.lit("legal"))
    groups = chunks.pack(whole, kind, Chunking(target=TARGET), F.col("source_order") % 97 == 0)
    of = lambda f: F.transform("blocks", lambda b: f(b))
    order = of(lambda b: b["at"].cast("bigint"))
    return groups.select(
        "group", F.size("blocks").alias("n_blocks"), F.array_min(order).alias("first"), F.array_max(order).alias("last"),
        F.aggregate(of(lambda b: F.length(b["content"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))


POINTS = "document_id bigint, origin string, digest string"


@query(
    """select doc_id as document_id, case when doc_id % 3 = 0 then 'new' else 'old' end as origin, sha256(text) as digest from documents
    where (doc_id % 5 <> 0 or doc_id % 3 = 0) and doc_id not in (select doc_id from labels where toxic = 1)"""
)
def store_changes(t):
    """A keyed table on disk: four fifths of the documents are written, every third is written over or
    added, twice, and the toxic ones are deleted."""
    folder = f"{working_folder(t.spark)}/points-{uuid.uuid4().hex}"
    row = lambda df, origin: df.select(
        F.col("doc_id").alias("document_id"), F.lit(origin).alias("origin"), ids.checksum(F.col("text")).alias("digest"))
    store.upsert(row(t.documents.filter("doc_id % 5 <> 0"), "old"), folder, POINTS, ["document_id"])
    for _ in range(2):
        store.upsert(row(t.documents.filter("doc_id % 3 = 0"), "new"), folder, POINTS, ["document_id"])
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    store.delete_keys(toxic, folder, POINTS, "document_id")
    return store.read_keyed(t.spark, folder, POINTS)


@query(
    """select doc_id as document_id, case when toxic = 1 then 'deleted' else 'ready' end as status, case when toxic = 1 then 0 else 1 end as points
    from labels"""
)
def delete_lifecycle(t):
    """Deleting toxic documents drops their points and appends an event for each."""
    folder = f"{working_folder(t.spark)}/life-{uuid.uuid4().hex}"
    points = t.labels.select(F.col("doc_id").alias("document_id"), F.lit("p").alias("origin"), F.lit("").alias("digest"))
    store.upsert(points, f"{folder}/points", POINTS, ["document_id"])
    points.select(
        "document_id", F.lit("2026-01-01").cast("timestamp").alias("ts"), F.lit(1).cast("bigint").alias("seq"), F.lit("ready").alias("state"),
        F.lit(None).cast("string").alias("stage"), F.lit(1).cast("bigint").alias("chunk_count")).write.parquet(f"{folder}/events")
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("document_id"))
    store.delete_with_event(gone, f"{folder}/points", POINTS, f"{folder}/events", F.lit("2026-01-02").cast("timestamp"))
    states = store.lifecycle_states(t.spark.read.parquet(f"{folder}/events"))
    left = store.counts_per_document(store.read_keyed(t.spark, f"{folder}/points", POINTS))
    return states.join(left, "document_id", "left").select(
        "document_id", F.col("processing_status").alias("status"), F.coalesce("n", F.lit(0)).cast("int").alias("points"))


_REWRITTEN = sql_bm25(ACTIVE, 5).replace("from benchmark", """from (select item_id, 'nghị định ' || text as text from benchmark
  where item_id % 10 <> 3)""")


@query(f"with {_REWRITTEN} {RESULT} from lexical")
def retrieve_lexical(t):
    """The whole search with a rewriter; every tenth query is blank and refused."""
    asked = adapters.queries(t).withColumn(
        "query", F.when(F.col("query_id") % 10 == 3, F.lit(" \n ")).otherwise(F.concat(F.lit("  "), "query")))
    found = search.retrieve(
        adapters.corpus(t), asked, Filters.for_request(), SearchMode("lexical"), 5, 5, rerank=False,
        rewrite=lambda q: F.concat(F.lit("nghị định "), q))
    return shown(found)


_KIND = "case doc_id % 5 when 0 then 'pdf' when 1 then 'docx' when 2 then 'PDF' when 3 then 'xlsx' else 'txt' end"


def uploads(t):
    """Documents as files: every fifth is none of the supported kinds, half of the PDFs have no signature."""
    name = F.concat(F.lit("in/"), F.col("lang"), F.lit("/Văn bản "), F.col("doc_id").cast("string"), F.lit("."), F.expr(_KIND))
    body = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-")).otherwise(F.lit("")), F.coalesce("text", F.lit("")))
    content = body.cast("binary")
    return t.documents.filter("lang is not null").select(
        "doc_id", name.alias("path"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content"))


_UPLOADED = f"""select doc_id, lang, {_KIND} as kind, (case when doc_id % 2 = 0 then '%PDF-' else '' end) || coalesce(text, '') as body
  from documents where lang is not null"""


@query(
    f"""select doc_id, 'Văn bản ' || doc_id || '.' || kind as original_filename, 'Van_ban_' || doc_id || '.' || lower(kind) as stored_filename,
      lower(kind) as file_type, octet_length(encode(body))::bigint as file_size_bytes, sha256(body) as checksum_sha256,
      'doc-' || sha256(body)[1:16] as source_id, case when lower(kind) not in ('pdf', 'docx') then 'unsupported_extension'
        when octet_length(encode(body)) > 20000 then 'file_too_large' end as issue from ({_UPLOADED})"""
)
def inspect_uploads(t):
    given = uploads(t)
    found = files.inspect_documents(given, 20_000).drop("mime_type")
    return given.select("doc_id", "path").join(found, "path").drop("path")


@query(
    f"""select doc_id, case when octet_length(encode(body)) > 20000 then 'file_too_large'
      when lower(kind) = 'pdf' and left(body, 5) <> '%PDF-' then 'pdf_signature_mismatch'
      when lower(kind) = 'pdf' then null when lower(kind) = 'txt' then 'unsupported_type' else 'invalid_package' end as issue
    from ({_UPLOADED})"""
)
def file_safety(t):
    given = uploads(t)
    return given.select("doc_id", "path").join(files.file_issues(given, 20_000), "path").drop("path")


def shaped(t):
    """Documents as blocks: tables without data, blank blocks, rows wider than their headers, bad orders."""
    d = F.col("doc_id")
    row = lambda n: F.array_repeat(F.lit("x"), n)
    table = F.when(d % 6 < 2, F.struct(
        F.when(d % 12 == 1, F.concat(F.lit("Bảng "), d.cast("string"))).alias("name"), row(2).alias("headers"),
        F.array(row(2), row(2 + (d % 2).cast("int"))).alias("rows")).cast(blocks.TABLE_TYPE))
    return t.documents.select(
        d.cast("string").alias("document_id"), d.alias("doc_id"), F.lit("b0").alias("block_id"),
        F.when(d % 6 <= 2, "table").otherwise("paragraph").alias("block_type"),
        F.when(d % 6 == 3, F.lit(" \n")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        F.when(d % 6 == 4, -1).otherwise(0).alias("source_order"), table.alias("table"))


@query(
    """select cast(doc_id as varchar) as document_id, reason from (select doc_id, case when doc_id % 6 = 2 then 'table_without_data'
      when doc_id % 6 > 2 and (doc_id % 6 = 3 or regexp_full_match(coalesce(text, ''), '\\s*')) then 'block_without_content'
      when doc_id % 6 < 2 and doc_id % 2 = 1 then 'row_wider_than_headers' when doc_id % 6 = 4 then 'negative_order' end as reason
    from documents) where reason is not null"""
)
def block_shapes(t):
    return blocks.shape_issues(shaped(t)).drop("block_id")


@query(
    """select doc_id, concat_ws(chr(10), case when doc_id % 12 = 1 then 'Bảng ' || doc_id end, 'x | x', 'x | x',
      case when doc_id % 2 = 1 then 'x | x | x' else 'x | x' end) as table_text, left(replace(coalesce(text, ''), chr(10), ' '), 1000) as error_line
    from documents where doc_id % 6 < 2"""
)
def text_forms(t):
    """Tables and error messages as text."""
    found = shaped(t).filter("table is not null")
    return found.select("doc_id", text.table_text(F.col("table")).alias("table_text"), text.error_line(F.col("text")).alias("error_line"))


@query(
    """select cast(doc_id as varchar) as document_id, 'no_chunks' as issue from documents where doc_id % 7 = 0
    union all select cast(doc_id as varchar), 'blank_chunk' from documents where doc_id % 7 in (1, 2)
    union all select 'x' || doc_id, 'foreign_chunk' from documents where doc_id % 7 = 3"""
)
def chunk_checks(t):
    """Documents without chunks, blank chunks, chunks of unknown documents."""
    d = F.col("doc_id")
    known = t.documents.select(d.cast("string").alias("document_id"))
    made = t.documents.filter("doc_id % 7 <> 0").select(
        d.cast("string").alias("document_id"), F.when(d % 7 <= 2, " ").otherwise("text").alias("content"))
    foreign = t.documents.filter("doc_id % 7 = 3").select(F.concat(F.lit("x"), d.cast("string")).alias("document_id"), F.lit("text").alias("content"))
    return chunks.chunk_issues(made.unionByName(foreign), known)


@query(
    f"""with r as (select *, unit % 6 as m from ({POPULATION})), s(role, tag, k) as (values ('OPENING_BALANCE', '', 0), ('CIVIL_STATUS', '', 0),
      ('RESIDENCE_MOVEMENT', '', 1), ('OPENING_BALANCE', 'b', 2))
    select report_id as bundle_id, concat(report_id, '/', role, '/', tag) as source_file_id, role as source_role,
      cast(case when m = 3 and role = 'CIVIL_STATUS' then period_start + 1 else period_start end as varchar) as reporting_period, 'Xã ' || unit as organization_name
    from r, s where k = 0 or k = 1 and m <> 1 or k = 2 and m = 2"""
)
def source_rows(t):
    """The source rows among the records of all bundles."""
    sources, values = bundle_sources(t)
    records = bundle.source_records(sources, values)
    return reporting.population_source_rows(records).select(
        "bundle_id", "source_file_id", "source_role", "reporting_period", "organization_name")


@query(
    f"""with r as (select *, unit % 6 as m from ({POPULATION}))
    select 'population_source' as record_type, cast(sum(case when m = 1 then 2 when m = 2 then 4 else 3 end) as bigint) as n, null::hugeint::bigint as total from r
    union all select 'population_detail_count', cast(sum(case when m = 1 then 6 when m = 2 then 12 when m = 4 then 11 else 10 end) as bigint),
      cast(sum(population_opening + temporary_opening + birth_registered + birth_local_resident + death_registered + death_local_resident
        + case when m = 1 then 0 else permanent_in + permanent_out + temporary_new + temporary_removed end
        + case when m = 2 then population_opening + temporary_opening else 0 end + case when m = 4 then 999 else 0 end) as bigint) from r"""
)
def source_records(t):
    """Source rows and detail counts in one table of records."""
    sources, values = bundle_sources(t)
    return bundle.source_records(sources, values).groupBy("record_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
