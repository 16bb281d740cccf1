"""Blocks, structure, chunks, context and citations over the documents."""

import re

from pyspark.sql import functions as F

from reportlake.functions import text
from reportlake.operators import blocks, chunks, context, ordered, search
from reportlake.operators.distribution import materialize
from reportlake.operators.search import Filters
from reportlake.plans import adapters
from reportlake.plans.adapters import LINES, STRUCTURED_LINES
from reportlake.plans.registry import query
from reportlake.plans.search_queries import ACTIVE, sql_bm25
from reportlake.settings import Chunking


def re2(pattern: str) -> str:
    """A Java pattern of this package in the check's dialect."""
    flags = re.match(r"\(\?([a-zU]+)\)", pattern)
    body = pattern[flags.end():] if flags else pattern
    return ("(?i)" if flags and "i" in flags.group(1) else "") + body


def line_blocks(lines):
    return lines.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("b"), F.col("ord").cast("string")).alias("block_id"),
        F.lit("paragraph").alias("block_type"),
        F.col("line").alias("text"),
        "page_number",
        F.col("ord").alias("source_order"),
        F.lit(None).cast(blocks.TABLE_TYPE).alias("table"),
    )


def framed_lines(t):
    """Pages with a header, a page number, and their lines; one in seven documents numbers its
    header so that it must stay."""
    body = adapters.lines(t).withColumn("at", F.col("page_number") * 100 + F.col("ord") % 8 + 1)
    pages = body.select("doc_id", "page_number").distinct()
    header = F.when(F.col("doc_id") % 7 == 0, F.lit("Số: 12/QĐ-UBND"))
    header = header.otherwise(F.lit("UBND  TỈNH "))
    heads = pages.select("doc_id", "page_number", header.alias("line"),
                         (F.col("page_number") * 100).alias("at"))
    foot = F.concat(F.lit("- "), F.col("page_number").cast("string"), F.lit(" -"))
    feet = pages.select("doc_id", "page_number", foot.alias("line"),
                        (F.col("page_number") * 100 + 99).alias("at"))
    every = body.select("doc_id", "page_number", "line", "at").unionByName(heads).unionByName(feet)
    return line_blocks(every.withColumn("ord", F.col("at").cast("int")))


FRAMED = f"""framed as (
  select doc_id, page_number, line, page_number * 100 + ord % 8 + 1 as pos from ({LINES})
  union all select distinct doc_id, page_number, case when doc_id % 7 = 0 then 'Số: 12/QĐ-UBND'
    else 'UBND  TỈNH ' end, page_number * 100 from ({LINES})
  union all select distinct doc_id, page_number, concat('- ', page_number, ' -'),
    page_number * 100 + 99 from ({LINES})),
keyed as (select *, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) as cleaned from framed),
k2 as (select *, lower(replace(trim(regexp_replace(cleaned, '\\s+', ' ', 'g')), 'ß', 'ss')) as k
  from keyed),
edges as (select doc_id, page_number, unnest(list_distinct([lo, hi])) as pos from
  (select doc_id, page_number, min(pos) as lo, max(pos) as hi from k2 group by all)),
pagecount as (select doc_id, count(distinct page_number) as n from k2 group by doc_id),
repeated as (select e.doc_id, k, count(*) as occurrences from edges e join k2 using (doc_id, page_number, pos)
  join pagecount using (doc_id) where k <> '' and length(k) <= 160
  and not regexp_matches(k, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:Số|Số hiệu)\\s*:\\s*[\\p{{L}}\\p{{N}}_./-]+')
  group by e.doc_id, k, n having count(*) >= greatest(2, (n + 1) // 2) and n >= 2),
judged as (select k2.*, case when r.k is not null then 'repeated_page_edge_removed'
  when regexp_matches(cleaned, '(?i)^\\s*(?:[-–—]\\s*)?(?:trang\\s+)?\\d{{1,4}}(?:\\s*/\\s*\\d{{1,4}})?(?:\\s*[-–—])?\\s*$')
    then 'isolated_page_number_removed' when cleaned = '' then 'empty' end as removal
  from k2 left join repeated r on k2.doc_id = r.doc_id and k2.k = r.k)"""


@query(f"with {FRAMED} select cast(doc_id as varchar) as document_id, k as edge_key, occurrences from repeated")
def page_edges(t):
    return blocks.repeated_page_edges(framed_lines(t))


@query(
    f"""with {FRAMED} select cast(doc_id as varchar) as document_id, 'b' || pos as block_id,
      cast(row_number() over (partition by doc_id order by pos) - 1 as integer) as source_order,
      cleaned as text from judged where removal is null"""
)
def clean_blocks(t):
    kept = blocks.kept_blocks(materialize(blocks.judged_blocks(framed_lines(t))), tile=64)
    return kept.select("document_id", "block_id", "source_order", "text")


@query(
    f"""with {FRAMED} select cast(doc_id as varchar) as document_id, removal as code, pos as block_index,
      case removal when 'repeated_page_edge_removed'
      then 'Removed repeated header/footer: ' || substring(cleaned, 1, 80)
      else 'Removed isolated page marker: ' || cleaned end as message from judged
      where removal is not null and removal <> 'empty'"""
)
def cleaning_warnings(t):
    found = blocks.cleaning_warnings(blocks.judged_blocks(framed_lines(t)))
    return found.drop("page_number")


@query(
    """with l as (select doc_id, page_number, ord, trim(line) as line from ({lines})),
    n as (select doc_id, page_number, count(*) as n from l group by all),
    pages as (select doc_id, cast(unnest(range(1, p + 2)) as integer) as page_number, p + 1 as pages from
      (select doc_id, max(page_number) as p from l group by doc_id)),
    k as (select p.*, coalesce(n, 0) as n, coalesce(sum(coalesce(n, 0) + 1) over (partition by doc_id
      order by page_number rows between unbounded preceding and 1 preceding), 0) as off
      from pages p left join n using (doc_id, page_number))
    select cast(doc_id as varchar) as document_id, page_number, 'paragraph' as block_type,
      cast(off + row_number() over (partition by doc_id, page_number order by ord) - 1 as integer)
      as source_order from l join k using (doc_id, page_number)
    union all select cast(doc_id as varchar), page_number, 'page_break', cast(off + n as integer) from k
      where page_number < pages
    union all select cast(doc_id as varchar), page_number, 'empty_page', null from k where n = 0"""
    .format(lines=LINES)
)
def page_blocks(t):
    """Raw page texts; every document ends with a page without text."""
    raw = adapters.lines(t).select(
        F.col("doc_id").cast("string").alias("document_id"), "page_number",
        F.col("ord").alias("block_no"), F.col("line").alias("text"))
    last = raw.groupBy("document_id").agg((F.max("page_number") + 1).alias("page_count"))
    pages = last.select(
        "document_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page_number"), "page_count")
    numbered, warnings = blocks.page_blocks(raw, pages)
    empty = warnings.select("document_id", "page_number", F.col("code").alias("block_type"),
                            F.lit(None).cast("int").alias("source_order"))
    return numbered.select("document_id", "page_number", "block_type", "source_order").unionByName(empty)


_CASES = " ".join(
    f"when regexp_matches(l, '{re2(p)}') then {{{i}}}" for i, (_, _, p) in enumerate(text.STRUCTURE))
_LETTERS = r"length(regexp_replace(l, '\P{L}', '', 'g')) >= 4"
_HEADING = (
    rf"l <> '' and length(l) <= 140 and not regexp_matches(l, '[.;,]$') and {_LETTERS} and "
    rf"(regexp_matches(l, '{text.UPPER_LINE}') or regexp_matches(l, '{text.TITLE_LINE}'))")


def _classified(values: list[str], template: str, heading: str) -> str:
    cases = " ".join(
        f"when regexp_matches(l, '{re2(p)}') then {v}"
        for (_, _, p), v in zip(text.STRUCTURE, values))
    return (f"case when regexp_matches(l, '{re2(text.TEMPLATE_SECTION)}') then {template} {cases} "
            f"when {_HEADING} then {heading} end")


_KIND = _classified([f"'{k}'" for k, _, _ in text.STRUCTURE], "'template_section'", "'heading'")
_LEVEL = _classified([str(n) for _, n, _ in text.STRUCTURE], "2", "3")
_IDENT = _classified(
    [f"nullif(regexp_extract(l, '{re2(p)}', 1), '')" for _, _, p in text.STRUCTURE], "null", "null")
CLASSIFIED = f"""classified as (select *, {_KIND} as kind, cast({_LEVEL} as integer) as level, {_IDENT} as ident
  from (select *, trim(regexp_replace(line, '\\s+', ' ', 'g')) as l from ({STRUCTURED_LINES})))"""


@query(
    f"""with {CLASSIFIED} select doc_id, ord, kind, level, ident as identifier from classified
      where kind is not null"""
)
def structure_classes(t):
    squashed = adapters.structured_lines(t).withColumn("line", text.squash(F.col("line")))
    found = text.structural_lines(squashed, "line", "m")
    return found.select("doc_id", "ord", "m.kind", "m.level", "m.identifier")


_POS = ", ".join(
    f"coalesce(max(case when level = {n} then ord end) over w, -1) as p{n}, "
    f"last_value(case when level = {n} then l end ignore nulls) over w as l{n}, "
    f"last_value(case when level = {n} then ord end ignore nulls) over w as o{n}, "
    f"last_value(case when level = {n} then ident end ignore nulls) over w as i{n}"
    for n in range(1, 7))
_STANDS = {1: "p1 >= 0"} | {
    n: f"p{n} > greatest(-1, {', '.join(f'p{k}' for k in range(1, n))})" for n in range(2, 7)}
STRUCTURED = f"""{CLASSIFIED},
carried as (select *, {_POS} from classified
  window w as (partition by doc_id order by ord rows between unbounded preceding and current row)),
structured as (select doc_id, ord, page_number, line, l, coalesce(kind, 'paragraph') as block_type, level,
  list_filter([{', '.join(f'case when {_STANDS[n]} then l{n} end' for n in range(1, 7))}],
    lambda x: x is not null) as hierarchy, i4 as article, case when p5 > p4 then i5 end as clause,
  case when p6 > greatest(p4, p5) then i6 end as point,
  case when level is not null then coalesce({', '.join(
      f"case when {_STANDS[n]} and level > {n} then 'b' || o{n} end" for n in range(6, 0, -1))}) end as parent
  from carried)"""


def structured_blocks(t, tile=64):
    return blocks.propagate_structure(line_blocks(adapters.structured_lines(t)), tile=tile)


def structured_tiles(t, tile=64):
    """The same blocks, left in their tiles for the packing."""
    return blocks.propagate_structure(ordered.tiled(line_blocks(adapters.structured_lines(t)), "source_order", tile), tile=tile)


@query(
    f"""with {STRUCTURED} select cast(doc_id as varchar) as document_id, 'b' || ord as block_id, block_type,
      array_to_string(hierarchy, ' | ') as hierarchy, article, clause, point, parent as parent_block_id,
      level as heading_level from structured"""
)
def structure_propagation(t):
    """With small tiles, so that values cross tile borders."""
    found = structured_blocks(t)
    return found.select(
        "document_id", "block_id", "block_type", F.array_join("heading_hierarchy", " | ").alias("hierarchy"),
        "article", "clause", "point", "parent_block_id", "heading_level")


def document_kinds(t):
    return adapters.corpus(t).select(
        "document_id", "document_name", "document_type", "domain", "document_status")


_OPENS = " or ".join(
    f"(doc_id % 3 = {i} and block_type in ({', '.join(repr(b) for b in chunks.BOUNDARIES[kind])}))"
    for i, kind in enumerate(("legal", "guideline", "template")))
PACKED = f"""{STRUCTURED},
b as (select *, {_OPENS} as opens, length(line) as size,
  row_number() over (partition by doc_id order by ord) as rn from structured),
walk as (select doc_id, rn, 0 as g, size + 2 as used from b where rn = 1
  union all select b.doc_id, b.rn, case when opens or used + size > 1200 then g + 1 else g end,
    case when opens or used + size > 1200 then size + 2 else used + size + 2 end
  from walk w join b on b.doc_id = w.doc_id and b.rn = w.rn + 1),
grouped as (select b.doc_id, g, string_agg(trim(line), chr(10) || chr(10) order by ord) as body,
    count(*) as n, last(article order by ord) filter (article is not null) as article,
    last(clause order by ord) filter (clause is not null) as clause,
    last(point order by ord) filter (point is not null) as point,
    last(parent order by ord) filter (parent is not null) as parent,
    arg_max(hierarchy, len(hierarchy) * 100000 - ord) as hierarchy,
    array_to_string(list_sort(list(distinct page_number)), ',') as pages
  from walk w join b using (doc_id, rn) group by all)"""


@query(
    f"""with recursive {PACKED} select cast(doc_id as varchar) as document_id, cast(g as integer) as "group",
      body, cast(n as integer) as n_blocks, article, clause, point, parent as parent_block_id, array_to_string(hierarchy, ' | ') as hierarchy,
      pages from grouped"""
)
def chunk_pack(t):
    groups = chunks.pack(structured_tiles(t), document_kinds(t))
    meta = chunks.group_metadata(F.col("blocks"))
    return groups.select(
        "document_id", "group", chunks.render_group(F.col("blocks")).alias("body"),
        F.size("blocks").alias("n_blocks"), *[meta[c].alias(c) for c in (
            "article", "clause", "point", "parent_block_id")],
        F.array_join(meta["heading_hierarchy"], " | ").alias("hierarchy"),
        F.array_join(meta["page_numbers"].cast("array<string>"), ",").alias("pages"))


def _rfind(marker: str) -> str:
    """Zero-based place of the last marker in s, or -1."""
    return (f"case when strpos(s, {marker}) = 0 then -1 else length(s) - length({marker}) + 1 - "
            f"strpos(reverse(s), reverse({marker})) end")


def sql_segments(source: str) -> str:
    """CTEs: segments(id, n, segment) of source(id, body)."""
    mark = f"greatest({_rfind('chr(10) || chr(10)')}, {_rfind(repr('. '))}, {_rfind(repr('; '))})"
    stop = f"case when start + 1800 >= total then total when {mark} > 600 then start + {mark} + 1 else start + 1800 end"
    return f"""
cuts as (select id, 0 as n, start, stop, total from (select id, 0 as start, total,
    {stop} as stop from (select id, 0 as start, length(body) as total, substring(body, 1, 1800) as s from {source}))
  union all select id, n + 1, start, {stop} as stop, total from
    (select c.id, n, greatest(stop - 150, c.start + 1) as start, total,
      substring(body, greatest(stop - 150, c.start + 1) + 1, 1800) as s
     from cuts c join {source} using (id) where stop < total)),
segments as (select id, n, trim(substring(body, start + 1, stop - start), ' ' || chr(10) || chr(9) || chr(13)) as segment
  from cuts join {source} using (id))"""


@query(
    f"""with recursive src as (select doc_id as id, text as body from documents where length(text) > 0),
    {sql_segments('src')}
    select id as doc_id, cast(row_number() over (partition by id order by n) - 1 as integer) as segment_no,
      segment from segments where segment <> '' or n = 0"""
)
def chunk_split(t):
    """Whole document texts cut into overlapping segments."""
    whole = search.spread(t.documents.select("doc_id", "text").filter("length(text) > 0"))
    cut = whole.withColumn("segments", chunks.split_text(F.col("text")))
    return cut.select("doc_id", F.posexplode("segments").alias("segment_no", "segment"))


@query(
    f"""with recursive {PACKED}, src as (select doc_id || '/' || g as id, body from grouped where body <> ''),
    {sql_segments('src')},
    numbered as (select cast(doc_id as varchar) as document_id, g, s.n, segment, row_number() over (partition by doc_id
      order by g, s.n) - 1 as i from segments s join grouped on id = doc_id || '/' || g where segment <> '')
    select document_id, document_id || '-chunk-' || lpad(cast(i as varchar), 5, '0') as chunk_id,
      cast(i as integer) as chunk_index, segment as content, case when n > 0 then document_id || '-chunk-' ||
      lpad(cast(i - n as varchar), 5, '0') end as parent_chunk_id from numbered"""
)
def chunk_documents(t):
    made = chunks.chunk_documents(structured_tiles(t), document_kinds(t), Chunking())
    return made.select("document_id", "chunk_id", "chunk_index", "content", "parent_chunk_id")


# --- context and citations ----------------------------------------------------------------------

PAGES = f"""pages as (select doc_id, page_number, string_agg(line, chr(10) order by ord) as content
  from ({LINES}) group by all),
found as (select query_id, l.rank, l.chunk_id, l.score, split_part(l.chunk_id, '-', 1) as document_id from lexical l)"""


def candidates(t, k=5):
    """Best documents per passage, with the corpus columns."""
    found = search.bm25_search(
        adapters.corpus(t), adapters.queries(t), Filters.for_request(), k)
    return search.with_content(found, adapters.corpus(t))


def article_of(df):
    o = F.col("document_id").cast("bigint")
    return df.withColumns({
        "heading_hierarchy": F.when(o % 2 == 0, F.array(
            F.lit("Chương II"), F.lit("Mục 3"), F.concat(F.lit("Điều "), (o % 9).cast("string")))),
        "article": F.when(o % 2 == 0, (o % 9).cast("string")),
        "clause": F.when(o % 4 == 0, F.lit("2")),
        "page_numbers": F.when(o % 3 == 0, F.array((o % 5 + 1).cast("int"))),
    })


_SOURCE_BODY = """concat_ws(chr(10), 'Document ID: ' || document_id, 'Document: Document ' || document_id,
  'Document number: ' || document_number, 'Location: ' || case when o % 2 = 0 then 'Chương II, Mục 3, Điều ' || o % 9
    || case when o % 4 = 0 then ', Khoản 2' else '' end else '' end,
  'Page: ' || case when o % 3 = 0 then cast(o % 5 + 1 as varchar) else '' end, 'Chunk ID: ' || chunk_id, 'Content:', content)"""
BUDGET = 1500
CONTEXT = f"""{sql_bm25(ACTIVE, 20)},
items as (select *, {_SOURCE_BODY} as body, lower(replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), 'ß', 'ss')) as fp
  from (select query_id, rank, l.chunk_id, document_id, document_number, cast(document_id as bigint) as o, content
    from lexical l join kept using (chunk_id))),
fold as (select distinct query_id, 0 as rank, 0 as n, 0::bigint as used, false as truncated, []::varchar[] as fps,
    ''::varchar as rendered, false as taken from items
  union all select query_id, rank, case when take then n + 1 else n end, case when take then used + cost else used end,
    truncated or (not known and not fits), case when take then list_append(fps, fp) else fps end, text, take
  from (select *, list_contains(fps, fp) as known, used + cost <= {BUDGET} as fits,
      not list_contains(fps, fp) and used + cost <= {BUDGET} as take
    from (select f.query_id, i.rank, n, used, truncated, fps, i.fp, '[SOURCE_' || (n + 1) || ']' || chr(10) || body as text,
        greatest(1, (length('[SOURCE_' || (n + 1) || ']' || chr(10) || body) + 3) // 4) as cost
      from fold f join items i on i.query_id = f.query_id and i.rank = f.rank + 1))),
taken as (select f.query_id, n as source_number, i.chunk_id, i.document_id, rendered from fold f
  join items i on i.query_id = f.query_id and i.rank = f.rank where taken)"""


def contexts(t):
    return context.build_context(article_of(candidates(t, 20)), max_tokens=BUDGET)


@query(
    f"""with recursive {CONTEXT}, last as (select query_id, arg_max(n, rank) as n_sources, arg_max(used, rank) as used,
      arg_max(truncated, rank) as truncated from fold group by query_id)
    select l.query_id, cast(n_sources as integer) as n_sources, cast(used as integer) as estimated_tokens, truncated,
      coalesce(md5(string_agg(rendered, chr(10) || chr(10) order by source_number)), md5('')) as text_md5
    from last l left join taken using (query_id) group by all"""
)
def context_pack(t):
    _, built = contexts(t)
    return built.select(
        "query_id", "n_sources", "estimated_tokens", "truncated", F.md5("text").alias("text_md5"))


_CITED = f"""answers as (select query_id as answer_id, 'SOURCE_' || source_number as source_id, chunk_id, document_id
    from taken),
cited as (select query_id as answer_id, u.ord, 'SOURCE_' || u.s as source_id,
    case when query_id % 3 = 0 and u.s = 1 then 'other' when u.s = 1 then (select chunk_id from answers a
      where a.answer_id = query_id and a.source_id = 'SOURCE_1') end as chunk_id
  from (select distinct query_id from items), (values (0, 1), (1, 2), (2, 9), (3, 9), (4, 2)) u(ord, s)),
checked as (select c.*, case when a.source_id is null then 'source_id was not retrieved'
    when c.chunk_id <> a.chunk_id then 'chunk_id does not match source' end as reason
  from cited c left join answers a on c.answer_id = a.answer_id and c.source_id = a.source_id)"""


def citations(t):
    """Each passage's answer cites sources 1, 2, 9, 9, 2, the first with a chunk id, in every third
    answer a wrong one."""
    sources, _ = contexts(t)
    sources = sources.withColumnRenamed("query_id", "answer_id")
    first = sources.filter("source_number = 1").select("answer_id", F.col("chunk_id").alias("first"))
    places = F.posexplode(F.array(*[F.lit(s) for s in (1, 2, 9, 9, 2)])).alias("ord", "s")
    cited = first.select("answer_id", "first", places)
    chunk = F.when(F.col("s") == 1, F.when(F.col("answer_id") % 3 == 0, "other").otherwise(F.col("first")))
    none = F.lit(None).cast("string")
    return sources, cited.select(
        "answer_id", "ord", F.concat(F.lit("SOURCE_"), "s").alias("source_id"), chunk.alias("chunk_id"),
        none.alias("document_id"), none.alias("document_name"))


@query(
    f"""with recursive {CONTEXT}, {_CITED} select answer_id, min(ord) as ord, source_id, reason from checked
      group by answer_id, source_id, reason, case when reason is null then chunk_id end"""
)
def citation_check(t):
    sources, cited = citations(t)
    return context.check_citations(cited, sources).select("answer_id", "ord", "source_id", "reason")


@query(
    f"""with recursive {CONTEXT}, {_CITED}, w as (select c.answer_id, c.ord, c.source_id, a.source_id is not null as ok
      from cited c left join answers a on c.answer_id = a.answer_id and c.source_id = a.source_id)
    select answer_id, coalesce(string_agg(source_id, ',' order by ord) filter (ok), '') as used_source_ids,
      bool_or(not ok) as human_review_required from w group by answer_id"""
)
def answer_sources(t):
    sources, cited = citations(t)
    answers = cited.groupBy("answer_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "source_id"))), lambda s: s["source_id"]
    ).alias("used_source_ids"))
    done = context.supported_answers(answers, sources)
    return done.withColumn("used_source_ids", F.array_join("used_source_ids", ","))


PARENT_BUDGET = 2500


def page_chunks(t):
    """A chunk per page; the first page of a document is the parent of its others; in every fifth
    document that parent is missing."""
    rows = adapters.lines(t).groupBy("doc_id", "page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))),
                                 lambda x: x["line"]), "\n").alias("content"))
    doc = F.col("doc_id").cast("string")
    name = F.concat(doc, F.lit("/"), F.col("page_number").cast("string"))
    parent = F.when(F.col("page_number") > 1, F.concat(
        doc, F.when(F.col("doc_id") % 5 == 0, F.lit("/0")).otherwise(F.lit("/1"))))
    return rows.select(
        doc.alias("document_id"), name.alias("chunk_id"), "page_number", parent.alias("parent_chunk_id"),
        "content", (F.col("doc_id") % 50).alias("query_id"))


PARENTS = f"""pg as (select cast(doc_id as varchar) as document_id, doc_id || '/' || page_number as chunk_id,
    case when page_number > 1 then doc_id || case when doc_id % 5 = 0 then '/0' else '/1' end end as parent_id, content,
    doc_id % 50 as query_id from (select doc_id, page_number, string_agg(line, chr(10) order by ord) as content
      from ({LINES}) group by all)),
c as (select * from (select *, row_number() over (partition by query_id order by sha256(chunk_id)) as rank from pg)
  where rank <= 10),
i as (select c.*, p.content as parent_content, greatest(1, (length(c.content) + 3) // 4) as cost,
    greatest(1, (length(p.content) + 3) // 4) as pcost from c left join pg p on c.document_id = p.document_id
    and c.parent_id = p.chunk_id),
fold as (select query_id, 0::bigint as rank, sum(cost)::bigint as used, list(chunk_id) as seen, ''::varchar as outcome from i group by query_id
  union all select query_id, rank, case when o = 'added' then used + pcost else used end,
    case when o = 'added' then list_append(seen, parent_id) else seen end, o
  from (select i.query_id, i.rank, used, seen, parent_id, pcost, case
      when parent_id is null or list_contains(seen, parent_id) then 'none' when parent_content is null then 'unavailable'
      when used + pcost > {PARENT_BUDGET} then 'omitted' else 'added' end as o
    from fold f join i on i.query_id = f.query_id and i.rank = f.rank + 1))"""


@query(
    f"""with recursive {PARENTS} select query_id, cast(rank * 2 as integer) as position, chunk_id, false as is_parent, null as message from i
    union all select f.query_id, cast(f.rank * 2 + 1 as integer), parent_id, true, null from fold f
      join i on i.query_id = f.query_id and i.rank = f.rank where outcome = 'added'
    union all select f.query_id, null, i.chunk_id, null, case outcome when 'unavailable' then 'Parent chunk unavailable for '
      else 'Parent chunk omitted by token budget for ' end || chunk_id from fold f
      join i on i.query_id = f.query_id and i.rank = f.rank where outcome in ('unavailable', 'omitted')"""
)
def parent_expand(t):
    """Ten pages per group of documents as candidates, ordered by a checksum."""
    corpus = page_chunks(t)
    ranked = search.rank_by(corpus.withColumn("h", F.sha2("chunk_id", 256)), [F.asc("h")], 10)
    rows, warnings = context.expand_parents(ranked, corpus, PARENT_BUDGET)
    notes = warnings.select(
        "query_id", F.lit(None).cast("int").alias("position"),
        F.regexp_extract("message", r"(\S+)$", 1).alias("chunk_id"),
        F.lit(None).cast("boolean").alias("is_parent"), "message")
    return rows.select("query_id", "position", "chunk_id", "is_parent").withColumn(
        "message", F.lit(None).cast("string")).unionByName(notes)
