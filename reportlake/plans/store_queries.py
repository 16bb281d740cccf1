"""Masking, identifiers, reporting, inventories, stored tables and streams over the given tables."""

import uuid

from pyspark.sql import functions as F

from reportlake.functions import ids, scalars, text, vectors
from reportlake.operators import chunks, inventory, reporting, rules
from reportlake.operators.distribution import spread, working_folder
from reportlake.operators.search import Filters
from reportlake.plans import adapters
from reportlake.plans.registry import query
from reportlake.sources import store
from reportlake.streaming import ingest

POPULATION = adapters.plain(adapters.POPULATION)
CORPUS = adapters.plain(adapters.CORPUS)

# --- text ---------------------------------------------------------------------------------------

_TAIL = """ | tel 0901234567 or +84 912 345 678x, id 012345678901, Api-Key: s3cr3t, C:\\tmp\\a b"""
_MASK_SQL = [
    r"(?:\+84|0)(?:[0-9][ .-]?){8,10}", r"[0-9]{12}",
    r"(?i)(?:api[_ -]?key|authorization)\s*[:=]\s*\S+", r"(?i)\b[A-Z]:\\[^\r\n]+",
]


def dirty_texts(t):
    """Texts with personal data appended to every fifth one, and some classified ones."""
    tail = F.when(F.col("doc_id") % 5 == 0, F.lit(_TAIL)).otherwise(F.lit(""))
    head = F.when(F.col("doc_id") % 11 == 0, F.lit("  Tuyệt  mật \n")).otherwise(F.lit(""))
    return t.documents.select("doc_id", F.concat(head, "text", tail).alias("text"))


@query(
    """with recursive src as (select doc_id, case when doc_id % 11 = 0 then '  Tuyệt  mật ' || chr(10) else '' end || text ||
      case when doc_id % 5 = 0 then '""" + _TAIL + """' else '' end as text from documents),
    borders as (select *, regexp_matches(text, '(?im)^\\s*(?:tuyệt\\s+mật|tối\\s+mật|mật)\\s*$') as blocked,
      regexp_replace(text, '(^|[^0-9])((?:\\+84|0)(?:[0-9][ .-]?){8,10})($|[^0-9])', '\\1' || chr(1) || '\\3', 'g') as a
      from src),
    b as (select *, regexp_replace(a, '(^|[^0-9])[0-9]{12}($|[^0-9])', '\\1' || chr(2) || '\\2', 'g') as b from borders),
    c as (select *, regexp_replace(b, '(?i)(?:api[_ -]?key|authorization)\\s*[:=]\\s*\\S+', chr(3), 'g') as c from b),
    d as (select *, regexp_replace(c, '(?i)\\b[A-Z]:\\\\[^\\r\\n]+', chr(4), 'g') as d from c),
    n as (select *, len(d) - len(replace(d, chr(1), '')) as n1, len(d) - len(replace(d, chr(2), '')) as n2,
      len(d) - len(replace(d, chr(3), '')) as n3, len(d) - len(replace(d, chr(4), '')) as n4 from d),
    w as (select doc_id, d as s, 0 as step, n1, n2, n3, n4 from n
      union all select doc_id, case
        when strpos(s, chr(1)) > 0 then substring(s, 1, strpos(s, chr(1)) - 1) || '[PHONE_' ||
          (len(s) - len(replace(s, chr(1), ''))) || ']' || substring(s, strpos(s, chr(1)) + 1)
        when strpos(s, chr(2)) > 0 then substring(s, 1, strpos(s, chr(2)) - 1) || '[IDENTIFIER_' ||
          (n1 + len(s) - len(replace(s, chr(2), ''))) || ']' || substring(s, strpos(s, chr(2)) + 1)
        when strpos(s, chr(3)) > 0 then substring(s, 1, strpos(s, chr(3)) - 1) || '[SECRET_' ||
          (n1 + n2 + len(s) - len(replace(s, chr(3), ''))) || ']' || substring(s, strpos(s, chr(3)) + 1)
        else substring(s, 1, strpos(s, chr(4)) - 1) || '[LOCAL_PATH_' ||
          (n1 + n2 + n3 + len(s) - len(replace(s, chr(4), ''))) || ']' || substring(s, strpos(s, chr(4)) + 1) end,
        step + 1, n1, n2, n3, n4 from w
      where regexp_matches(s, '[' || chr(1) || chr(2) || chr(3) || chr(4) || ']'))
    select n.doc_id, not blocked as allowed, case when blocked then '' else arg_max(s, step) end as redacted_text,
      case when blocked then 'restricted_or_classified_content' else concat_ws(',', case when n.n1 > 0 then 'masked_phone' end,
      case when n.n2 > 0 then 'masked_identifier' end, case when n.n3 > 0 then 'masked_secret' end,
      case when n.n4 > 0 then 'masked_local_path' end) end as reasons
    from n join w using (doc_id) group by n.doc_id, blocked, n.n1, n.n2, n.n3, n.n4"""
)
def mask_pii(t):
    masked = text.mask_personal_data(spread(dirty_texts(t)), "text")
    return masked.select(
        "doc_id", "allowed", "redacted_text", F.array_join("reasons", ",").alias("reasons"))


_WORDS = {tag: pattern for tag, pattern in text.INTENTS}


def _intent_sql() -> str:
    cases = []
    for tag, pattern in _WORDS.items():
        body = pattern.removeprefix(r"\b").removesuffix(r"\b")
        cases.append(
            rf"case when regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){body}(?:$|[^\p{{L}}\p{{N}}_])')"
            f" then '{tag}' end")
    return f"concat_ws(',', {', '.join(cases)})"


_ASK = "case turn % 6 when 0 then 'Kiểm tra BÁO CÁO quý ' when 1 then 'total RATE of ' when 2 then 'nguồn, ' when 3 then 'errors tổng: ' else '' end"


@query(
    f"""select conv_id, turn, {_intent_sql()} as tags from
      (select conv_id, turn, {_ASK} || text as text from conversations)"""
)
def intent_tags(t):
    asked = F.concat(F.expr(_ASK), "text")
    return t.conversations.select(
        "conv_id", "turn", F.array_join(text.intent_tags(asked), ",").alias("tags"))


_NUMBERED = """concat('  Điều ', cast(doc_id % 30 as string), '  Khoản ', cast(doc_id % 4 as string), 'đ của ',
  cast(doc_id % 90 + 10 as string), '/2024/NĐ-CP, MẪU SỐ 7; điều ', cast(doc_id % 30 as string), '. ')"""
_IDS_SQL = (
    r"(?i)(?:^|[^\p{L}\p{N}_])([0-9]{1,4}/[0-9]{4}/[A-ZĐ-]+|(?:Điều|Khoản)\s+[0-9]+[a-zđ]?|Mẫu\s+số\s+[0-9]+)")


@query(
    rf"""with q as (select doc_id, trim(regexp_replace({_NUMBERED} || text, '\s+', ' ', 'g')) as query from documents),
    x as (select doc_id, query, unnest(regexp_extract_all(query, '{_IDS_SQL}', 1)) as i,
      generate_subscripts(regexp_extract_all(query, '{_IDS_SQL}', 1), 1) as n from q),
    f as (select doc_id, i, min(n) as n from x group by all)
    select doc_id, string_agg(i, '|' order by n) as identifiers from f group by doc_id"""
)
def query_identifiers(t):
    asked = spread(t.documents).select("doc_id", F.concat(F.expr(_NUMBERED), "text").alias("query"))
    done = asked.withColumn("query", text.normalize_query(F.col("query")))
    return done.select("doc_id", F.array_join(text.identifiers(F.col("query")), "|").alias("identifiers"))


@query(
    f"""select chunk_id, concat_ws(chr(10), 'Domain: ' || domain, 'Document type: ' || document_type,
      'Document: ' || document_name, case when cast(document_id as bigint) % 2 = 0 then 'Location: Chương II, Article: ' ||
      (cast(document_id as bigint) % 9) end, 'Content:', content) as input from ({CORPUS})"""
)
def embedding_input(t):
    number = F.col("document_id").cast("bigint")
    even = number % 2 == 0
    corpus = adapters.corpus(t).withColumns({
        "heading_hierarchy": F.when(even, F.array(F.lit("Chương II"))),
        "article": F.when(even, (number % 9).cast("string")),
        "clause": F.when(even, F.lit("Chương II")),
    })
    return corpus.select("chunk_id", chunks.embedding_input(corpus).alias("input"))


@query(
    """select vec_id, case when vec_id % 50 = 0 then 'missing_vector' when vec_id % 50 = 1 then 'empty_vector'
      when vec_id % 50 = 2 then 'non_finite_value' when vec_id % 50 = 3 then 'dimension_mismatch'
      when vec_id % 50 = 4 then 'zero_vector' end as issue,
      case when vec_id % 50 > 4 then round(list_inner_product(embedding, embedding)::double, 3) end as squared_norm
    from embeddings"""
)
def vector_check(t):
    v, n = F.col("embedding").cast("array<double>"), F.col("vec_id") % 50
    broken = (
        F.when(n == 0, F.lit(None).cast("array<double>"))
        .when(n == 1, F.array().cast("array<double>"))
        .when(n == 2, F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x)))
        .when(n == 3, F.slice(v, 1, 5))
        .when(n == 4, F.transform(v, lambda x: F.lit(0.0)))
        .otherwise(v)
    )
    issue = vectors.vector_issue(broken, F.lit(64))
    return t.embeddings.select(
        "vec_id", issue.alias("issue"),
        F.when(issue.isNull(), F.round(vectors.squared_norm(v), 3)).alias("squared_norm"))


@query("""select cast(64 as integer) as min_size, cast(64 as integer) as max_size, 0::bigint as invalid, count(*) as n
  from embeddings where len(embedding) = 64""")
def collection_facts(t):
    return store.collection_facts(t.embeddings, "embedding")


_UUID = "unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('ubnd-kb:', document_id, ':', chunk_id))"


@query(
    f"""select chunk_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-',
      case when h[17] in ('0', '4', '8', 'c') then '8' when h[17] in ('1', '5', '9', 'd') then '9'
      when h[17] in ('2', '6', 'a', 'e') then 'a' else 'b' end, h[18:20], '-', h[21:32]) as point_id
    from (select chunk_id, sha1({_UUID}) as h from ({CORPUS}))"""
)
def uuid5_ids(t):
    return adapters.corpus(t).select(
        "chunk_id", ids.point_id(F.col("document_id"), F.col("chunk_id")).alias("point_id"))


@query(
    """select doc_id, sha256(text) as sha256, 'doc-' || sha256(text)[1:16] as short_id,
      concat(lang, '/', sha256(text)[1:2], '/', sha256(text), '_', doc_id, '.txt') as managed_path from documents"""
)
def sha_ids(t):
    digest = ids.checksum(F.col("text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select(
        "doc_id", digest.alias("sha256"), ids.short_document_id(digest).alias("short_id"),
        ids.managed_path(F.col("lang"), digest, name).alias("managed_path"))


@query(
    """select page_id, case when s = '' then 'document' else s[1:180] end || '.pdf' as stored_filename from
      (select page_id, trim(regexp_replace(regexp_replace(strip_accents(regexp_extract(regexp_extract(html,
      '<title>([^<]*)', 1), '([^/]*)$', 1)), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), '._') as s from pages)"""
)
def safe_names(t):
    """File names made from page titles."""
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    name = text.safe_file_name(F.concat(title, F.lit(".PDF")))
    return t.pages.select("page_id", name.alias("stored_filename"))


# --- reporting ----------------------------------------------------------------------------------

FIELDS = rules.CANONICAL_FIELDS


def stored_reports(t):
    reports = rules.validate_population(adapters.population_reports(t))
    return reports.select(
        "report_id", F.lit("population").alias("domain"), "classification", "unit",
        F.col("period_start").cast("string").alias("period_label"), "period_start",
        F.concat(F.lit("Xã "), F.col("unit").cast("string")).alias("organization_name"),
        rules.values_map(reports, FIELDS).alias("values"), "issues")


_SYN = "classification = 'SYNTHETIC_TEST_DATA'"


def _lines_sql() -> str:
    head = [
        f"select report_id, 'header' as section, {i} as ord, {label} as label, {value} as value from r"
        for i, (label, value) in enumerate([
            ("null", f"'{reporting.TITLE}'"), ("null", f"'{reporting.MARK}'"),
            ("'Lĩnh vực'", "'population'"), ("'Kỳ báo cáo'", "cast(period_start as varchar)"),
            ("'Đơn vị'", "'Xã ' || unit"), ("'Nguồn dữ liệu vận hành'", "report_id")])
    ]
    values = [
        f"select report_id, 'values', {i}, '{reporting.POPULATION_LABELS[f]}', cast({f} as varchar) from r"
        for i, f in enumerate(FIELDS)
    ]
    note = f"select report_id, 'closing', 0, null, '{reporting.CLOSING_NOTE}' from r"
    return " union all ".join([*head, *values, note])


@query(f"with r as (select * from ({POPULATION}) where {_SYN}) {_lines_sql()}")
def report_lines(t):
    lines = reporting.report_lines(stored_reports(t))
    return lines.filter("section <> 'issues'").drop("item")


@query(
    """with g as (select o_custkey % 40 as unit, o_orderkey, o_orderstatus, o_orderpriority from orders)
    select 'r' || unit as report_id, o_orderkey as item, 'id' as label, cast(o_orderkey as varchar) as value from g
    union all select 'r' || unit, o_orderkey, 'status', o_orderstatus from g
    union all select 'r' || unit, o_orderkey, 'priority', case when o_orderkey % 3 = 0 then o_orderpriority else '' end from g
      where unit in (select unit from g where o_orderkey % 3 = 0)"""
)
def report_record_cells(t):
    """Record cells of the drafts: every header of the report for every record."""
    rows = t.orders.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("report_id"),
        F.col("o_orderkey").alias("record_no"),
        F.map_concat(
            F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("status"), "o_orderstatus"),
            F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("priority"), "o_orderpriority"))
            .otherwise(F.create_map().cast("map<string,string>"))).alias("fields"))
    reports = rows.select("report_id").distinct().select(
        "report_id", F.lit("tasks").alias("domain"), F.lit("SYNTHETIC_TEST_DATA").alias("classification"),
        F.lit("w").alias("period_label"), F.lit("u").alias("organization_name"),
        F.create_map().cast("map<string,string>").alias("values"),
        F.array().cast(f"array<{rules.ISSUE}>").alias("issues"))
    lines = reporting.report_lines(reports, rows)
    return lines.filter("section = 'records'").select("report_id", "item", "label", "value")


@query(
    f"""select report_id, to_json({{'report_id': report_id, 'domain': 'population', 'classification': classification,
      'original_filename': 'u' || unit || '.xlsx', 'processing_status': 'validated', 'reporting_period': {{'kind': 'week',
      'start': cast(period_start as varchar), 'end': cast(period_start + 6 as varchar), 'label': null}},
      'organization': {{'organization_id': cast(unit as varchar), 'organization_name': 'Xã ' || unit}}}})::varchar as payload
    from ({POPULATION})"""
)
def report_payload(t):
    stored = adapters.population_reports(t).withColumns({
        "domain": F.lit("population"), "original_filename": F.concat(F.lit("u"), "unit", F.lit(".xlsx")),
        "processing_status": F.lit("validated"), "period_kind": F.lit("week"),
        "period_end": F.date_add("period_start", 6).cast("string"),
        "period_start": F.col("period_start").cast("string"), "period_label": F.lit(None).cast("string"),
        "organization_id": F.col("unit").cast("string"), "organization_name": F.concat(F.lit("Xã "), "unit")})
    return stored.select("report_id", reporting.report_payload(stored).alias("payload"))


@query(
    """select conv_id, turn, replace(replace(replace('{{name}} - {{ name }} {{ role}} {{role}}', '{{name}}', 'C' || conv_id),
      '{{ name }}', 'C' || conv_id), '{{role}}', role) as filled from conversations"""
)
def template_fill(t):
    entries = F.create_map(
        F.lit("name"), F.concat(F.lit("C"), F.col("conv_id").cast("string")), F.lit("role"), F.col("role"))
    template = F.lit("{{name}} - {{ name }} {{ role}} {{role}}")
    return t.conversations.select(
        "conv_id", "turn", reporting.fill_template(template, entries).alias("filled"))


@query(
    """select conv_id * 1000 + turn as template_id, 'missing_placeholder' as code, x.n as location
    from conversations, (values ('period'), ('title'), ('unit.name')) x(n)
    where not (x.n = 'title' and turn % 2 = 0 or x.n = 'period' and turn % 3 = 0 or x.n = 'unit.name' and turn % 5 = 0)"""
)
def placeholder_check(t):
    n = F.col("turn")
    body = F.concat(
        "text", F.when(n % 2 == 0, F.lit(" {{title}}")).otherwise(F.lit(" {title}}")),
        F.when(n % 3 == 0, F.lit(" {{  period }}")).otherwise(F.lit("")),
        F.when(n % 5 == 0, F.lit("{{unit.name}}{{other}}")).otherwise(F.lit("{{unit name}}")))
    templates = t.conversations.select(
        (F.col("conv_id") * 1000 + n).alias("template_id"), body.alias("text"),
        F.array(*[F.lit(x) for x in ("title", "unit.name", "period")]).alias("required"))
    return reporting.missing_placeholders(templates)


@query(
    f"""with r as ({POPULATION})
    select report_id, 'unsupported_citation' as code, 'sections[0]' as location from r where unit % 4 = 1
    union all select report_id, 'numeric_source_mismatch', 'sections[0]' from r where unit % 5 = 0
    union all select report_id, 'numeric_source_mismatch', 'tables[0]' from r
    union all select report_id, 'human_review_required', null from r where unit % 6 = 0"""
)
def evidence_check(t):
    """Each draft cites two sources and three figures: permanent_in (in every fifth unit one too
    much), permanent_out with decimals, and a field the report does not have."""
    reports = stored_reports(t)
    u = F.col("unit")
    drafts = reports.select("report_id", (u % 6 != 0).alias("human_review_required"))
    allowed = reports.select("report_id", F.explode(F.array(F.lit("SOURCE_1"), F.lit("SOURCE_2"))).alias("source_id"))
    cited = F.array(F.lit("SOURCE_1"), F.when(u % 4 == 1, "SOURCE_99").otherwise("SOURCE_2"))
    citations = reports.select("report_id", F.lit("sections[0]").alias("location"), F.explode(cited).alias("source_id"))
    number = lambda f: F.col("values")[f].cast("decimal(18,2)")
    figure = lambda at, f, v: F.struct(
        F.lit(at).alias("location"), F.lit(f).alias("field_name"), v.cast("decimal(18,2)").alias("value"))
    figures = F.array(
        figure("sections[0]", "permanent_in", number("permanent_in") + F.when(u % 5 == 0, 1).otherwise(0)),
        figure("sections[0]", "permanent_out", number("permanent_out")),
        figure("tables[0]", "no_such_field", F.lit(1)))
    references = reports.select("report_id", F.explode(figures).alias("f")).select("report_id", "f.*")
    values = reports.select("report_id", F.explode("values").alias("field_name", "source_value"))
    return reporting.evidence_issues(drafts, citations, allowed, references, values).drop("message")


_REVIEWS = """select user_id % 97 as report_id, ts, event_id as seq, case event_type when 'signup' then 'approved'
  when 'error' then 'rejected' when 'purchase' then 'published' else 'needs_review' end as status,
  concat('user-', cast(user_id as string)) as reviewer from {events}"""
REVIEWS = adapters.plain(_REVIEWS)


@query(
    f"""with e as ({REVIEWS}), f as (select report_id, min(seq) as first from e where status in ('approved', 'rejected')
      group by report_id)
    select e.report_id, seq, status, case when status not in ('approved', 'rejected') then 'invalid'
      when seq = first then 'applied' else 'conflict' end as outcome from e left join f using (report_id)"""
)
def review_decisions(t):
    events = t.sql(_REVIEWS, "events")
    return reporting.review_decisions(events).select("report_id", "seq", "status", "outcome")


@query(
    f"""with e as ({REVIEWS}), r as (select distinct user_id as report_id from events),
    f as (select report_id, arg_min(status, seq) as status, arg_min(reviewer, seq) as reviewer from e
      where status in ('approved', 'rejected') group by report_id)
    select report_id, coalesce(status, 'needs_review') as status, reviewer as reviewed_by from r left join f using (report_id)"""
)
def review_states(t):
    reports = t.events.select(F.col("user_id").alias("report_id")).distinct()
    return reporting.review_states(reports, t.sql(_REVIEWS, "events")).drop("reviewed_at")


@query(
    """select o_orderkey as generated_id, o_custkey as operational_report_id from orders
      where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')"""
)
def orphan_reports(t):
    generated = t.orders.select(
        F.col("o_orderkey").alias("generated_id"), F.col("o_custkey").alias("operational_report_id"))
    known = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("report_id"))
    return reporting.orphan_reports(generated, known).select("generated_id", "operational_report_id")


@query(
    f"""with q as (select event_id as request_id, concat(user_id % 23, '/', cast(date_trunc('week', ts) as date)) as report_id
      from events)
    select request_id, report_id, p.report_id is not null as success,
      case when p.report_id is not null then 'population-canonical-v1' end as population_schema,
      case when p.report_id is not null then 'POPULATION_CANONICAL_DETERMINISTIC_V1' end as ruleset
    from q left join ({POPULATION}) p using (report_id)"""
)
def report_lookup(t):
    week = F.to_date(F.date_trunc("week", "ts")).cast("string")
    requests = t.events.select(
        F.col("event_id").alias("request_id"),
        F.concat_ws("/", (F.col("user_id") % 23).cast("string"), week).alias("report_id"))
    found = reporting.report_lookup(requests, stored_reports(t).select("report_id", "domain", "values"))
    return found.select("request_id", "report_id", "success", "population_schema", "ruleset")


@query(
    """select user_id as request_id, arg_min(event_type, event_id) as operational_data,
      count(distinct event_type) > 1 as human_review_required,
      case when count(distinct event_type) > 1 then 'official_data_overwrite_rejected' end as warning
    from events group by user_id"""
)
def official_data_conflicts(t):
    return reporting.official_data_conflicts(t.events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("step"), F.col("event_type").alias("data")))


@query("""select p_name as template_id, count(*) as n from part group by p_name having count(*) > 1""")
def duplicate_templates(t):
    return reporting.duplicate_templates(t.part.select(F.col("p_name").alias("template_id")))


@query(
    """select concat('r', cast(o_custkey as varchar)) as report_id,
      bool_and(o_orderkey % 31 <> 0 or o_orderkey % 2 = 0) as numeric_sources_valid from orders group by o_custkey"""
)
def numeric_cells(t):
    key = F.col("o_orderkey")
    values = t.orders.select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("report_id"),
        F.when(key % 2 == 0, "text").otherwise("integer").alias("kind"),
        F.when(key % 31 == 0, F.lit("n/a")).otherwise(key.cast("string")).alias("value_text"))
    return reporting.numeric_values_valid(values)


# --- inventories --------------------------------------------------------------------------------


def text_files(t):
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return t.documents.select(
        path.alias("path"), "source", "lang", ids.checksum(F.col("text")).alias("sha256"),
        F.col("text").rlike(text.SYNTHETIC_NAME).alias("names_person"))


@query(
    """select 'source' as dimension, source as value, count(*) as n from documents group by source
    union all select 'lang', lang, count(*) from documents group by lang
    union all select 'names_person', cast(regexp_matches(text, '(?i)Nguyễn\\s+Văn\\s+A') as varchar), count(*)
      from documents group by 2"""
)
def inventory_counts(t):
    return inventory.inventory_counts(text_files(t), "source", "lang", "names_person")


@query(
    """select sha256(text) as sha256, concat(source, '/', lang, '/', doc_id, '.txt') as path,
      count(*) over (partition by sha256(text)) as copies from documents
      qualify count(*) over (partition by sha256(text)) > 1"""
)
def inventory_dups(t):
    return inventory.duplicate_files(text_files(t))


PREFIXES = [
    ("http://", "common", "guideline"), ("http://t", "population", "legal"), ("http://th", "tasks", "template"),
    ("http://a", "complaints", "legal"), ("https://w", "population", "template"),
]
_PREFIX_SQL = ", ".join(str(p) for p in PREFIXES)


@query(
    f"""with m(prefix, domain, document_type) as (values {_PREFIX_SQL}),
    best as (select page_id, arg_max(domain, length(prefix)) as domain, arg_max(document_type, length(prefix)) as document_type
      from pages join m on starts_with(url, prefix) group by page_id)
    select page_id, url as path, domain, document_type from pages left join best using (page_id)"""
)
def prefix_class(t):
    mapping = t.spark.createDataFrame(PREFIXES, "prefix string, domain string, document_type string")
    urls = t.pages.select(F.col("url").alias("path"))
    classified = inventory.classify_paths(urls.distinct(), mapping)
    return t.pages.select("page_id", F.col("url").alias("path")).join(classified, "path")


def cases(t):
    """A registered case per label; manifests for good documents, with planned faults."""
    d = F.col("doc_id")
    none = F.lit(None).cast("string")
    digest = ids.checksum(F.col("text"))
    expected = lambda name, i: F.when(d % 13 != i, F.struct(
        F.lit(name).alias("name"),
        F.when(d % 17 != i, F.lit(inventory.APPROVED_MARKER)).alias("marker"),
        F.concat(F.lit("case-"), F.when(d % 19 == i, d + 1).otherwise(d)).alias("case_id"),
        (d % 23 != 2).alias("is_package")))
    source = F.struct(
        F.when(d % 29 == 0, F.lit("../x.txt")).otherwise(F.concat(F.lit("f/"), d)).alias("relative_path"),
        F.when(d % 7 == 0, F.lit("12")).when(d % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.upper(digest)).alias("sha256"),
        (d % 5 != 0).alias("deidentified"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("APPROVED", "APPROVED", "DRAFT", "WRONG")]), (d % 4 + 1).cast("int"))
    return t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        F.when(d % 3 == 0, "population").otherwise("tasks").alias("domain"),
        F.concat(F.lit("case-"), d).alias("case_id"), d.alias("doc_id"),
        (d % 31 != 0).alias("has_directory"), (F.col("quality") == 1).alias("has_manifest"),
        F.when(d % 3 == 0, "population").otherwise("tasks").alias("manifest_domain"),
        F.concat(F.lit("case-"), F.when(d % 37 == 0, 0).otherwise(d)).alias("manifest_case_id"),
        status.alias("status"), (d % 6 != 1).alias("approved_for_ground_truth"),
        F.when(d % 9 != 0, F.lit(False)).alias("llm_used_as_ground_truth"),
        F.lit("a").alias("extractor_id"), F.when(d % 10 == 0, "a").otherwise("b").alias("reviewer_id"),
        F.when(d % 15 == 0, none).otherwise("c").alias("approver_id"), F.lit(True).alias("disagreements_resolved"),
        F.lit("t").alias("extracted_at"), F.when(d % 14 == 0, "").otherwise("t").alias("reviewed_at"),
        F.lit("t").alias("approved_at"),
        F.when(d % 21 != 0, F.array(source)).alias("source_files"),
        F.array_compact(F.array(*[expected(n, i) for i, n in enumerate(inventory.EXPECTED_FILES)])).alias("expected_files"))


_CASES = """c as (select doc_id as d, quality = 1 as has, doc_id % 31 <> 0 as dir,
  case doc_id % 4 when 2 then 'DRAFT' when 3 then 'WRONG' else 'APPROVED' end as status,
  case when doc_id % 3 = 0 then 'population' else 'tasks' end as domain, sha256(text) as sha
  from labels join documents using (doc_id)),
k as (select *, dir and has and status <> 'WRONG' as known, dir and has and status = 'APPROVED' as approved from c)"""
_CASE_CHECKS = [
    ("case_directory_missing", "null", "not dir"),
    ("case_manifest_required", "null", "dir and not has"),
    ("invalid_status", "null", "dir and has and status = 'WRONG'"),
    ("manifest_identity_mismatch", "null", "known and d % 37 = 0 and d <> 0"),
    ("not_approved_for_ground_truth", "null", "approved and d % 6 = 1"),
    ("llm_output_as_ground_truth", "null", "approved and d % 9 = 0"),
    ("review_ids_required", "null", "approved and d % 15 = 0"),
    ("extractor_is_reviewer", "null", "approved and d % 15 <> 0 and d % 10 = 0"),
    ("review_time_required", "'reviewed_at'", "approved and d % 14 = 0"),
    ("source_files_required", "null", "approved and d % 21 = 0"),
    ("marked_approved_without_status", "null", "known and not approved and d % 6 <> 1"),
    ("case_not_approved", "null", "known and not approved"),
]
for _i, _name in enumerate(inventory.EXPECTED_FILES):
    _CASE_CHECKS.append(("expected_file_missing", f"'{_name}'", f"approved and d % 13 = {_i}"))
    if _name.endswith("docx"):
        _CASE_CHECKS.append(("expected_report_invalid", f"'{_name}'", f"approved and d % 13 <> {_i} and d % 23 = 2"))
    else:
        _CASE_CHECKS.append(("marker_missing", f"'{_name}'", f"approved and d % 13 <> {_i} and d % 17 = {_i}"))
        _CASE_CHECKS.append((
            "expected_case_id_mismatch", f"'{_name}'",
            f"approved and d % 13 <> {_i} and case when d % 19 = {_i} then d + 1 else d end"
            " <> case when d % 37 = 0 then 0 else d end"))
CASE_ISSUES = " union all ".join(
    f"select domain, 'case-' || d as case_id, '{code}' as code, {field} as field_path from k where {condition}"
    for code, field, condition in _CASE_CHECKS)


@query(f"with {_CASES} {CASE_ISSUES}")
def case_registry(t):
    return inventory.case_issues(cases(t), require_approved=True)


@query(
    f"""with {_CASES} select domain, 'case-' || d as case_id, case when d % 7 = 0 then 'valid_sha256_required'
      when d % 29 = 0 then 'path_escapes_root' when d % 2 = 1 and d % 8 = 1 then 'file_not_found' end as code
      from k where status = 'APPROVED' and d % 21 <> 0 and (d % 7 = 0 or d % 29 = 0 or d % 8 = 1)
    union all select domain, 'case-' || d, 'sha256_mismatch' from k where status = 'APPROVED' and d % 21 <> 0
      and d % 7 <> 0 and d % 29 <> 0 and d % 8 <> 1 and d % 11 = 0
    union all select domain, 'case-' || d, 'not_deidentified' from k where status = 'APPROVED' and d % 21 <> 0
      and d % 7 <> 0 and d % 29 <> 0 and d % 8 <> 1 and d % 5 = 0"""
)
def case_source_files(t):
    files = t.documents.filter("doc_id % 8 <> 1").select(
        F.concat(F.lit("f/"), F.col("doc_id")).alias("path"), ids.checksum(F.col("text")).alias("sha256"))
    return inventory.source_file_issues(cases(t), files).drop("index")


@query(
    f"""with {_CASES} select count(*) as planned, count_if(approved) as approved,
      count_if(dir and (not has or known) and not approved) as pending, (select count(*) from ({CASE_ISSUES})) as errors from k"""
)
def case_summary(t):
    registered = cases(t)
    return inventory.case_summary(registered, inventory.case_issues(registered, require_approved=True))


@query(
    f"""select report_id as source_input, f.field, case f.field when 'permanent_in' then permanent_in else birth_registered end
      as value, f.field = 'permanent_in' or unit % 2 = 0 as matches from ({POPULATION}),
      (values ('permanent_in'), ('birth_registered')) f(field)"""
)
def expected_actual(t):
    reports = adapters.population_reports(t)
    pair = lambda f, v: F.struct(F.lit(f).alias("field"), v.cast("bigint").alias("value"))

    def long(births):
        pairs = F.array(pair("permanent_in", F.col("permanent_in")), pair("birth_registered", births))
        return reports.select(
            F.lit("population").alias("domain"), F.col("report_id").alias("source_input"),
            F.explode(pairs).alias("p")).select("domain", "source_input", "p.*")

    births = F.col("birth_registered")
    found = inventory.paired_values(long(births), long(births + F.col("unit") % 2))
    return found.select("source_input", "field", "value", "matches")


# --- stored tables ------------------------------------------------------------------------------


def stored_corpus(t):
    return adapters.corpus(t).filter("cast(document_id as bigint) % 3 <> 0")


@query(
    f"""select document_id, case when cast(document_id as bigint) % 2 = 0 or cast(document_id as bigint) % 3 = 0 then 'new' else 'old' end as origin,
      sha256(content) as digest from ({CORPUS})
      where not (cast(document_id as bigint) % 3 = 0 and cast(document_id as bigint) % 2 = 1)
    union all select document_id, 'late', sha256(content) from ({CORPUS})
      where cast(document_id as bigint) % 3 = 0 and cast(document_id as bigint) % 2 = 1"""
)
def upsert_merge(t):
    """Stored: two thirds of the documents. New: the even ones and all missing ones, of which the
    odd ones come twice and the later version counts."""
    number = F.col("document_id").cast("bigint")
    row = lambda df, origin, seq: df.select(
        "document_id", F.lit(origin).alias("origin"), ids.checksum(F.col("content")).alias("digest"), F.lit(seq).alias("seq"))
    corpus = adapters.corpus(t)
    stored = row(stored_corpus(t), "old", 0)
    new = row(corpus.filter((number % 2 == 0) | (number % 3 == 0)), "new", 1).unionByName(
        row(corpus.filter((number % 3 == 0) & (number % 2 == 1)), "late", 2))
    return store.merge_by_key(stored, new, ["document_id"], "seq").drop("seq")


@query(
    f"""select document_id, cast(count(*) as bigint) as n from (select cast(doc_id as varchar) as document_id, unnest(string_split(text, chr(10)))
      from documents where doc_id not in (select doc_id from labels where toxic = 1)) group by document_id"""
)
def delete_doc(t):
    """Line chunks per document after deleting the documents labelled toxic."""
    lines = t.documents.select(
        F.col("doc_id").cast("string").alias("document_id"), F.explode(F.split("text", "\n")).alias("content"))
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    return store.counts_per_document(store.delete_documents(lines, toxic))


@query(
    """select cast(doc_id as varchar) as document_id, case when quality = 1 and toxic = 0 then 'rebuilt'
      when quality = 1 then 'refused' else 'kept' end as state from labels
    union all select cast(doc_id as varchar), 'kept' from documents where doc_id not in (select doc_id from labels)
    union all select cast(doc_id as varchar), 'kept' from labels where quality = 1 and toxic = 1"""
)
def reindex(t):
    """Rebuild the good documents; toxic ones count as deleted and are refused."""
    document = lambda df: df.select(F.col("doc_id").cast("string").alias("document_id"))
    stored = document(t.documents).withColumn("state", F.lit("kept"))
    known = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(F.col("toxic") == 1, "deleted").otherwise("ready").alias("processing_status"))
    wanted = document(t.labels.filter("quality = 1"))
    rebuilt = document(t.documents).withColumn("state", F.lit("rebuilt"))
    table, refused = store.reindex(stored, known, rebuilt, wanted)
    return table.unionByName(refused.withColumn("state", F.lit("refused")))


_UPLOADS = """select doc_id as upload_no, sha256(text) as checksum, doc_id % 6 = 0 as force from documents"""
_STORED = """select sha256(text) as checksum, case min(doc_id) % 5 when 0 then 'failed' when 4 then 'deleted' else 'ready' end as s,
  min(doc_id) % 7 = 0 as old from documents where lang = 'en' group by 1"""


@query(
    f"""with u as ({_UPLOADS}), s as (select * from ({_STORED}) where s <> 'deleted'),
    f as (select checksum, min(upload_no) as first from u group by checksum)
    select upload_no, case when s.checksum is null and upload_no = first then 'indexed' when force then 'reindexed'
      when s.checksum is null or (s.s = 'ready' and not old) then 'skipped_duplicate' else 'error' end as outcome
    from u join f using (checksum) left join s using (checksum)"""
)
def ingest_outcome(t):
    return _outcomes(t).drop("checksum")


def _outcomes(t):
    digest = ids.checksum(F.col("text")).alias("checksum")
    uploads = t.documents.select(F.col("doc_id").alias("upload_no"), digest, (F.col("doc_id") % 6 == 0).alias("force"))
    first = t.documents.filter("lang = 'en'").select("doc_id", digest).groupBy("checksum").agg(F.min("doc_id").alias("d"))
    status = F.when(F.col("d") % 5 == 0, "failed").when(F.col("d") % 5 == 4, "deleted").otherwise("ready")
    model = F.when(F.col("d") % 7 == 0, "old-model").otherwise("model")
    stored = first.select(
        "checksum", status.alias("processing_status"), model.alias("embedding_model"), F.lit(64).alias("embedding_dimension"))
    return store.ingest_outcomes(uploads, stored, "model")


@query(
    f"""with u as ({_UPLOADS}), s as (select * from ({_STORED}) where s <> 'deleted'),
    f as (select checksum, min(upload_no) as first from u group by checksum),
    o as (select checksum, case when s.checksum is null and upload_no = first then 'indexed' when force then 'reindexed'
      when s.checksum is null or (s.s = 'ready' and not old) then 'skipped_duplicate' else 'error' end as outcome
      from u join f using (checksum) left join s using (checksum)),
    n as (select distinct sha256(text) as checksum, length(text) // 1200 + 1 as n from documents)
    select count(*) as files_found, count_if(outcome = 'indexed') as indexed, count_if(outcome = 'reindexed') as reindexed,
      count_if(outcome = 'skipped_duplicate') as skipped, count_if(outcome = 'error') as failed,
      cast(sum(case when outcome <> 'error' then n end) as bigint) as total_chunks from o left join n using (checksum)"""
)
def ingest_summary(t):
    size = (F.floor(F.length("text") / 1200) + 1).alias("n_chunks")
    sizes = t.documents.select(ids.checksum(F.col("text")).alias("checksum"), size).distinct()
    return store.ingest_summary(_outcomes(t), sizes)


@query(
    """select cast(doc_id as varchar) as document_id, len(string_split(text, chr(10))) + 1 as expected,
      cast(len(string_split(text, chr(10))) as bigint) as actual from documents where doc_id % 10 = 3
    union all select 'none', 1, 0"""
)
def index_verify(t):
    """Expected counts against stored line chunks; one document in ten expects one more."""
    name = F.col("doc_id").cast("string").alias("document_id")
    stored = t.documents.select(name, F.explode(F.split("text", "\n")).alias("content"))
    extra = F.when(F.col("doc_id") % 10 == 3, 1).otherwise(0)
    expected = t.documents.select(name, (F.size(F.split("text", "\n")) + extra).cast("bigint").alias("expected"))
    ghost = t.spark.createDataFrame([("none", 1)], "document_id string, expected bigint")
    return store.verify_counts(expected.unionByName(ghost), stored)


_LIFE = """select user_id as document_id, ts, event_id as seq, case event_type when 'signup' then 'uploaded'
  when 'view' then 'processing' when 'click' then 'ready' when 'error' then 'failed' else 'deleted' end as state,
  case when event_type = 'error' then props end as stage,
  case when event_type = 'click' then cast(event_id % 50 as int) end as chunk_count from {events}"""
LIFE = adapters.plain(_LIFE)


@query(
    f"""with e as ({LIFE}), d as (select document_id, max(seq) filter (state in ('processing', 'ready', 'failed')) as s,
      max(seq) filter (state = 'ready') as r, max(seq) as m, max(ts) as updated_at from e group by document_id)
    select d.document_id, l.state as processing_status, f.stage as failed_stage, r.chunk_count, updated_at
    from d join e l on l.document_id = d.document_id and l.seq = m
      left join e f on f.document_id = d.document_id and f.seq = s left join e r on r.document_id = d.document_id and r.seq = d.r"""
)
def lifecycle_latest(t):
    return store.lifecycle_states(t.sql(_LIFE, "events"))


@query(
    f"""select document_id, document_name, length(content) as n_chars from ({CORPUS}) where document_status = 'active'
      and document_type in ('legal', 'template') and coalesce(effective_date <= date '2024-08-01', true)
      and coalesce(expiry_date >= date '2024-08-01', true)"""
)
def searchable_scan(t):
    """Filtered corpus scan: metadata and dates, without processing states of the vector store."""
    import datetime

    filters = Filters(document_status="active", document_types=("legal", "template"),
                      effective_on=datetime.date(2024, 8, 1))
    found = store.searchable_chunks(adapters.corpus(t), filters)
    return found.select("document_id", "document_name", F.length("content").alias("n_chars"))


@query(
    f"""select document_id, domain, document_type from ({CORPUS}) where domain = 'tasks' and document_type = 'legal'
      order by document_id limit 20 offset 10"""
)
def document_page(t):
    listed = store.list_documents(adapters.corpus(t), 10, 20, domain="tasks", document_type="legal")
    return listed.select("document_id", "domain", "document_type")


@query("select o_orderkey as report_id, o_orderdate as created_at from orders where o_orderstatus = 'P'")
def reports_by_status(t):
    reports = t.orders.select(
        F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return store.newest_first(reports, status="P").drop("status")


@query(
    """select doc_id from documents where sha256(text) in (select sha256(text) from documents join labels using (doc_id)
      where quality = 1 and toxic = 0)"""
)
def known_checksums(t):
    digest = ids.checksum(F.col("text")).alias("checksum")
    uploads = t.documents.select("doc_id", digest)
    status = F.when(F.col("toxic") == 1, "deleted").otherwise("ready").alias("processing_status")
    stored = t.documents.join(t.labels.filter("quality = 1"), "doc_id").select(digest, status).distinct()
    return store.known_checksums(uploads, stored).select("doc_id")


@query(f"select point_count, n from (select count(*) as point_count, count(distinct chunk_id) as n from ({CORPUS}))")
def embedded_points(t):
    """Points with merged metadata; the upload's entries win over the chunk's."""
    chunks_ = adapters.corpus(t).withColumn("metadata", F.create_map(F.lit("source"), F.lit("chunk")))
    payload = F.create_map(F.lit("source"), F.lit("upload"), F.lit("document_number"), F.col("document_number"))
    points = store.embedded_points(chunks_, payload).filter("metadata['source'] = 'upload'")
    return points.agg(F.count("*").alias("point_count"), F.count_distinct("point_id").alias("n"))


# --- streams ------------------------------------------------------------------------------------


def _stream(t, table):
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


@query(
    """select sha256(concat(user_id, event_type)) as checksum, event_type as domain, count(*)::bigint - count(*)::bigint + 1 as n
    from events group by all"""
)
def stream_ingest(t):
    """Uploads as a stream; each (checksum, domain) is stored once, over two runs."""
    folder = f"{working_folder(t.spark)}/ingest-{uuid.uuid4().hex}"
    digest = F.sha2(F.concat(F.col("user_id").cast("string"), "event_type"), 256)
    uploads = _stream(t, "events").select(
        digest.alias("checksum"), F.col("event_type").alias("domain"),
        F.col("ts").cast("timestamp").alias("received_at"))
    for run in ("a", "b"):
        ingest.ingest(uploads, f"{folder}/table", f"{folder}/checkpoint-{run}").awaitTermination()
    stored = t.spark.read.parquet(f"{folder}/table")
    return stored.groupBy("checksum", "domain").agg(F.count("*").alias("n"))


@query(f"select document_id, arg_max(state, seq) as state from ({LIFE}) group by document_id")
def stream_states(t):
    folder = f"{working_folder(t.spark)}/states-{uuid.uuid4().hex}"
    events = t.spark.sql(_LIFE, events=_stream(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    ingest.track_states(events, f"{folder}/states", f"{folder}/checkpoint").awaitTermination()
    return ingest.current_states(t.spark, f"{folder}/states").drop("ts")
