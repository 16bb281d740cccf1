"""Plug-in models, fallbacks, upload metadata and the bundle view."""

from pyspark.sql import functions as F

from reportlake.operators import bundle, chunks, embed, reporting, search
from reportlake.operators.distribution import spread
from reportlake.operators.search import Filters
from reportlake.plans import adapters
from reportlake.plans.extract_queries import POPULATION, bundle_sources
from reportlake.plans.registry import query
from reportlake.plans.search_queries import ACTIVE, sql_bm25

_BYTES = ", ".join(f"cast('0x' || h[{2 * i + 1}:{2 * i + 2}] as integer) + 1.0::double" for i in range(4))


@query(
    f"""select doc_id, round(v[1], 9) as v1, round(v[2], 9) as v2, round(v[3], 9) as v3, round(v[4], 9) as v4 from
      (select doc_id, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) as v from
        (select doc_id, [{_BYTES}] as u from (select doc_id, sha256(text) as h from documents)))"""
)
def embed_texts(t):
    texts = spread(t.documents.select("doc_id", "text"))
    vectors = embed.embed(texts, "text", embed.hash_embedder)
    return vectors.select("doc_id", *[F.round(F.col("vector")[i], 9).alias(f"v{i + 1}") for i in range(4)])


def length_scorer(queries: list[str], contents: list[str]) -> list[float]:
    return [float(len(c) % 97 - len(q) % 7) for q, c in zip(queries, contents)]


@query(
    f"""with {sql_bm25(ACTIVE, 20)},
    s as (select l.query_id, l.chunk_id, cast(length(content) % 97 - length(b.text) % 7 as double) as reranker_score
      from lexical l join kept using (chunk_id) join benchmark b on b.item_id = l.query_id)
    select * from (select *, cast(row_number() over (partition by query_id order by reranker_score desc, chunk_id) as integer)
      as rank from s) where rank <= 5"""
)
def rerank_model(t):
    """A user's scorer over (query, content) pairs of the candidates."""
    found = search.bm25_search(adapters.corpus(t), adapters.queries(t), Filters.for_request(), 20)
    pairs = search.with_content(found, adapters.corpus(t)).join(adapters.queries(t), "query_id")
    scored = embed.score_pairs(pairs.select("query_id", "chunk_id", "rank", "query", "content"),
                               "query", "content", length_scorer)
    candidates = search.materialize(scored.select("query_id", "chunk_id", "rank", "reranker_score"))
    best, _ = search.rerank_by_scores(candidates.drop("reranker_score"), candidates.drop("rank"), 5)
    return best.select("query_id", "chunk_id", "rank", "reranker_score")


@query(
    f"""with {sql_bm25(ACTIVE, 20)} select query_id, chunk_id, rank,
      'Reranker unavailable; retrieval ordering preserved.' as warning from lexical where rank <= 5"""
)
def rerank_fallback(t):
    found = search.bm25_search(adapters.corpus(t), adapters.queries(t), Filters.for_request(), 20)
    return search.without_reranker(found).drop("score")


@query(
    f"""select document_id, array_to_string(list_filter([case when document_type = 'legal' then 'source=' || domain end,
      'document_number=' || document_number, 'effective_date=' || effective_date, 'issued_date=' || expiry_date],
      lambda x: x is not null), ';') as metadata from ({adapters.plain(adapters.CORPUS)})"""
)
def upload_metadata(t):
    corpus = adapters.corpus(t)
    source = F.when(F.col("document_type") == "legal", F.col("domain"))
    entries = chunks.semantic_metadata(
        source, F.col("document_number"), F.col("expiry_date"), F.col("effective_date"))
    names = ("source", "document_number", "effective_date", "issued_date")
    shown = [F.concat(F.lit(f"{n}="), F.try_element_at(F.col("m"), F.lit(n))) for n in names]
    return corpus.select("document_id", entries.alias("m")).select(
        "document_id", F.concat_ws(";", *shown).alias("metadata"))


@query(
    f"""select report_id as bundle_id, unit % 6 in (0, 5) or unit % 6 = 4 and population_opening = 999 as valid,
      case when unit % 6 in (0, 5) then population_opening end as population_opening,
      case when unit % 6 in (0, 5) then temporary_opening + temporary_new - temporary_removed end as temporary_closing
    from ({POPULATION})"""
)
def bundle_view(t):
    view = reporting.bundle_view(
        bundle.standardize(*bundle_sources(t)), list(bundle.INPUT_FIELDS), list(bundle.CLOSING))
    return view.select(
        "bundle_id", "valid", "canonical_values.population_opening", "calculated_values.temporary_closing")
