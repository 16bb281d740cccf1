"""From ranked candidates to evidence text, and checks of the citations made from it.

The folds run over the candidate list of one query, which is at most k long (k <= 200)."""

from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions import text
from reportlake.operators.distribution import fan_out, materialize
from reportlake.settings import CONTEXT_TOKENS

SCORES = ("score", "dense_score", "lexical_score", "fused_score", "reranker_score")
TRUNCATED = "Context truncated to configured token budget."


def expand_parents(candidates: DataFrame, corpus: DataFrame, max_tokens: int = CONTEXT_TOKENS
                   ) -> tuple[DataFrame, DataFrame]:
    """Insert the parent chunk after its candidate while the token budget lasts.

    candidates: query_id, rank, document_id, chunk_id, parent_chunk_id, content.
    Result: rows (query_id, position, chunk_id, document_id, content, is_parent) and warnings."""
    wanted = candidates.filter("parent_chunk_id is not null").select(
        "document_id", F.col("parent_chunk_id").alias("chunk_id")).distinct()
    parents = corpus.join(wanted, ["document_id", "chunk_id"], "left_semi").select(
        "document_id", F.col("chunk_id").alias("parent_chunk_id"),
        F.col("content").alias("parent_content"))
    paired = candidates.join(parents, ["document_id", "parent_chunk_id"], "left")
    item = F.struct(
        "rank", "chunk_id", "document_id", "content", "parent_chunk_id", "parent_content",
        text.estimate_tokens(F.col("content"), 1).alias("cost"),
        text.estimate_tokens(F.col("parent_content"), 1).alias("parent_cost"),
    )
    lists = fan_out(paired, "query_id").groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    start = F.struct(
        F.aggregate("items", F.lit(0), lambda total, c: total + c["cost"]).alias("used"),
        F.transform("items", lambda c: c["chunk_id"]).alias("seen"),
        F.array().cast("array<string>").alias("outcomes"),
    )

    def step(state: Column, c: Column) -> Column:
        known = c["parent_chunk_id"].isNull() | F.array_contains(state["seen"], c["parent_chunk_id"])
        outcome = (
            F.when(known, F.lit("none"))
            .when(c["parent_content"].isNull(), F.lit("unavailable"))
            .when(state["used"] + c["parent_cost"] > max_tokens, F.lit("omitted"))
            .otherwise(F.lit("added"))
        )
        added = outcome == "added"
        return F.struct(
            F.when(added, state["used"] + c["parent_cost"]).otherwise(state["used"]).alias("used"),
            F.when(added, F.concat(state["seen"], F.array(c["parent_chunk_id"])))
            .otherwise(state["seen"]).alias("seen"),
            F.concat(state["outcomes"], F.array(outcome)).alias("outcomes"),
        )

    judged = lists.withColumn("outcomes", F.aggregate("items", start, step)["outcomes"])
    rows = judged.select("query_id", F.inline(F.arrays_zip("items", "outcomes"))).select(
        "query_id", "items.*", "outcomes")
    own = rows.select(
        "query_id", (F.col("rank") * 2).alias("position"), "chunk_id", "document_id", "content",
        F.lit(False).alias("is_parent"))
    inserted = rows.filter("outcomes = 'added'").select(
        "query_id", (F.col("rank") * 2 + 1).alias("position"),
        F.col("parent_chunk_id").alias("chunk_id"), "document_id",
        F.col("parent_content").alias("content"), F.lit(True).alias("is_parent"))
    message = F.when(F.col("outcomes") == "unavailable", F.concat(
        F.lit("Parent chunk unavailable for "), "chunk_id")).otherwise(F.concat(
            F.lit("Parent chunk omitted by token budget for "), "chunk_id"))
    warnings = rows.filter("outcomes in ('unavailable', 'omitted')").select(
        "query_id", "rank", message.alias("message"))
    return own.unionByName(inserted), warnings


def describe_source(candidates: DataFrame) -> DataFrame:
    """Add chapter, section, heading and page_number as a context source shows them."""
    have = set(candidates.columns)
    hierarchy = F.coalesce(
        F.col("heading_hierarchy") if "heading_hierarchy" in have else F.lit(None).cast("array<string>"),
        F.array().cast("array<string>"))
    starting = lambda p: F.try_element_at(
        F.filter(hierarchy, lambda h: F.upper(h).startswith(p)), F.lit(1))
    pages = F.col("page_numbers") if "page_numbers" in have else F.lit(None).cast("array<int>")
    return candidates.withColumns({
        "chapter": starting("CH"),
        "section": starting("M"),
        "heading": F.try_element_at(hierarchy, F.lit(-1)),
        "page_number": F.try_element_at(pages, F.lit(1)),
    })


def _body(have: set[str]) -> Column:
    """Evidence text of a source after its number line."""
    value = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    shown = lambda c: F.coalesce(value(c), F.lit(""))
    place = F.concat_ws(
        ", ",
        F.nullif(value("chapter"), F.lit("")), F.nullif(value("section"), F.lit("")),
        *[F.concat(F.lit(label), F.nullif(value(c), F.lit("")))
          for label, c in (("Điều ", "article"), ("Khoản ", "clause"), ("Điểm ", "point"))])
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Document ID: "), shown("document_id")),
        F.concat(F.lit("Document: "), shown("document_name")),
        F.concat(F.lit("Document number: "), shown("document_number")),
        F.concat(F.lit("Location: "), place),
        F.concat(F.lit("Page: "), shown("page_number")),
        F.concat(F.lit("Chunk ID: "), shown("chunk_id")),
        F.lit("Content:"),
        shown("content"),
    )


def build_context(candidates: DataFrame, order: str = "rank", max_tokens: int = CONTEXT_TOKENS
                  ) -> tuple[DataFrame, DataFrame]:
    """Numbered sources and the context text of each query. The candidates (at most k per query)
    are written first, because both results are made from them.

    In order, a candidate is passed over when its chunk or its folded content was taken already,
    or when it does not fit (later, smaller ones still may). Numbers count accepted sources."""
    described = materialize(describe_source(candidates))
    prepared = fan_out(described, "query_id").withColumns({
        "body": _body(set(described.columns)),
        "fingerprint": text.comparison_key(F.col("content")),
    })
    item = F.struct(
        F.col(order).alias("at"), "chunk_id", "fingerprint", "body", F.length("body").alias("size"))
    lists = prepared.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    taken_type = "array<struct<at:int,rendered:string>>"
    start = F.struct(
        F.lit(0).alias("used"), F.lit(False).alias("truncated"),
        F.array().cast("array<string>").alias("chunks"),
        F.array().cast("array<string>").alias("contents"),
        F.array().cast(taken_type).alias("taken"),
    )

    def step(state: Column, c: Column) -> Column:
        known = F.array_contains(state["chunks"], c["chunk_id"]) | F.array_contains(
            state["contents"], c["fingerprint"])
        number = (F.size(state["taken"]) + 1).cast("string")
        rendered = F.concat(F.lit("[SOURCE_"), number, F.lit("]\n"), c["body"])
        # Four characters make a token; ten stand around the number in front of the body.
        cost = F.floor((F.length(number) + c["size"] + 13) / 4).cast("int")
        fits = state["used"] + cost <= max_tokens
        take = ~known & fits
        keep = lambda name, extra: F.when(
            take, F.concat(state[name], F.array(extra))).otherwise(state[name]).alias(name)
        entry = F.struct(c["at"].cast("int").alias("at"), rendered.alias("rendered"))
        return F.struct(
            F.when(take, state["used"] + cost).otherwise(state["used"]).alias("used"),
            (state["truncated"] | (~known & ~fits)).alias("truncated"),
            keep("chunks", c["chunk_id"]), keep("contents", c["fingerprint"]), keep("taken", entry),
        )

    folded = lists.select("query_id", F.aggregate("items", start, step).alias("s"))
    contexts = folded.select(
        "query_id",
        F.array_join(F.transform("s.taken", lambda t: t["rendered"]), "\n\n").alias("text"),
        F.size("s.taken").alias("n_sources"),
        F.col("s.used").alias("estimated_tokens"),
        F.col("s.truncated").alias("truncated"),
        F.when(F.col("s.truncated"), F.array(F.lit(TRUNCATED)))
        .otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    numbers = folded.select("query_id", F.posexplode("s.taken").alias("i", "t")).select(
        "query_id", (F.col("i") + 1).alias("source_number"), F.col("t.at").alias(order))
    sources = numbers.join(described, ["query_id", order]).withColumn(
        "source_id", F.concat(F.lit("SOURCE_"), F.col("source_number").cast("string")))
    return sources, contexts


# --- citations ----------------------------------------------------------------------------------


def check_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations (answer_id, ord, source_id, chunk_id, document_id, document_name) against the
    sources of the same answer: accepted ones once, rejected ones once per source and reason."""
    known = sources.select(
        "answer_id", "source_id", F.lit(True).alias("_known"),
        *[F.col(c).alias(f"_{c}") for c in ("chunk_id", "document_id", "document_name")])
    joined = citations.join(known, ["answer_id", "source_id"], "left")

    def differs(name: str) -> Column:
        given = F.nullif(F.col(name), F.lit(""))
        return given.isNotNull() & (given != F.col(f"_{name}"))

    reason = F.when(F.col("_known").isNull(), "source_id was not retrieved")
    for name in ("chunk_id", "document_id", "document_name"):
        reason = reason.when(differs(name), f"{name} does not match source")
    judged = joined.withColumn("reason", reason)
    same = ["answer_id", "source_id", "reason"]
    cited = ["chunk_id", "document_id", "document_name"]
    accepted = judged.filter("reason is null").groupBy(*same, *cited).agg(F.min("ord").alias("ord"))
    rejected = judged.filter("reason is not null").groupBy(*same).agg(
        F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in cited])
    columns = ["answer_id", "ord", "source_id", *cited, "reason"]
    return accepted.select(columns).unionByName(rejected.select(columns))


def supported_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers (answer_id, used_source_ids): unsupported ids are dropped and then the answer
    needs human review. One answer names few sources; the ids are put back in order."""
    ids = answers.select("answer_id", F.posexplode_outer("used_source_ids").alias("ord", "source_id"))
    known = sources.select("answer_id", "source_id", F.lit(True).alias("known"))
    joined = ids.join(known, ["answer_id", "source_id"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("ord", "source_id"))))
    return joined.groupBy("answer_id").agg(
        F.transform(kept, lambda s: s["source_id"]).alias("used_source_ids"),
        F.coalesce(
            F.bool_or(F.col("source_id").isNotNull() & F.col("known").isNull()), F.lit(False)
        ).alias("human_review_required"),
    )
