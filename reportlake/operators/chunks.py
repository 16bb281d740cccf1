"""Blocks to chunks: packing along structure, splitting long text, chunk metadata.

A document may be of any size: packing is a segmented scan (see `packing`), and chunks are counted in
tiles. Only the blocks of one group are ever an array."""

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.functions import text
from reportlake.operators import ordered, packing
from reportlake.operators.blocks import PAGE_BREAK, content
from reportlake.operators.distribution import materialize
from reportlake.settings import MAX_FILE_BYTES, Chunking

# Block types that open a chunk, per document type.
BOUNDARIES = {
    "legal": ("article", "appendix"),
    "guideline": ("part", "chapter", "section", "heading", "appendix"),
    "template": ("template_section", "heading", "appendix"),
}
ISOLATED_TABLES = ("template",)
# A text is split at these, two characters each; they may overlap.
SPLIT_AT, MARKER_SIZE = r"(?=\n\n|\. |; )", 2
METADATA = ("heading_hierarchy", "article", "clause", "point", "parent_block_id")


def opens_chunk(document_type: Column, block_type: Column) -> Column:
    opens = F.lit(False)
    for kind, types in BOUNDARIES.items():
        opens = opens | ((document_type == kind) & block_type.isin(*types))
    return opens


def oversized_documents(blocks: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """(document_id, size) of documents above an upload limit; packing itself has none."""
    sizes = blocks.groupBy("document_id").agg(
        F.sum(F.octet_length(content(blocks)).cast("bigint")).alias("size")
    )
    return sizes.filter(F.col("size") > limit)


def pack(blocks: DataFrame, documents: DataFrame, config: Chunking = Chunking(), opens: Column | None = None) -> DataFrame:
    """Groups of blocks: one row per group with its blocks in order.

    documents (document_id, document_type, …) gives the strategy; `opens`, a condition over columns of
    both tables, gives another one: it is true where a block starts a group. A document may be of any
    size: only a group, which the target bounds, is ever an array."""
    part = F.struct(
        F.col("source_order").alias("at"), "block_id", "content", "page_number",
        *[F.col(c) if c in blocks.columns else F.lit(None).cast(
            "array<string>" if c == "heading_hierarchy" else "string").alias(c) for c in METADATA],
        F.col("table")["name"].alias("table_name"),
    )
    placed = {"key": F.col("document_id"), "tile": F.col("_tile"), "order": F.col("source_order").cast("bigint")}
    rows = ordered.tiled(blocks, "source_order", packing.TILE).filter(
        (F.col("block_type") != PAGE_BREAK) & F.col("document_id").isNotNull() & F.col("_tile").isNotNull()
    ).withColumn("content", content(blocks)).withColumns({"_item": part, "_size": F.length("content")})
    rows = rows.withColumn("_tie", F.xxhash64("_item"))
    # Only what decides the packing meets the documents; the blocks stay in their tiles.
    # A document listed twice would judge its blocks twice.
    kinds = documents.groupBy("document_id").agg(*[
        (F.first if "map<" in kind else F.max)(c).alias(c) for c, kind in documents.dtypes if c not in blocks.columns])
    single = F.col("document_type").isin(*ISOLATED_TABLES) & F.col("table").isNotNull()
    if opens is None:
        opens = opens_chunk(F.col("document_type"), F.col("block_type"))
    judged = rows.join(kinds, "document_id").select(
        *[c.alias(n) for n, c in placed.items()], F.col("_tie").alias("tie"), F.col("_size").alias("size"),
        opens.alias("opens"), single.alias("alone"))
    numbers = packing.numbered(packing.measured(judged, F.col("size"), F.col("opens"), F.col("alone")), config.target)
    source = rows.select(*[c.alias(n) for n, c in placed.items()], F.col("_tie").alias("tie"), F.col("_item").alias("item"))
    return packing.collected(source, numbers).select(
        F.col("key").alias("document_id"), "group", F.array_sort("items").alias("blocks"))


def render_group(blocks: Column) -> Column:
    """Non-blank contents, trimmed, with a blank line between."""
    parts = F.transform(blocks, lambda b: text.strip(b["content"]))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def _last(blocks: Column, name: str) -> Column:
    given = F.filter(blocks, lambda b: b[name].isNotNull())
    return F.try_element_at(given, F.lit(-1))[name]


def group_metadata(blocks: Column) -> dict[str, Column]:
    pages = F.array_sort(F.array_distinct(F.filter(
        F.transform(blocks, lambda b: b["page_number"]), lambda p: p.isNotNull())))
    # The longest hierarchy; of equal ones the earliest.
    deepest = F.array_max(F.transform(blocks, lambda b, i: F.struct(
        F.size(F.coalesce(b["heading_hierarchy"], F.array().cast("array<string>"))).alias("n"),
        (-i).alias("first"), b["heading_hierarchy"].alias("hierarchy"))))
    named = F.filter(blocks, lambda b: F.coalesce(b["table_name"], F.lit("")) != "")
    return {
        "page_numbers": pages,
        "heading_hierarchy": F.coalesce(deepest["hierarchy"], F.array().cast("array<string>")),
        "article": _last(blocks, "article"),
        "clause": _last(blocks, "clause"),
        "point": _last(blocks, "point"),
        "parent_block_id": _last(blocks, "parent_block_id"),
        "table_name": F.try_element_at(named, F.lit(1))["table_name"],
        "block_ids": F.transform(blocks, lambda b: b["block_id"]),
    }


def windows(size: int, marks: Sequence[int], config: Chunking) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping windows over `size` characters; `marks` are the places of all
    split markers in order. A window ends behind the first character of the last marker that lies
    in it, if that leaves more than half of the target."""
    start, least = 0, config.target // 2
    while size - start > config.maximum:
        room = bisect_right(marks, start + config.maximum - MARKER_SIZE)
        near = marks[room - 1] - start if room else 0
        length = near + 1 if near > least else config.maximum
        yield start, start + length
        start += max(length - config.overlap, 1)
    yield start, size


def cut(body: str, config: Chunking) -> list[str]:
    """Segments of one text; its marks are gone when the next text comes."""
    marks = array("q", (m.start() for m in re.finditer(SPLIT_AT, body)))
    return [p for x, y in windows(len(body), marks, config) if (p := body[x:y].strip())]


def split_segments(bodies: Iterable[str | None], config: Chunking) -> list[list[str]]:
    return [cut(body, config) if body else [] for body in bodies]


def split_text(body: Column, config: Chunking = Chunking()) -> Column:
    """Segments of a text; only texts above the maximum are split in Python. The marks of a text are
    found once, so the work grows with its length."""

    @F.pandas_udf("array<string>")
    def segments(bodies: pd.Series) -> pd.Series:
        return pd.Series(split_segments(bodies, config), dtype=object)

    long = F.length(body) > config.maximum
    return F.when(long, segments(F.when(long, body))).otherwise(F.array(body))


def chunk_documents(blocks: DataFrame, documents: DataFrame, config: Chunking = Chunking(), opens: Column | None = None) -> DataFrame:
    """Chunks with metadata; later segments of a group point to its first one."""
    groups = pack(blocks, documents, config, opens).withColumn(
        "body", render_group(F.col("blocks"))
    ).filter("body <> ''")
    described = groups.select(
        "document_id", "group", "body",
        *[v.alias(k) for k, v in group_metadata(F.col("blocks")).items()],
    )
    segments = materialize(described.withColumn("segments", split_text(F.col("body"), config)).drop("body"), even=False)
    # Numbers and documents meet without the texts, which move once.
    sizes = segments.select("document_id", "group", F.size("segments").alias("_size"))
    counted = ordered.running_sum(sizes, ["document_id"], "group", {"_upto": F.col("_size")}).select(
        "document_id", "group", (F.col("_upto") - F.col("_size")).alias("_before"))
    placed = counted.join(documents, "document_id")
    indexed = segments.join(placed, ["document_id", "group"]).select(
        *[c for c in segments.columns if c != "segments"], *[c for c in placed.columns if c not in ("document_id", "group")],
        F.posexplode("segments").alias("segment", "content"),
    ).withColumn("chunk_index", (F.col("_before") + F.col("segment")).cast("int")).drop("_before")
    name = lambda index: F.format_string("%s-chunk-%05d", F.col("document_id"), index)
    parent = F.when(F.col("segment") > 0, name(F.col("chunk_index") - F.col("segment")))
    return indexed.withColumns({"chunk_id": name(F.col("chunk_index")), "parent_chunk_id": parent}).drop("group", "segment")


def chunk_issues(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Failed chunk validation: foreign or blank chunks, and documents without any."""
    blank = chunks.filter(text.strip(F.col("content")) == "").select(
        "document_id", F.lit("blank_chunk").alias("issue"))
    foreign = chunks.join(documents, "document_id", "left_anti").select(
        "document_id", F.lit("foreign_chunk").alias("issue"))
    empty = documents.join(chunks, "document_id", "left_anti").select(
        "document_id", F.lit("no_chunks").alias("issue"))
    return blank.unionByName(foreign).unionByName(empty).distinct()


def embedding_input(chunks: DataFrame) -> Column:
    """Text handed to an embedder: labels, place in the document, content."""
    have = set(chunks.columns)
    column = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    hierarchy = F.coalesce(column("heading_hierarchy", "array<string>"), F.array().cast("array<string>"))
    labelled = F.array(*[
        F.struct(F.lit(f"{label}: ").alias("label"), F.nullif(column(name), F.lit("")).alias("value"))
        for label, name in (("Article", "article"), ("Clause", "clause"), ("Point", "point"),
                            ("Table", "table_name"))
    ])
    places = F.aggregate(
        labelled, hierarchy,
        lambda known, x: F.when(x["value"].isNull() | F.array_contains(known, x["value"]), known)
        .otherwise(F.concat(known, F.array(F.concat(x["label"], x["value"])))))
    location = F.when(F.size(places) > 0, F.concat(F.lit("Location: "), F.array_join(places, ", ")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Domain: "), "domain"),
        F.concat(F.lit("Document type: "), "document_type"),
        F.concat(F.lit("Document: "), "document_name"),
        location,
        F.lit("Content:"),
        "content",
    )


def semantic_metadata(source: Column, number: Column, issued: Column, effective: Column) -> Column:
    """Metadata map of an upload without empty entries, dates in ISO form."""
    iso = lambda day: F.date_format(day, "yyyy-MM-dd")
    entries = F.create_map(
        F.lit("source"), source, F.lit("document_number"), number,
        F.lit("issued_date"), iso(issued), F.lit("effective_date"), iso(effective),
    )
    return F.map_filter(entries, lambda _, v: v.isNotNull())
