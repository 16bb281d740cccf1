"""Document blocks: numbering, cleaning and legal structure.

Blocks are rows (document_id, block_id, block_type, text, page_number, source_order, table); `table`
is struct<name,headers,rows> or null. Running state over a document goes through the tiled windows
of `ordered`, so a document of any length is spread over tasks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportlake.functions import text
from reportlake.operators.ordered import TILE, last_values, renumber

PAGE_BREAK, TABLE = "page_break", "table"
TABLE_TYPE = "struct<name:string,headers:array<string>,rows:array<array<string>>>"
LEVELS = range(1, 7)
MAX_EDGE_KEY = 160


def _block_id(order: Column) -> Column:
    return F.format_string("b-%06d", order)


def page_blocks(raw: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (document_id, page_number, block_no, text), pages (document_id, page_number, page_count)
    to numbered blocks with page breaks between pages, and a warning per page without text.

    Numbers are the place inside the page plus the block count of earlier pages."""
    filled = raw.withColumn("text", text.strip(F.col("text"))).filter("text <> ''")
    counts = filled.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("document_id").orderBy("page_number")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    known = pages.join(counts, ["document_id", "page_number"], "left").na.fill(0, ["n"])
    offsets = known.withColumn("offset", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)))
    place = F.row_number().over(
        Window.partitionBy("document_id", "page_number").orderBy("block_no")
    ) - 1
    numbered = filled.withColumn("place", place).join(
        offsets.select("document_id", "page_number", "offset"), ["document_id", "page_number"]
    )
    blocks = numbered.select(
        "document_id", F.lit("paragraph").alias("block_type"), "text", "page_number",
        (F.col("offset") + F.col("place")).cast("int").alias("source_order"),
    )
    breaks = offsets.filter("page_number < page_count").select(
        "document_id", F.lit(PAGE_BREAK).alias("block_type"), F.lit("").alias("text"),
        "page_number", (F.col("offset") + F.col("n")).cast("int").alias("source_order"),
    )
    warnings = known.filter("n = 0").select(
        "document_id", "page_number", F.lit("empty_page").alias("code"),
        F.lit("No extractable text found; OCR is not enabled in Phase 1.").alias("message"),
    )
    table = F.lit(None).cast(TABLE_TYPE)
    return (
        blocks.unionByName(breaks).withColumns(
            {"block_id": _block_id(F.col("source_order")), "table": table}
        ),
        warnings,
    )


def pad_table(rows: Column) -> Column:
    """First row as headers, all rows padded to the widest one."""
    padded = F.aggregate(
        rows,
        F.lit(0),
        lambda width, r: F.greatest(width, F.size(r)),
        lambda width: F.transform(
            rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))),
    )
    return F.struct(
        F.lit(None).cast("string").alias("name"),
        padded[0].alias("headers"),
        F.slice(padded, 2, F.greatest(F.size(rows) - 1, F.lit(0))).alias("rows"),
    ).cast(TABLE_TYPE)


def word_blocks(raw: DataFrame, tile: int = TILE) -> DataFrame:
    """raw (document_id, item_no, text, style, rows) to blocks: blank paragraphs and empty tables
    are left out, heading levels come from the end of the style name."""
    cells = F.transform("rows", lambda row: F.transform(row, lambda c: text.strip(c)))
    trimmed = raw.withColumns({"rows": cells, "text": text.strip(F.col("text"))})
    is_table = F.col("rows").isNotNull()
    filled = F.exists("rows", lambda row: F.exists(row, lambda c: c != ""))
    kept = trimmed.filter((is_table & filled) | (~is_table & (F.col("text") != "")))
    style = F.coalesce(F.lower("style"), F.lit(""))
    heading = ~is_table & style.startswith("heading")
    suffix = F.regexp_extract("style", r"(\d+)$", 1)
    ends_in_number = F.col("style").rlike(r"(^| )\d+$")
    numbered = renumber(kept, ["document_id"], "item_no", "source_order", tile)
    return numbered.select(
        "document_id",
        _block_id(F.col("source_order")).alias("block_id"),
        F.when(is_table, TABLE).when(heading, "heading").otherwise("paragraph").alias("block_type"),
        F.when(is_table, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(heading, F.when(ends_in_number, suffix.try_cast("int")).otherwise(F.lit(1)))
        .alias("heading_level"),
        F.lit(None).cast("int").alias("page_number"),
        F.col("source_order").cast("int").alias("source_order"),
        F.when(is_table, pad_table(F.col("rows"))).alias("table"),
    )


def shape_issues(blocks: DataFrame) -> DataFrame:
    """Blocks that may not be stored, with the first reason."""
    table, kind = F.col("table"), F.col("block_type")
    wide = F.exists(table["rows"], lambda r: F.size(r) > F.size(table["headers"]))
    reason = (
        F.when((kind == TABLE) & table.isNull(), "table_without_data")
        .when((text.strip(F.col("text")) == "") & table.isNull() & (kind != PAGE_BREAK),
              "block_without_content")
        .when((F.size(table["headers"]) > 0) & wide, "row_wider_than_headers")
        .when(F.col("source_order") < 0, "negative_order")
    )
    return blocks.select("document_id", "block_id", reason.alias("reason")).filter("reason is not null")


def content(blocks: DataFrame) -> Column:
    return F.when(F.col("table").isNotNull(), text.table_text(F.col("table"))).otherwise(F.col("text"))


# --- cleaning -----------------------------------------------------------------------------------


def repeated_page_edges(blocks: DataFrame) -> DataFrame:
    """(document_id, edge_key, occurrences): first or last blocks that repeat over the pages.

    One pass keeps two candidates per page; only their texts are cleaned here."""
    on_page = blocks.filter((F.col("page_number").isNotNull()) & (F.col("block_type") != PAGE_BREAK))
    edge = F.struct("source_order", "text", F.col("table").isNotNull().alias("is_table"))
    pages = on_page.groupBy("document_id", "page_number").agg(
        F.min_by(edge, "source_order").alias("first"), F.max_by(edge, "source_order").alias("last")
    )
    candidates = pages.select(
        "document_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")
    ).select("document_id", "e.*")
    keyed = (
        candidates.filter("not is_table")
        .withColumn("cleaned", text.clean_text(F.col("text")))
        .withColumn("edge_key", text.comparison_key(F.col("cleaned")))
        .filter((F.col("edge_key") != "") & (F.length("edge_key") <= MAX_EDGE_KEY))
        .filter(~text.has_document_number(F.col("edge_key")))
    )
    counts = keyed.groupBy("document_id", "edge_key").agg(F.count("*").alias("occurrences"))
    page_counts = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    threshold = F.greatest(F.lit(2), F.floor((F.col("n_pages") + 1) / 2))
    return (
        counts.join(page_counts, "document_id")
        .filter((F.col("n_pages") >= 2) & (F.col("occurrences") >= threshold))
        .select("document_id", "edge_key", "occurrences")
    )


def judged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with cleaned text and, where they are dropped, a `removal` code.

    A repeated edge is dropped wherever its text stands in the document."""
    exempt = (F.col("block_type") == PAGE_BREAK) | F.col("table").isNotNull()
    cleaned = blocks.withColumn("cleaned", text.clean_text(F.when(~exempt, F.col("text"))))
    keyed = cleaned.withColumn("edge_key", text.comparison_key(F.col("cleaned")))
    marked = keyed.join(repeated_page_edges(blocks), ["document_id", "edge_key"], "left")
    removal = (
        F.when(exempt, F.lit(None).cast("string"))
        .when(F.col("occurrences").isNotNull(), "repeated_page_edge_removed")
        .when(text.is_page_number(F.col("cleaned")), "isolated_page_number_removed")
        .when(F.col("cleaned") == "", "empty")
    )
    return marked.withColumns(
        {"removal": removal, "cleaned": F.coalesce(F.col("cleaned"), F.col("text"))}
    ).drop("edge_key", "occurrences")


def kept_blocks(judged: DataFrame, tile: int = TILE) -> DataFrame:
    """Remaining blocks, renumbered from zero in their old order."""
    rest = judged.filter("removal is null").drop("removal").withColumn("text", F.col("cleaned"))
    numbered = renumber(rest.drop("cleaned"), ["document_id"], "source_order", "_order", tile)
    return numbered.withColumn("source_order", F.col("_order").cast("int")).drop("_order")


def cleaning_warnings(judged: DataFrame) -> DataFrame:
    message = F.when(
        F.col("removal") == "repeated_page_edge_removed",
        F.concat(F.lit("Removed repeated header/footer: "), F.substring("cleaned", 1, 80)),
    ).otherwise(F.concat(F.lit("Removed isolated page marker: "), F.col("cleaned")))
    return judged.filter("removal is not null and removal <> 'empty'").select(
        "document_id", F.col("removal").alias("code"), message.alias("message"), "page_number",
        F.col("source_order").alias("block_index"),
    )


# --- structure ----------------------------------------------------------------------------------


def propagate_structure(blocks: DataFrame, tile: int = TILE) -> DataFrame:
    """Add heading_level, heading_hierarchy, article, clause, point and parent_block_id.

    The latest heading of each level is carried forward; it still stands where no heading of a
    smaller level came after it. Clause and point end with the article or clause above them."""
    plain = ~F.col("block_type").isin(PAGE_BREAK, TABLE)
    lines = blocks.withColumn("_line", text.squash(F.when(plain, F.col("text"))))
    found = text.classify_structure(lines, "_line").drop("_line")
    heading = F.struct(
        F.col("source_order").alias("at"), F.col("match.label").alias("label"),
        F.col("block_id").alias("id"), F.col("match.identifier").alias("identifier"),
    )
    carried = last_values(
        found, ["document_id"], "source_order",
        {f"_h{n}": F.when(F.col("match.level") == n, heading) for n in LEVELS}, tile,
    )
    at = {n: F.coalesce(F.col(f"_h{n}.at"), F.lit(-1)) for n in LEVELS}
    stands = {1: at[1] >= 0}
    for n in LEVELS[1:]:
        stands[n] = at[n] > F.greatest(F.lit(-1), *[at[k] for k in range(1, n)])
    labels = F.array_compact(F.array(*[F.when(stands[n], F.col(f"_h{n}.label")) for n in LEVELS]))

    level = F.col("match.level")
    above = F.coalesce(*[
        F.when(stands[n] & (level.isNull() | (level > n)), F.col(f"_h{n}.id"))
        for n in reversed(LEVELS)
    ])
    own_parent = F.col("parent_block_id") if "parent_block_id" in blocks.columns else F.lit(None).cast("string")
    own_level = F.col("heading_level") if "heading_level" in blocks.columns else F.lit(None).cast("int")
    added = {
        "heading_hierarchy": labels,
        "article": F.col("_h4.identifier"),
        "clause": F.when(at[5] > at[4], F.col("_h5.identifier")),
        "point": F.when(at[6] > F.greatest(at[4], at[5]), F.col("_h6.identifier")),
        "parent_block_id": F.when(level.isNull() & plain, own_parent).otherwise(above),
        "block_type": F.coalesce(F.col("match.kind"), F.col("block_type")),
        "heading_level": F.coalesce(level, own_level),
    }
    return carried.select(
        *[c for c in blocks.columns if c not in added], *[v.alias(k) for k, v in added.items()]
    )
