import re
import random

import pytest
from pyspark.sql import functions as F

from reportlake.operators import blocks, chunks, context, ordered
from reportlake.settings import Chunking

SCHEMA = ("document_id string, block_id string, block_type string, text string, page_number int, "
          f"source_order int, table {blocks.TABLE_TYPE}")


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def paragraphs(spark, document, texts, pages=None):
    return made(spark, [
        (document, f"b{i}", "paragraph", t, pages[i] if pages else None, i, None)
        for i, t in enumerate(texts)])


def kinds(spark, document, kind):
    return spark.createDataFrame(
        [(document, "name", kind, "tasks", "active")],
        "document_id string, document_name string, document_type string, domain string, document_status string")


def test_running_values_cross_tiles(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, None, i]), rng.randint(0, 3)) for g in "ab" for i in range(57)]
    df = spark.createDataFrame(rows, "g string, o int, v int, n int")
    for tile in (1, 5, 1000):
        last = ordered.last_values(df, ["g"], "o", {"last": F.col("v")}, tile)
        both = ordered.running_sum(last, ["g"], "o", {"total": F.col("n")}, tile)
        got = {(r["g"], r["o"]): (r["last"], r["total"]) for r in both.collect()}
        for g in "ab":
            latest, total = None, 0
            for _, o, v, n in (r for r in rows if r[0] == g):
                latest, total = (v if v is not None else latest), total + n
                assert got[g, o] == (latest, total)


def test_repeated_edges_and_page_numbers(spark):
    texts = ["UBND TỈNH", "Nội dung trang một.", "1", "UBND TỈNH", "Nội dung trang hai.", "2"]
    judged = blocks.judged_blocks(paragraphs(spark, "d", texts, [1, 1, 1, 2, 2, 2]))
    kept = blocks.kept_blocks(judged, tile=2).orderBy("source_order").collect()
    assert [(r["source_order"], r["text"]) for r in kept] == [
        (0, "Nội dung trang một."), (1, "Nội dung trang hai.")]
    assert {r["code"] for r in blocks.cleaning_warnings(judged).collect()} == {
        "repeated_page_edge_removed", "isolated_page_number_removed"}


LEGAL = ["Điều 1. Phạm vi", "1. Quy định thứ nhất.", "a) Nội dung chi tiết.", "Điều 2. Trách nhiệm",
         "Cơ quan thực hiện."]


def test_structure_and_legal_chunks(spark):
    found = blocks.propagate_structure(paragraphs(spark, "doc-test", LEGAL), tile=2)
    rows = found.orderBy("source_order").collect()
    assert [r["block_type"] for r in rows[:3]] == ["article", "clause", "point"]
    assert (rows[2]["article"], rows[2]["clause"], rows[2]["point"]) == ("1", "1", "a")
    assert rows[2]["parent_block_id"] == "b1"
    assert (rows[4]["article"], rows[4]["clause"]) == ("2", None)
    made_chunks = chunks.chunk_documents(found, kinds(spark, "doc-test", "legal"))
    out = made_chunks.orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in out] == ["doc-test-chunk-00000", "doc-test-chunk-00001"]
    assert [r["article"] for r in out] == ["1", "2"]
    assert out[0]["block_ids"] == ["b0", "b1", "b2"]
    assert chunks.chunk_issues(made_chunks, kinds(spark, "other", "legal")).count() == 2


def test_template_chunks_isolate_tables(spark):
    table = ("Tiến độ", ["Nhiệm vụ", "Kết quả"], [["A", "B"]])
    df = made(spark, [
        ("d", "b0", "template_section", "I. THÔNG TIN CHUNG", None, 0, None),
        ("d", "b1", "paragraph", "Tên đơn vị: ........", None, 1, None),
        ("d", "b2", "table", "", None, 2, table)])
    out = chunks.chunk_documents(df, kinds(spark, "d", "template")).orderBy("chunk_index").collect()
    assert len(out) == 2
    assert out[1]["content"] == "Tiến độ\nNhiệm vụ | Kết quả\nA | B"
    assert out[1]["table_name"] == "Tiến độ"


def test_long_groups_are_split_with_parents(spark):
    sentence = "Một câu dài vừa phải để cắt. "
    out = chunks.chunk_documents(
        paragraphs(spark, "d", [sentence * 150]), kinds(spark, "d", "legal")).orderBy("chunk_index").collect()
    assert len(out) > 2 and all(len(r["content"]) <= 1800 for r in out)
    assert {r["parent_chunk_id"] for r in out[1:]} == {"d-chunk-00000"}
    assert all(r["content"].endswith(".") for r in out)
    whole, config = (sentence * 150).strip(), Chunking()
    at = 0
    marks = [m.start() for m in re.finditer(chunks.SPLIT_AT, whole)]
    for begin, end in chunks.windows(len(whole), marks, config):
        assert begin <= at < end <= begin + config.maximum
        at = end
    assert at == len(whole)


def test_oversized_documents_are_named_and_still_packed(spark):
    df = paragraphs(spark, "big", ["x" * 50]).unionByName(paragraphs(spark, "small", ["y"]))
    both = kinds(spark, "big", "legal").unionByName(kinds(spark, "small", "legal"))
    assert [r[0] for r in chunks.oversized_documents(df, 20).select("document_id").collect()] == ["big"]
    assert {r["document_id"] for r in chunks.chunk_documents(df, both).collect()} == {"small", "big"}


def test_page_and_word_blocks(spark):
    raw = spark.createDataFrame([("d", 1, 0, " a "), ("d", 1, 1, " "), ("d", 1, 2, "b"), ("d", 3, 0, "c")],
                                "document_id string, page_number int, block_no int, text string")
    pages = spark.createDataFrame([("d", p, 3) for p in (1, 2, 3)],
                                  "document_id string, page_number int, page_count int")
    found, warnings = blocks.page_blocks(raw, pages)
    rows = found.orderBy("source_order").collect()
    assert [(r["block_id"], r["block_type"], r["text"]) for r in rows] == [
        ("b-000000", "paragraph", "a"), ("b-000001", "paragraph", "b"), ("b-000002", "page_break", ""),
        ("b-000003", "page_break", ""), ("b-000004", "paragraph", "c")]
    assert [r["page_number"] for r in warnings.collect()] == [2]
    words = spark.createDataFrame([
        ("d", 0, "Tên", "Heading 2", None), ("d", 1, " ", "Normal", None),
        ("d", 2, None, None, [["a", "b"], ["c"]]), ("d", 3, None, None, [["", ""]]),
        ("d", 4, "x", "Heading", None)],
        "document_id string, item_no int, text string, style string, rows array<array<string>>")
    out = blocks.word_blocks(words, tile=2).orderBy("source_order").collect()
    assert [(r["block_type"], r["heading_level"]) for r in out] == [
        ("heading", 2), ("table", None), ("heading", 1)]
    assert out[1]["table"]["rows"] == [["c", ""]]


def test_shape_issues(spark):
    df = made(spark, [
        ("d", "b0", "table", "", None, 0, None), ("d", "b1", "paragraph", " ", None, 1, None),
        ("d", "b2", "table", "", None, 2, (None, ["a"], [["x", "y"]])), ("d", "b3", "page_break", "", 1, 3, None)])
    assert {r["block_id"]: r["reason"] for r in blocks.shape_issues(df).collect()} == {
        "b0": "table_without_data", "b1": "block_without_content", "b2": "row_wider_than_headers"}


CANDIDATES = "query_id int, rank int, document_id string, chunk_id string, parent_chunk_id string, content string"


@pytest.mark.parametrize(
    ("parent", "budget", "expected", "notes"),
    [("parent", 1000, ["c1", "parent"], 0), ("missing", 1000, ["c1"], 1), ("parent", 1, ["c1"], 1)])
def test_parents(spark, parent, budget, expected, notes):
    corpus = spark.createDataFrame([("d1", "c1", "x"), ("d1", "parent", "Toàn văn")],
                                   "document_id string, chunk_id string, content string")
    candidates = spark.createDataFrame([(0, 1, "d1", "c1", parent, "x")], CANDIDATES)
    rows, warnings = context.expand_parents(candidates, corpus, budget)
    assert [r["chunk_id"] for r in rows.orderBy("position").collect()] == expected
    assert warnings.count() == notes


def test_context_and_citations(spark):
    row = (0, "d1", "Nghị định", "legal", "common", "Điều 8 quy định.", ["CHƯƠNG II", "Điều 8"], "8", [6])
    candidates = spark.createDataFrame(
        [(0, 1, "c1", *row[1:]), (0, 2, "c1", *row[1:]), (0, 3, "c9", *row[1:])],
        "query_id int, rank int, chunk_id string, document_id string, document_name string, document_type string, "
        "domain string, content string, heading_hierarchy array<string>, article string, page_numbers array<int>")
    sources, contexts = context.build_context(candidates, max_tokens=1000)
    built = contexts.first()
    assert sources.count() == 1 and built["n_sources"] == 1
    assert built["text"].startswith("[SOURCE_1]\nDocument ID: d1")
    assert "Location: CHƯƠNG II, Điều 8\nPage: 6" in built["text"]
    assert built["estimated_tokens"] == max(1, (len(built["text"]) + 3) // 4)
    assert context.build_context(candidates, max_tokens=1)[1].first()["truncated"]
    known = sources.withColumnRenamed("query_id", "answer_id")
    cited = spark.createDataFrame(
        [(0, 0, "SOURCE_1", "c1", "d1", None), (0, 1, "UNKNOWN", None, None, None),
         (0, 2, "UNKNOWN", None, None, None), (0, 3, "SOURCE_1", "c2", None, None)],
        "answer_id int, ord int, source_id string, chunk_id string, document_id string, document_name string")
    out = context.check_citations(cited, known).orderBy("ord").collect()
    assert [r["reason"] for r in out] == [
        None, "source_id was not retrieved", "chunk_id does not match source"]
    answers = spark.createDataFrame([(0, ["SOURCE_1", "UNKNOWN"]), (1, [])],
                                    "answer_id int, used_source_ids array<string>")
    done = {r["answer_id"]: r for r in context.supported_answers(answers, known).collect()}
    assert done[0]["used_source_ids"] == ["SOURCE_1"] and done[0]["human_review_required"]
    assert done[1]["used_source_ids"] == [] and not done[1]["human_review_required"]


def test_cleaning_is_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    """More input makes more parts, not larger ones."""
    import re

    from reportlake.operators import blocks, distribution
    from reportlake.plans import document_queries, registry

    monkeypatch.setattr(distribution, "SHARE_BYTES", 1 << 12, raising=False)
    judged = blocks.judged_blocks(document_queries.framed_lines(registry.Tables(spark, "/root/testdata/sf0.001")))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    parts = [int(n) for n in re.findall(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", plan)]
    assert parts and min(parts) > spark.sparkContext.defaultParallelism


def test_marks_of_one_text_at_a_time():
    """Ten texts full of marks take hardly more than one."""
    import tracemalloc

    from reportlake.operators import chunks
    from reportlake.settings import Chunking

    body = "a. b; " * 20_000

    def peak(n):
        tracemalloc.start()
        run = chunks.split_segments([body] * n, Chunking())
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, run

    (one, own), (ten, all_) = peak(1), peak(10)
    kept = sum(len(s) for s in own[0])
    assert all_ == own * 10 and ten < one + 10 * 2 * kept
