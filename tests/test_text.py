import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from reportlake.functions import ids, scalars, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


WEIRD = [
    "Điều 8 09/2019/NĐ-CP", "Straße STRASSE ẞ", "été ÉTÉ", "İstanbul ŉ ǰ", "ΣΑΣ σας",
    "a.b/c-d e..f _x_ ½ ²", "ﬁn ﬀ", "한국 조선", "", "...", "x y", "Ⅷ ⅷ", "ÅB Å",
]


def test_tokens_equal_python(spark):
    pattern = re.compile(r"[\wÀ-ỹ]+(?:[./-][\wÀ-ỹ]+)*")
    expected = [[t.casefold() for t in pattern.findall(unicodedata.normalize("NFC", w))] for w in WEIRD]
    assert column(spark, WEIRD, text.tokens) == expected


def test_label_key_equals_python(spark):
    cases = [*WEIRD, "  Tổng   SỐ đơn : ", "Nam::", "\tMã\nđịa bàn:", None]
    expected = [
        re.sub(r"\s+", " ", unicodedata.normalize("NFC", c or "").strip().casefold()).rstrip(":")
        for c in cases
    ]
    assert column(spark, cases, text.label_key) == expected


HEADINGS = {
    "BƯỚC 1": True, "UBND TỈNH": True, "Hướng Dẫn Chung": True, "PHỤ LỤC 2 - BIỂU MẪU": True, "Báo Cáo Tháng 6/2026": True,
    "KẾT LUẬN:": True, "A" * 140: True, "A" * 141: False, "": False, "   ": False, "123 456": False, "ABC": False, "ABC 12": False,
    "ABCD": True, "Đ Ô A N": True, "UBND TỈNH.": False, "UBND TỈNH;": False, "UBND TỈNH,": False, "Hướng dẫn chung": False,
    "hướng dẫn": False, "Cơ quan thực hiện": False, "BƯỚC một": False, "ÉTÉ D'ÉCOLE": True, "Họ'S Name": True, "Họ's Name": False,
    "ǅAAA": False, "McDonald Farm": False, "1. TỔNG QUAN": True, "1. Tổng Quan": True, "1. Tổng quan": False,
}


def test_headings(spark):
    assert dict(zip(HEADINGS, column(spark, list(HEADINGS), text.is_heading))) == HEADINGS


@pytest.mark.parametrize(
    ("line", "kind", "identifier"),
    [
        ("Phần IV: Tổ chức", "part", "IV"),
        ("CHƯƠNG X", "chapter", "X"),
        ("mục 3. Báo cáo năm", "section", "3"),
        ("Điều 7đ - Kinh phí", "article", "7đ"),
        ("11) Họp giao ban", "clause", "11"),
        ("b. Kiểm tra hồ sơ", "point", "b"),
        ("Appendix B-2 Tables", "appendix", "B-2"),
        ("III - KẾT QUẢ quý này", "template_section", None),
    ],
)
def test_structure(spark, line, kind, identifier):
    df = spark.createDataFrame([(line,), ("Cơ quan thực hiện.",)], "x string")
    found, body = (r["match"] for r in text.classify_structure(df, "x").collect())
    assert (found["kind"], found["identifier"]) == (kind, identifier)
    assert body is None


def test_lines_broken_inside_a_sentence_are_mended(spark):
    cases = {
        "Báo cáo tháng này\ngồm ba phần": "Báo cáo tháng này gồm ba phần",
        "Số liệu liên-\nthông\nvà đầy đủ": "Số liệu liênthông và đầy đủ",
        "Kết thúc câu.\nphần sau": "Kết thúc câu.\nphần sau",
        "Khoản 3 nêu rõ\nnội dung": "Khoản 3 nêu rõ\nnội dung",
        "số hiệu: 44/KH\ntiếp theo": "số hiệu: 44/KH\ntiếp theo",
        "Ghi chú [ô trống]\nvào đây": "Ghi chú [ô trống]\nvào đây",
        "CỘNG HÒA\nhội đồng": "CỘNG HÒA\nhội đồng",
        "một\r\n\u2028\n\n hai\u00a0\u200bba ": "một\n\nhai ba",
        "\n\n  dòng đầu\nDòng hai": "dòng đầu\nDòng hai",
        "\n \n": "",
        "\t a  \t b ": "a b",
        "": "",
    }
    assert column(spark, [*cases, None], text.clean_text) == [*cases.values(), None]


def test_query_normalization(spark):
    (query,) = column(spark, ["  Điều  8   Khoản 2 của 09/2019/NĐ-CP  "], text.normalize_query)
    assert query == "Điều 8 Khoản 2 của 09/2019/NĐ-CP"
    assert column(spark, [query], text.identifiers) == [["Điều 8", "Khoản 2", "09/2019/NĐ-CP"]]


def test_masks_are_numbered_from_the_last(spark):
    value = "a 0901234567 b +84912345678 id 012345678901 api_key=xyz"
    df = spark.createDataFrame([(value,), ("x\n  MẬT \ny",)], "t string")
    first, second = text.mask_personal_data(df, "t").collect()
    assert first["redacted_text"] == "a [PHONE_2]b [PHONE_1]id [IDENTIFIER_3] [SECRET_4]"
    assert first["reasons"] == ["masked_phone", "masked_identifier", "masked_secret"]
    assert first["restoration_map"]["[SECRET_4]"] == "api_key=xyz"
    restored = first["redacted_text"]
    for token, original in first["restoration_map"].items():
        restored = restored.replace(token, original)
    assert restored == value
    assert not second["allowed"] and second["redacted_text"] == ""


def test_uuid5(spark):
    names = ["a", "population:Xã Đông", "", "x" * 500]
    expected = [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert column(spark, names, ids.uuid5) == expected


def test_intents_tokens_names(spark):
    assert column(spark, ["Kiểm tra BÁO CÁO", "reporting"], text.intent_tags) == [
        ["rule_engine", "report_export"], []]
    assert column(spark, ["", "abcd", "abcde"], text.estimate_tokens) == [0, 1, 2]
    assert column(spark, ["dir/Báo cáo (1).PDF", "...", "đ.x.docx"], text.safe_file_name) == [
        "Bao_cao_1.pdf", "document", "x.docx"]


def test_scalars(spark):
    cells = {
        "18.621 người": 18621, "1,5": 1.5, "1.5": 1.5, "1.234": 1234, "05/02/2026": "date",
        "2026-2-5": "date", "31/02/2026": None, "x": "x", "1.234,5": "1.234,5", "": None,
        "12 %": 12, "NaN": "NaN", "+7 vụ": 7, "1e3": 1000,
    }
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r["c"]: r for r in scalars.parse_cells(df, "c").collect()}
    for cell, expected in cells.items():
        row = got[cell]
        if expected == "date":
            assert str(row["value_date"]) == "2026-02-05"
        elif isinstance(expected, str):
            assert (row["kind"], row["value_text"]) == ("text", expected)
        elif expected is None:
            assert row["value_num"] is None and row["value_date"] is None
        else:
            assert float(row["value_num"]) == expected
    assert got["31/02/2026"]["issue"] == "INVALID_DATE"
    assert column(spark, ["-1 2", "1.0", "", "x", " 7 "], scalars.to_integer) == [-12, None, None, None, 7]


def test_structural_lines_make_their_column_once(spark):
    df = spark.createDataFrame([("  Điều   5.  Hiệu lực ",), ("thân  bài",), (None,), ("",)], "x string").withColumn("y", text.squash(F.col("x")))
    found = text.structural_lines(df, "y", "m").select("x", "m.kind", "m.identifier")
    assert [(r["kind"], r["identifier"]) for r in found.collect()] == [("article", "5")]
    whole = text.classify_structure(df, "y", "m").filter("m is not null").select("x", "m.kind", "m.identifier")
    assert found.collect() == whole.collect()
    assert found._jdf.queryExecution().optimizedPlan().toString().count(text.WHITESPACE) == 1
