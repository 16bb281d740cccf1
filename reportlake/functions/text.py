"""Text columns. Everything here runs in the JVM.

Java regexes take the flag group `(?iU)` wherever Vietnamese letters or Unicode digits must match
case-insensitively; `(?i)` alone folds ASCII only.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Character classes and patterns that decide results.
WHITESPACE = r"[\s\x1c-\x1f]"  # under the flag U
WORD = r"[\p{L}\p{N}_\u00c0-\u1ef9]"
TOKEN = WORD + "+(?:[./-]" + WORD + "+)*"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
# A character that may change under NFC, or fold differently from lower(). The first class is one
# range, so plain letters are passed quickly; the look-behind clears the other harmless ranges.
MAYBE_NOT_NFC = r"[^\x00-\u02ff](?<![\u1ea0-\u1ef9\u2010-\u2027\u2030-\u205e])"
MAYBE_FOLDS = (
    r"[^\x00-\xb4](?<![\xb6-\xde\xe0-\u012f\u0131-\u0148\u014a-\u017e\u01a0\u01a1\u01af\u01b0"
    r"\u1ea0-\u1ef9\u2010-\u2027\u2030-\u205e])"
)
IDENTIFIERS = (
    r"(?iU)\b\d{1,4}/\d{4}/[A-ZĐ-]+\b|\b(?:Điều|Khoản)\s+\d+[a-zđ]?\b|\bMẫu\s+số\s+\d+\b"
)
PAGE_NUMBER = (
    r"(?iU)^\s*(?:[-–—]\s*)?(?:trang\s+)?\d{1,4}(?:\s*/\s*\d{1,4})?(?:\s*[-–—])?\s*$"
)
DOCUMENT_NUMBER = r"(?iU)\b(?:Số|Số hiệu)\s*:\s*[\w./-]+"
PLACEHOLDER = r"\{\{\s*([A-Za-z0-9_.-]+)\s*\}\}"
SHA256_HEX = "^[0-9a-fA-F]{64}$"
SYNTHETIC_NAME = r"(?iU)Nguyễn\s+Văn\s+A"
CLASSIFIED = r"(?imdU)^\s*(?:TUYỆT\s+MẬT|TỐI\s+MẬT|MẬT)\s*$"
MASKS = (
    ("PHONE", r"(?U)(?<!\d)(?:\+84|0)(?:\d[ .-]?){8,10}(?!\d)"),
    ("IDENTIFIER", r"(?U)(?<!\d)\d{12}(?!\d)"),
    ("SECRET", r"(?iU)(?:api[_ -]?key|authorization)\s*[:=]\s*\S+"),
    ("LOCAL_PATH", r"(?iU)\b[A-Z]:\\[^\r\n]+"),
)
INTENTS = (
    (
        "rag_search",
        r"\b(?:regulation|citation|source|legal|template|quy định|trích dẫn|nguồn|"
        r"pháp lý|biểu mẫu)\b",
    ),
    (
        "data_query",
        r"\b(?:current|official|count|total|records?|hiện tại|số liệu|tổng|bản ghi)\b",
    ),
    ("kpi", r"\b(?:kpi|ratio|rate|percentage|tỷ lệ|chỉ số)\b"),
    ("rule_engine", r"\b(?:validate|check|warning|error|kiểm tra|cảnh báo|lỗi)\b"),
    ("report_export", r"\b(?:draft|report|export|docx|báo cáo|xuất|bản nháp)\b"),
)
# kind, level, pattern with (identifier, title); the first match wins.
TEMPLATE_SECTION = (
    r"(?iU)^(?:I{1,3}|IV|V|VI{0,3}|IX|X|\d+)\s*[.)-]\s*"
    r"(THÔNG TIN|NỘI DUNG|KẾT QUẢ|KIẾN NGHỊ|ĐÁNH GIÁ|TÌNH HÌNH).*$"
)
STRUCTURE = (
    ("part", 1, r"(?iU)^PHẦN\s+([A-ZÀ-Ỹ0-9IVXLCDM]+)\b(?:[.:-]?\s*(.*))?$"),
    ("chapter", 2, r"(?iU)^CHƯƠNG\s+([A-ZÀ-Ỹ0-9IVXLCDM]+)\b(?:[.:-]?\s*(.*))?$"),
    ("section", 3, r"(?iU)^MỤC\s+([A-ZÀ-Ỹ0-9IVXLCDM]+)\b(?:[.:-]?\s*(.*))?$"),
    ("article", 4, r"(?iU)^Điều\s+(\d+[a-zA-ZĐđ]?)\s*[.:-]?\s*(.*)$"),
    ("clause", 5, r"(?U)^(\d+)\s*[.)]\s+(.+)$"),
    ("point", 6, r"(?iU)^([a-zđ])\s*[.)]\s+(.+)$"),
    ("appendix", 1, r"(?iU)^(?:PHỤ\s+LỤC|APPENDIX)\s*([A-ZÀ-Ỹ0-9IVXLCDM.-]*)\s*(.*)$"),
)
# What a structural line other than a heading may start with.
STRUCTURE_START = r"(?iU)^(?:PH|CHƯƠNG|MỤC|Điều|APPENDIX|[ivx\d]|[a-zđ]\s*[.)])"
UPPER_LINE = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"
TITLE_LINE = (
    r"^[^\p{Lu}\p{Lt}\p{Ll}]*(?:[\p{Lu}\p{Lt}]\p{Ll}*(?:[^\p{Lu}\p{Lt}\p{Ll}]+|$))+$"
)
# Guards of the line joiner.
LEGAL_LINE = (
    r"(?iU)^\s*(?:(?:Phần|Chương|Mục|Điều|Khoản|Điểm)\s+[\p{L}\p{N}_\u00c0-\u1ef9.-]+|\d+[.)]\s+|[a-zđ][.)]\s+)"
)
FILL_IN = r"\.{3,}|_{3,}|\[[^\]]+\]|\{[^}]+\}"
SENTENCE_END = r"(?U)[.!?:;…]\s*$"
LOWER_START = r"^\p{IsLowercase}"
CAPITALS = r"^[^\p{IsLowercase}\p{Lt}]*\p{IsUppercase}[^\p{IsLowercase}\p{Lt}]*$"

_TOKEN_SEPARATOR = "\x01"


def _compose(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def _fold(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))


def nfc(text: Column) -> Column:
    """NFC by ICU, called only for rows that may need it.

    The call is non-deterministic to Catalyst, so filter before it, not after."""
    return F.when(text.rlike(MAYBE_NOT_NFC), _compose(text)).otherwise(text)


def nfkd(text: Column) -> Column:
    return F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True)
    )


def casefold(text: Column) -> Column:
    """NFC and full Unicode case folding; plain `lower` where that gives the same."""
    return F.when(text.rlike(MAYBE_FOLDS), _fold(_compose(text))).otherwise(F.lower(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{WHITESPACE}+|{WHITESPACE}+$", "")


def squash(text: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"(?U){WHITESPACE}+", " "))


def label_key(value: Column) -> Column:
    """Comparison key of a label cell: NFC, folded, single blanks, no final colon."""
    text = casefold(F.coalesce(value.cast("string"), F.lit("")))
    return F.regexp_replace(squash(text), ":+$", "")


def comparison_key(text: Column) -> Column:
    return casefold(squash(text))


def tokens(text: Column) -> Column:
    """Search tokens: word runs joined by inner `.`, `/` or `-`, folded token by token.

    Texts of plain Latin letters take one pass; the others are composed, cut, and folded as one
    joined string."""
    found = F.regexp_extract_all(_compose(text), F.lit(TOKEN), F.lit(0))
    folded = F.split(_fold(F.array_join(found, _TOKEN_SEPARATOR)), _TOKEN_SEPARATOR)
    return F.when(text.rlike(MAYBE_FOLDS), F.filter(folded, lambda t: t != "")).otherwise(
        F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    )


def normalize_query(query: Column) -> Column:
    return squash(nfc(query))


def identifiers(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(query, F.lit(IDENTIFIERS), F.lit(0)))


def estimate_tokens(text: Column, empty: int = 0) -> Column:
    """Four characters make a token; at least one, `empty` for the empty text."""
    size = F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))
    return F.when(F.length(text) == 0, F.lit(empty)).otherwise(size)


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def has_document_number(text: Column) -> Column:
    return text.rlike(DOCUMENT_NUMBER)


def is_heading(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    fits = (F.length(text) > 0) & (F.length(text) <= 140) & ~text.rlike("[.;,]$")
    return F.when(fits & (letters >= 4), text.rlike(UPPER_LINE) | text.rlike(TITLE_LINE)).otherwise(
        F.lit(False)
    )


def classify_structure(df: DataFrame, column: str, name: str = "match") -> DataFrame:
    """Add struct(kind, level, identifier, title, label) of structural lines; null for body text.

    The column has its blanks squashed already. The number of the first rule that matches is
    found first; only its pattern then takes the line apart, which keeps the generated code small."""
    line, number = F.col(column), F.col("_rule")
    heading_no = len(STRUCTURE) + 1
    heading = F.when(is_heading(line), F.lit(heading_no))
    rules = F.when(line.rlike(TEMPLATE_SECTION), F.lit(0))
    for i, (_, _, pattern) in enumerate(STRUCTURE, 1):
        rules = rules.when(line.rlike(pattern), F.lit(i))
    # Body text fails the common start and is tested as a heading only.
    first = F.when(line.rlike(STRUCTURE_START), rules.otherwise(heading)).otherwise(heading)

    def pick(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), number)

    pattern = pick([None, *[p for _, _, p in STRUCTURE], None])
    part = lambda i: F.call_function("regexp_extract", line, pattern, F.lit(i))
    found = F.struct(
        pick(["template_section", *[k for k, _, _ in STRUCTURE], "heading"]).alias("kind"),
        pick([2, *[n for _, n, _ in STRUCTURE], 3]).alias("level"),
        F.nullif(part(1), F.lit("")).alias("identifier"),
        F.nullif(F.trim(part(2)), F.lit("")).alias("title"),
        line.alias("label"),
    )
    return df.withColumn("_rule", first).withColumn(
        name, F.when(number.isNotNull(), found)).drop("_rule")


def structural_lines(df: DataFrame, column: str, name: str = "match") -> DataFrame:
    """The structural lines of `classify_structure` alone.

    Rows without a match are left out by a generator: a filter would be pushed below the projections, and
    every pattern in it would make the column anew."""
    found = classify_structure(df, column, "_match")
    kept = F.when(F.col("_match").isNotNull(), F.array("_match"))
    return found.select(*df.columns, F.explode(kept).alias(name))


def intent_tags(request: Column) -> Column:
    """Every capability class whose keywords occur in the request, in fixed order."""
    hits = [F.when(request.rlike("(?iU)" + p), F.lit(tag)) for tag, p in INTENTS]
    return F.filter(F.array(*hits), lambda tag: tag.isNotNull())


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(SHA256_HEX), F.lit(False))


def error_line(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, 1000)


def safe_file_name(name: Column) -> Column:
    """ASCII file name: decomposed, other runs replaced, stem of 180 characters at most."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))
    stem = F.when(suffix == "", base).otherwise(F.regexp_extract(base, r"^(.+)\.[^.]+$", 1))
    ascii_stem = F.regexp_replace(nfkd(stem), r"[^\x00-\x7f]", "")
    cleaned = F.regexp_replace(
        F.regexp_replace(ascii_stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""
    )
    cleaned = F.when(cleaned == "", F.lit("document")).otherwise(cleaned)
    return F.concat(F.substring(cleaned, 1, 180), suffix)


def _numbered(label: str, first: Column):
    return lambda i: F.concat(F.lit(f"[{label}_"), (first - i).cast("string"), F.lit("]"))


def _tokens_for(name):
    return lambda match, i: name(i)


def _masked(name, count: Column):
    return lambda piece, i: F.when(i < count, F.concat(piece, name(i))).otherwise(piece)


def mask_personal_data(df: DataFrame, column: str, restricted: Column | None = None) -> DataFrame:
    """Add `allowed`, `redacted_text`, `reasons` and `restoration_map` for a text column.

    A text is cut at each pattern; piece i is followed by the i-th match, and matches are numbered
    from the last one back, going on from one pattern to the next. One projection per pattern, so
    that each is matched once; texts without a match are passed on whole."""
    blocked = F.col(column).rlike(CLASSIFIED)
    if restricted is not None:
        blocked = blocked | restricted
    no_text = F.array().cast("array<string>")
    staged = df.withColumns(
        {"_blocked": blocked, "_text": F.col(column), "_used": F.lit(0), "_names": no_text,
         "_originals": no_text, "reasons": no_text}
    )
    for label, pattern in MASKS:
        found = F.col("_text").rlike(pattern)
        staged = staged.withColumn(
            "_pieces", F.when(found, F.split("_text", pattern, -1)).otherwise(F.array("_text"))
        ).withColumns({
            "_n": F.size("_pieces") - 1,
            "_matches": F.when(
                F.size("_pieces") > 1, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
            ).otherwise(no_text),
        })
        staged = staged.withColumn("_first", F.col("_used") + F.col("_n"))
        count = F.col("_n")
        name = _numbered(label, F.col("_first"))
        reason = F.when(count > 0, F.array(F.lit(f"masked_{label.lower()}"))).otherwise(no_text)
        staged = staged.withColumns({
            "_text": F.when(
                count > 0, F.array_join(F.transform("_pieces", _masked(name, count)), "")
            ).otherwise(F.col("_text")),
            "_names": F.concat("_names", F.transform("_matches", _tokens_for(name))),
            "_originals": F.concat("_originals", "_matches"),
            "reasons": F.concat("reasons", reason),
            "_used": F.col("_first"),
        })
    refused = F.array(F.lit("restricted_or_classified_content"))
    done = staged.withColumns({
        "allowed": ~F.col("_blocked"),
        "redacted_text": F.when(F.col("_blocked"), F.lit("")).otherwise(F.col("_text")),
        "reasons": F.when(F.col("_blocked"), refused).otherwise(F.col("reasons")),
        "restoration_map": F.when(
            ~F.col("_blocked"), F.map_from_arrays("_names", "_originals")),
    })
    return done.drop(
        "_blocked", "_text", "_used", "_names", "_originals", "_pieces", "_n", "_first", "_matches")


def table_text(table: Column) -> Column:
    """A table block as lines: name, headers, rows, cells separated by ` | `."""
    headers = F.when(F.size(table["headers"]) > 0, F.array_join(table["headers"], " | "))
    rows = F.transform(table["rows"], lambda row: F.array_join(row, " | "))
    head = F.filter(
        F.array(F.nullif(table["name"], F.lit("")), headers), lambda x: x.isNotNull()
    )
    return F.array_join(F.concat(head, F.coalesce(rows, F.array().cast("array<string>"))), "\n")


def clean_line(text: Column) -> Column:
    """Cleaning of a text without line breaks."""
    text = F.translate(nfc(text), "\u00a0\u200b", " ")
    return strip(F.regexp_replace(text, r"[ \t]+", " "))


def clean_text(text: Column) -> Column:
    """Cleaned block text; lines broken inside a sentence are put together again."""
    return F.when(text.rlike(LINE_BREAK), _mended(text)).otherwise(clean_line(text))


def _mended(text: Column) -> Column:
    """Paragraphs of a text of several lines.

    The fold holds the finished paragraphs and the open one; a blank line is an empty open
    paragraph, so further blank lines change nothing."""
    even = F.regexp_replace(F.translate(nfc(text), "\u00a0\u200b", " "), r"[ \t]+", " ")
    lines = F.transform(F.split(even, rf"\r\n|{LINE_BREAK}", -1), strip)
    state = lambda done, open_: F.struct(done.alias("done"), open_.alias("open"))

    def add(kept: Column, line: Column) -> Column:
        done, open_ = kept["done"], kept["open"]
        word_cut = open_.endswith("-") & line.rlike(LOWER_START)
        glued = F.when(word_cut, F.concat(open_.substr(F.lit(1), F.length(open_) - 1), line))
        return (
            F.when((line == "") & (open_ == ""), kept)
            .when(_goes_on(open_, line), state(done, glued.otherwise(F.concat_ws(" ", open_, line))))
            .otherwise(state(F.concat(done, F.array(open_)), line))
        )

    start = state(F.array().cast("array<string>"), F.lit(""))
    whole = lambda kept: F.array_join(F.concat(kept["done"], F.array(kept["open"])), "\n")
    return strip(F.aggregate(lines, start, add, whole))


def _goes_on(paragraph: Column, line: Column) -> Column:
    """Whether a line continues the paragraph above it."""
    broken = paragraph.endswith("-") | line.rlike(LOWER_START)
    own_line = paragraph.rlike(LEGAL_LINE) | line.rlike(LEGAL_LINE)
    complete = paragraph.rlike(DOCUMENT_NUMBER) | paragraph.rlike(SENTENCE_END)
    form = F.concat(paragraph, line).rlike(FILL_IN)
    title = paragraph.rlike(CAPITALS) | line.rlike(CAPITALS)
    return (paragraph != "") & (line != "") & broken & ~(own_line | complete | form | title)
