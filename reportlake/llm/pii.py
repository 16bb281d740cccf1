"""Personal data with source offsets, also behind disguises.

Plain identifiers are found in the text itself. Texts that could hold a disguise are rewritten by
three transducers that keep, for every character they write, the source characters it came from:
look-alike letters and digits, spelled digits, and words for "at" and "dot". Identifiers found in the
rewritten text are mapped back to source characters and added to the plain ones."""

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm import arrays

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKS_CYRILLIC = ("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijshdqwABEKMHOPCTXIJS")
LOOKS_GREEK = ("οανιρκυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oavipkuxABEZHIKMNOPTYX")
SIGNS = ("﹫․。‐‑‒–—−﹢＿", "@..------+_")
INVISIBLE = "­​‌‍⁠﻿"
# Words for the digits 0-9, for "at", "dot" and "plus".
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at arroba", "dot punkt point punto", "plus más"
LEAST_DIGIT_WORDS = 4

LOOKS = dict(zip("".join(p[0] for p in (LOOKS_CYRILLIC, LOOKS_GREEK, SIGNS)), "".join(p[1] for p in (LOOKS_CYRILLIC, LOOKS_GREEK, SIGNS))))
DIGITS = {w: str(k) for line in DIGIT_WORDS for k, w in enumerate(line.split())}
_or = "|".join
_digit, _dot, _at, _plus = (_or(sorted(x, key=len, reverse=True)) for x in (DIGITS, DOT_WORDS.split(), AT_WORDS.split(), PLUS_WORDS.split()))
SPELLED = re.compile(
    rf"(?<!\w)(?:(?:{_plus})[\s-]+)?(?:{_digit})(?:[\s-]+(?:{_digit}|{_dot})(?!\w))*(?!\w)", re.I)
SPELLED_ITEM = re.compile(r"[^\s-]+")
BRACKET = re.compile(rf"\s*[\[({{<]\s*(?:({_at}|@)|({_dot}|\.))\s*[\])}}>]\s*", re.I)
BARE = re.compile(
    rf"(?<![\w.%+-])[A-Za-z0-9._%+-]+(\s+(?:{_at})\s+)[A-Za-z0-9-]+((?:\s+(?:{_dot})\s+[A-Za-z0-9-]+)+)(?!\w)", re.I)
BARE_DOT = re.compile(rf"\s+(?:{_dot})\s+", re.I)
AFTER_AT = re.compile(rf"@([A-Za-z0-9.-]*[A-Za-z0-9-])((?:\s+(?:{_dot})\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)+)(?!\w)", re.I)
BETWEEN_NUMBERS = re.compile(rf"(?<=[0-9])\s+(?:{_dot})\s+(?=[0-9])", re.I)
# Every byte outside the words of these patterns; bytes above 0x7F count as inside.
NOT_WORD = np.array([not (chr(c).isalnum() or c == 95 or c > 127) for c in range(256)])

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Every '@' with a local part before it, back to the last match, and a domain after it."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        first = at
        while first > last and text[first - 1] in LOCAL:
            first -= 1
        found = DOMAIN.match(text, at + 1) if first < at else None
        last = found.end() if found else at + 1
        if found:
            out.append((first, last))
        at = text.find("@", last)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Each four parts of a dotted chain of numbers, if none is above 255."""
    out = []
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]


def detect(text: str, digits: bool = True) -> list[tuple[str, int, int]]:
    """Identifiers by kind; without digits only addresses are possible."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if digits:
        out += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


class Tape:
    """Rewritten text with the source range of each of its characters."""

    def __init__(self, text: str, start: list[int], end: list[int]) -> None:
        self.text, self.start, self.end = text, start, end

    def rewrite(self, changes: list[tuple[int, int, str]]) -> "Tape":
        """Replace [a, b) by up to one character per source range; changes are in order."""
        if not changes:
            return self
        text, start, end, at = [], [], [], 0
        for a, b, new in changes:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), start + self.start[at:], end + self.end[at:])


def plain_character(c: str) -> str:
    """What a character looks like: ASCII stays, full-width forms, digits and look-alikes change."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～" and c not in LOOKS:
        return chr(ord(c) - 0xFEE0)
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    return LOOKS.get(c, " " if c.isspace() else c)


def undisguise(text: str) -> Tape:
    places = list(range(len(text)))
    tape = Tape(text, places, [i + 1 for i in places])
    tape = tape.rewrite([(i, i + 1, p) for i, c in enumerate(text) if c > "\x7f" and (p := plain_character(c)) != c])
    changes = []
    for run in SPELLED.finditer(tape.text):
        items = [(m.start() + run.start(), m.end() + run.start(), m.group().lower()) for m in SPELLED_ITEM.finditer(run.group())]
        while items and items[-1][2] in DOT_WORDS.split():
            items.pop()
        if sum(w in DIGITS for _, _, w in items) < LEAST_DIGIT_WORDS:
            continue
        for k, (a, b, word) in enumerate(items):
            if k:
                changes.append((items[k - 1][1], a, ""))
            changes.append((a, b, DIGITS.get(word) or ("." if word in DOT_WORDS.split() else "+")))
    tape = tape.rewrite(changes)
    tape = tape.rewrite([(*m.span(), "@" if m.group(1) else ".") for m in BRACKET.finditer(tape.text)])
    changes = []
    for m in BARE.finditer(tape.text):
        changes.append((*m.span(1), "@"))
        changes += [(d.start() + m.start(2), d.end() + m.start(2), ".") for d in BARE_DOT.finditer(m.group(2))]
    tape = tape.rewrite(changes)
    changes = []
    for m in AFTER_AT.finditer(tape.text):
        # A domain with dots that stands so in the source is whole: "mail a@b.co point taken".
        if not ("." in m.group(1) and text[tape.start[m.start()]:tape.end[m.end(1) - 1]] == "@" + m.group(1)):
            changes += [(d.start() + m.start(2), d.end() + m.start(2), ".") for d in BARE_DOT.finditer(m.group(2))]
    tape = tape.rewrite(changes)
    return tape.rewrite([(*m.span(), ".") for m in BETWEEN_NUMBERS.finditer(tape.text)])


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers of the rewritten text, at their source, that no plain one of their kind contains."""
    tape = undisguise(text)
    if tape.text == text:
        return []
    found = {(kind, tape.start[a], tape.end[b - 1]) for kind, a, b in detect(tape.text)}
    return sorted(x for x in found if not any(k == x[0] and a <= x[1] and x[2] <= b for k, a, b in base))


def _hints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a digit, and all documents that `undisguise` could change."""

    def any_of(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] > total[at[:-1]]

    digit = any_of((data >= 48) & (data <= 57), offsets)
    # Characters above U+00FF, and the signs U+0080-U+00BF (lead byte 0xC2), × and ÷, but not accented letters.
    lead = (data == 0xC2) | (data >= 0xC4)
    lead[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bracket = any_of(np.isin(data, np.frombuffer(b"[({<", np.uint8)), offsets)
    # Words end wherever the patterns can end one; a spelled number is a run of digit and dot words.
    words = arrays.Words(data, offsets, NOT_WORD)
    hashes = words.hashes(lower=True)
    value, dot, at = (np.isin(hashes, _word_hashes(tuple(x))) for x in (DIGITS, DOT_WORDS.split(), AT_WORDS.split()))
    new = ~(value | dot)
    new[1:] |= words.doc[1:] != words.doc[:-1]
    run = np.cumsum(new)
    many = np.zeros(len(offsets) - 1, bool)
    many[words.doc[value & (np.bincount(run, value)[run] >= LEAST_DIGIT_WORDS)]] = True
    beside = digit | any_of(data == 64, offsets) | any_of(at, words.first)
    return digit, any_of(lead, offsets) | bracket | many | any_of(dot, words.first) & beside


def _word_hashes(listed: tuple[str, ...]) -> np.ndarray:
    """Hashes of words, whose accented letters (the only ones not lowered in texts) have either case."""
    data, offsets = arrays.string_buffer(pa.array([x for w in listed for x in {w, w.upper()}]))
    return arrays.placed_hashes(arrays.LOWER_CODE[data], offsets[:-1], offsets[1:])


def _find(stream):
    kinds = {k: i for i, k in enumerate(KINDS)}
    for batch in stream:
        out = []
        data, offsets = arrays.string_buffer(batch.column("text"))
        texts = batch.column("text")
        for a, b in arrays.slices(offsets):
            own, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            digit, hidden = _hints(own, at)
            sign = np.concatenate([[0], np.cumsum(own == 64)])
            for i in range(b - a):
                if not (digit[i] or hidden[i] or sign[at[i + 1]] > sign[at[i]]):
                    out.append([])
                    continue
                text = texts[a + i].as_py() or ""
                base = detect(text, bool(digit[i]))
                spans = [(*s, True) for s in base]
                if hidden[i]:
                    spans += [(*s, False) for s in disguised(text, base)]
                spans.sort(key=lambda s: (s[1], kinds[s[0]], s[2]))
                out.append([{"kind": k, "start": s, "end": e, "base": o} for k, s, e, o in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, kind)], [*names, "spans"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and `spans` (kind, start, end in code points, base) of every row, sorted by start and kind.

    Rows are independent: repeated rows and null ids are kept; null and empty texts have no spans.
    Other columns are ignored."""
    source = docs.select(id_col, F.col(text_col).alias("text"))
    return source.mapInArrow(_find, f"`{id_col}` {source.dtypes[0][1]}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
