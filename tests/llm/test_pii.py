import re

import pyarrow as pa
from hypothesis import given, settings, strategies as st

from reportlake.llm import pii
from tests.llm.helpers import from_texts


def brute(text):
    """The patterns of the contract as they are written."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out)


PARTS = st.sampled_from(["a", "b.c", "@", "@@", "x@y.z", ".", "..", "-", " ", "+", "+1", "(555)", "1", "255", "256", "000",
                         "4111111111111111", "1.2.3.4", ".5", "é", "\n", "%"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_equals_patterns(text):
    assert sorted(pii.detect(text)) == brute(text)


def added(text):
    base = pii.detect(text)
    return [(k, text[a:b]) for k, a, b in pii.disguised(text, base)]


def test_disguises_map_back_to_the_source():
    assert added("é mail jane.doe [at] mail (dot) example {dot} com now") == [("email", "jane.doe [at] mail (dot) example {dot} com")]
    assert added("write bob at example dot com or not") == [("email", "bob at example dot com")]
    assert added("see jоhn@exаmple.com") == [("email", "jоhn@exаmple.com")]
    assert added("call plus one five five five two three four five six seven eight ok") == [
        ("phone", "plus one five five five two three four five six seven eight")]
    assert added("ip １９２.168.０.1.") == [("ip", "１９２.168.０.1")]
    assert added("host one dot two dot three dot four") == [("ip", "one dot two dot three dot four")]
    assert added("card ٤١١١١١١١١١١١١١١١") == [("card", "٤١١١١١١١١١١١١١١١")]


def test_clean_text_stays_clean():
    assert added("She looked at example pages; one two dogs (at home) dot the i. [a] <b> 3 at 4") == []


def through_find(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = [spans for part in pii._find(iter([batch])) for spans in part.column("spans").to_pylist()]
    return [sorted((s["kind"], s["start"], s["end"], s["base"]) for s in spans) for spans in rows]


def ungated(text):
    base = pii.detect(text)
    return sorted([(*s, True) for s in base] + [(*s, False) for s in pii.disguised(text, base)])


SPELT = [
    "call plus-one-nine-one-seven-five-five-five-one-two-three-four", "plus-one nine-one-seven five-five-five one-two-three-four ok",
    "four-one-one-one 1111 1111 one-one-one-one", "4111 1111 1111 one one one one.", "x ten.168.0.1 one-dot-two-dot-three-dot-four!",
    "\"EINS ZWEI DREI FÜNF\" 4111", "plus one\x1cnine\x1done five five five one two three four",
    "mail bob@example dot com", "mail bob at example\x1fdot\x1fcom", "ip 192 dot 168 dot 0 dot 1", "×one two three four÷ 5",
]


def test_gate_passes_what_the_rewriters_take():
    """In ASCII texts without brackets, next to each other, as in the text alone."""
    assert through_find(SPELT) == [ungated(t) for t in SPELT]
    assert [s for t in SPELT[:2] for s in through_find([t])[0]] == [("phone", 5, 62, False), ("phone", 0, 57, False)]


WORDS = st.sampled_from(["one", "Two", "FÜNF", "zéro", "ZÉRO", "plus", "MÁS", "dot", "Punkt", "point", "at", "@", "bob", "example", "com",
                         "1", "192", "255", "x", "four.", "\"six", "_", "×", "é", "(", "[at]", ".", "１", "ſix"])
GAPS = st.sampled_from([" ", "-", "  ", "\n", ", ", "", "\x1c", "- ", "\xa0", "\x85"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.lists(st.tuples(WORDS, GAPS), max_size=12).map(lambda x: "".join(a + b for a, b in x)), min_size=1, max_size=4))
def test_gate_is_wider_than_the_rewriters(texts):
    _, hidden = pii._hints(*pii.arrays.string_buffer(pa.array(texts)))
    assert not [t for t, h in zip(texts, hidden) if not h and pii.undisguise(t).text != t]
    assert through_find(texts) == [ungated(t) for t in texts]


def test_bare_dots_beside_at_signs_and_numbers():
    assert added("mail bob@example dot com now") == [("email", "bob@example dot com")]
    assert added("mail bob [at] mail (dot) example dot co dot uk.") == [("email", "bob [at] mail (dot) example dot co dot uk")]
    assert added("ip 192 dot 168 dot 0 dot 1.") == [("ip", "192 dot 168 dot 0 dot 1")]
    assert added("ip 192 dot one six eight dot zero dot one") == [("ip", "192 dot one six eight dot zero dot one")]
    assert added("call +1 919 dot 555 dot 1234") == [("phone", "+1 919 dot 555 dot 1234")]
    assert added("mail a@b.co point taken, 3 point 5 percent, 2 point 1") == []


def test_table(spark):
    texts = ["mail a@b.co 1.2.3.4", None, "", "x" * 200_000 + " q@w.er", "bob [at] ex [dot] org", "1" * 50_000]
    df = from_texts(spark, texts).selectExpr("*", "3 as spans", "'k' as kind")
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find(df).collect()}
    assert got == {
        0: [("email", 5, 11, True), ("ip", 12, 19, True)], 1: [], 2: [], 3: [("email", 200_001, 200_007, True)],
        4: [("email", 0, 21, False)], 5: [],
    }
    assert pii.find(from_texts(spark, [])).count() == 0
