import hashlib
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st

from reportlake.llm import arrays, fim
from tests.llm.helpers import documents

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"
    return doc_id, len(units), form, len(x), len(y), out, text


def got(spark, rows, size):
    done = fim.fill_in_middle(fim.framed(documents(spark, rows), size=size))
    return [tuple(r) for r in fim.texts(done).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()]


@pytest.mark.parametrize("size", [5, 16, fim.FRAME])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(size)
    letters = list("ab é漢😀 \t\n <PSM>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 90))) for _ in range(150)]
    texts += [None, "", " ", "\n\n", "word", " word ", "<P", "P>", "<P>", "a <M> b", "a<S>", "<<P>>", "x" * 500, "é" * 300 + " ", " " * 200]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, "s", 0), (None, "a b c d", None, "s", 0), (None, None, None, None, None)]
    want = [brute(r[0], r[1]) for r in rows]
    assert sorted(got(spark, rows, size), key=repr) == sorted(want, key=repr)


def test_long_text_and_digests(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + "x" * 1_000_000
    rows = [(i, text, None, "s", 0) for i in range(6)]
    done = fim.digests(fim.fill_in_middle(fim.framed(documents(spark, rows)))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r[0]: brute(r[0], r[1]) for r in rows}
    for r in done:
        w = want[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == w[1:5]
        assert (r["output_sha256"], r["restored_sha256"]) == (sha(w[5]), sha(w[6]))


def test_frames_are_independent_and_joined_they_are_one_stream(spark):
    text = "one two three é " * 50
    row = fim.framed(documents(spark, [(1, text, None, "s", 0)]), size=64).collect()[0]
    read = zstandard.ZstdDecompressor()
    parts = [read.decompress(f["data"]).decode() for f in row["frames"]]
    assert "".join(parts) == text and len(parts) > 5 and max(len(p.encode()) for p in parts) <= 64
    assert [f["chars"] for f in row["frames"]] == list(np.cumsum([0, *map(len, parts)])[:-1])
    joined = b"".join(f["data"] for f in row["frames"])
    assert read.stream_reader(joined, read_across_frames=True).read().decode() == text


def test_a_cut_reads_one_frame():
    data = np.frombuffer(b"aa bb cc dd ee ff", np.uint8)
    ends = fim.unit_ends(data, np.array([0, len(data)]))
    edges = fim.frame_edges(data, 4)
    press, plain = zstandard.ZstdCompressor(), zstandard.ZstdDecompressor().decompress
    frames = [{"units": int((ends <= e).sum()), "chars": e, "data": press.compress(data[e:f].tobytes())} for e, f in zip(edges, edges[1:])]
    for unit, end in enumerate([0, *ends]):
        reads = []
        which, at, chars = fim.locate(frames, unit, len(data), lambda d: reads.append(1) or plain(d))
        assert edges[which] + at == end == chars and len(reads) <= 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="a é\n<P>", max_size=12), max_size=5))
def test_units(texts):
    data, offsets = b"".join(t.encode() for t in texts), np.cumsum([0, *(len(t.encode()) for t in texts)])
    ends = fim.unit_ends(np.frombuffer(data, np.uint8), offsets)
    want = [int(o) + len(t[:m.end()].encode()) for o, t in zip(offsets, texts) for m in UNIT.finditer(t)]
    assert ends.tolist() == want


def test_empty_table_and_clashing_columns(spark):
    none = fim.digests(fim.fill_in_middle(fim.framed(documents(spark, []))))
    assert none.collect() == [] and "output_sha256" in none.columns
    odd = spark.createDataFrame([(7, "a b", "f", 3, "x")], "doc_id bigint, text string, frames string, n int, output string")
    assert fim.texts(fim.fill_in_middle(fim.framed(odd))).first()["restored"] == "a b"
    assert arrays.IS_SPACE[32]
