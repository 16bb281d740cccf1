from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from reportlake.llm import suffix_dedup as S, suffixes
from tests.llm.helpers import documents


def brute(rows, size):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i:i + size] for _, t in texts for i in range(len(t) - size + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - size + 1):
            if count[t[i:i + size]] > 1:
                gone[i + 1:i + 1 + size] = True
        out.append((d, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(b for b, g in zip(t, gone[1:]) if not g)))
    return sorted(out, key=repr)


def run(spark, rows, size, **more):
    docs = documents(spark, [(d, t, None, "s", 0) for d, t in rows]).repartition(3)
    done = S.drop_repeats(docs, size=size, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return sorted(((*r[:4], bytes(r[4])) for r in done.collect()), key=repr)


def passages(rng, n, letters="ab é\n"):
    return ["".join(rng.choice(list(letters), rng.integers(20, 160))) for _ in range(n)]


@pytest.mark.parametrize("size,gram,gathered", [(40, 16, 512), (40, 40, 512), (31, 8, 0), (60, 20, 1), (200, 64, 512)])
def test_equals_brute_force(spark, size, gram, gathered):
    rng = np.random.default_rng(size + gram)
    pool = passages(rng, 12)
    rows = [(i, "".join(pool[k] if rng.random() < 0.6 else passages(rng, 1)[0] for k in rng.integers(0, 12, rng.integers(0, 7)))) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(20)]
    rows += [(5, rows[5][1]), (6, "other"), (None, rows[5][1]), (None, None), (300, ""), (301, "a" * 1000), (302, "ab" * 300 + "c"), (303, "a" * (size - 1))]
    assert run(spark, rows, size, gram=gram, gathered=gathered) == brute(rows, size)


@pytest.mark.parametrize("gathered", [512, 20])
def test_common_passage_in_many_texts(spark, gathered):
    rng = np.random.default_rng(3)
    common, line = passages(rng, 1, "abcdefgh ")[0] * 3, passages(rng, 1, "abcdefgh ")[0][:60]
    rows = [(i, passages(rng, 1, "xyz ")[0] + (common if i % 2 else line) + passages(rng, 1, "uvw ")[0]) for i in range(300)]
    assert run(spark, rows, 100, gram=32, gathered=gathered) == brute(rows, 100)


def test_cut_inside_a_character(spark):
    rows = [(1, "é" * 40 + "x"), (2, "à" + "é" * 39 + "y"), (3, "plain")]
    assert run(spark, rows, 63, gram=20) == brute(rows, 63)


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 500)
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh"), 3000))
    rows = [(1, base), (2, "q" * 77 + base[700:2500] + "w" * 90), (3, base[:300] + base[100:400]), (4, "z" * 2000)]
    assert run(spark, rows, 120, gram=40) == brute(rows, 120)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, [], 200) == []
    odd = spark.createDataFrame([(1, "x" * 300, b"o", "r", 5)], "doc_id bigint, text string, owner binary, runs string, __key int")
    row = S.drop_repeats(odd).collect()[0]
    assert (row["n_bytes"], row["n_removed"], row["n_spans"], bytes(row["kept"])) == (300, 300, 1, b"")


def test_cover_meets_every_pair_of_remainders():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            shift = suffixes.SHIFT[a, b]
            assert {(a + shift) % suffixes.PERIOD, (b + shift) % suffixes.PERIOD} <= set(suffixes.COVER.tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"ab", b"a", b"abcabcabcabc" * 4, b"zz"]), min_size=30, max_size=90), st.integers(31, 70))
def test_suffix_order(parts, size):
    text = b"".join(parts)
    at = np.arange(len(text) - size + 1)
    if not len(at):
        return
    order = [text[i:i + size] for o, _ in suffixes.sorted_suffixes(np.frombuffer(text, np.uint8), at, size) for i in o]
    assert order == sorted(order) and len(order) == len(at)
    count = Counter(order)
    assert suffixes.repeated(np.frombuffer(text, np.uint8), at, size).tolist() == [i for i in at if count[text[i:i + size]] > 1]


def test_buckets_split_by_beginning():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    words = suffixes.words_at(text)
    at = np.arange(4900)
    made = list(suffixes.buckets(words, at, 300))
    assert len(made) > 5 and sorted(np.concatenate(made).tolist()) == at.tolist()
    assert all(words[a].max() < words[b].min() for a, b in zip(made, made[1:]))
