"""Long words of two letters, on which polynomial hashes modulo a power of two cannot tell texts apart."""

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reportlake.llm import arrays, bpe, decontaminate, near_dedup, substring_dedup
from reportlake.llm.plans import TOKENIZER
from tests.llm.helpers import documents


def pair(levels):
    """A word of 2^levels letters and its complement."""
    word = "a"
    for _ in range(levels):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 13), st.lists(st.sampled_from(["x", "yy", "aab"]), max_size=4))
def test_words_of_a_pair_differ(levels, more):
    data, offsets = arrays.string_buffer(pa.array([" ".join([*pair(levels), *more])]))
    words = arrays.Words(data, offsets)
    hashes = words.hashes()
    assert hashes[0] != hashes[1] and len(set(hashes[:2].tolist())) == 2


@pytest.mark.parametrize("levels", [10, 12])
def test_operators_tell_them_apart(spark, levels):
    one, other = pair(levels)
    around = [f"x{i}" for i in range(12)]
    docs = documents(spark, [(i, " ".join([*around, w, *around]), None, "s", 0) for i, w in enumerate((one, other))])
    assert [r["n_removed"] for r in substring_dedup.drop_repeats(docs).orderBy("doc_id").collect()] == [0, 0]
    near = documents(spark, [(i, f"p q r {w} p q r", None, "s", 0) for i, w in enumerate((one, other))])
    assert [r["kept"] for r in near_dedup.near_groups(near, shingle=4).orderBy("doc_id").collect()] == [True, True]
    bench = spark.createDataFrame([(1, f"p q r {one} p q r")], "item_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(near, bench).collect()] == [0]
    got = bpe.encode(documents(spark, [(i, f"{a} {b}", None, "s", 0) for i, (a, b) in enumerate([(one, other), (other, one)])]), TOKENIZER)
    library = Tokenizer.from_file(TOKENIZER)
    assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == {
        i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate((f"{one} {other}", f"{other} {one}"))}


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(arrays, "placed_hashes", lambda codes, starts, ends: np.full(len(starts), 1 << 40, np.uint64) + (ends - starts).astype(np.uint64) % np.uint64(3))
    own = bpe.vocabulary(open(TOKENIZER).read())
    texts = ["ab cd ab efg hi", "", "zz <|endoftext|> zz abcdefghi abcdefghj", "é é ü"]
    data, offsets = arrays.string_buffer(pa.array(texts))
    part = bpe.Slice(data, offsets, list(own.special))
    words = [data[a:b].tobytes() for a, b in zip(part.start.tolist(), part.end.tolist())]
    assert b"".join(words[k] for k in part.place) == data.tobytes() and len(set(words)) == len(words)


def test_long_words_take_seconds(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    texts = ["".join(rng.choice(letters, 1_000_000)), "ab" * 300_000, "a" * 400_000, "漢字" * 50_000, "x" * 257, "y" * 256]
    library = Tokenizer.from_file(TOKENIZER)
    start = time.time()
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(documents(spark, [(i, t, None, "s", 0) for i, t in enumerate(texts)]), TOKENIZER).collect()}
    assert time.time() - start < 120
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_rows_that_share_an_id_go_by_their_text(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 1000, 60)]
    rows = [(3, " ".join(base)), (5, " ".join(base[:-1])), (5, "a text of its own that nothing else is like at all"), (None, " ".join(base)), (None, "free text")]
    docs = documents(spark, [(d, t, None, "s", 0) for d, t in rows])
    left = {(r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(docs).collect()}
    assert left == set(rows)
    alone = documents(spark, [(d, t, None, "s", 0) for d, t in (*rows[:2], *rows[3:])])
    assert {(r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(alone).collect()} == {rows[0], *rows[3:]}
    bench = spark.createDataFrame([(1, " ".join(base[10:40]))], "item_id bigint, text string")
    left = {(r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {rows[2], rows[4]}


def test_texts_stay_where_no_language_is_known(spark):
    from reportlake.llm import langid

    docs = documents(spark, [(1, "some words", None, "s", 0), (2, "123", None, "s", 0), (3, None, None, "s", 0)])
    model = langid.fit(docs, "doc_id", "text", "lang")
    assert [r["doc_id"] for r in langid.keep(docs, model).collect()] == [1]


def test_workers_need_no_copy_of_the_package():
    """Broadcasts hold plain values; classes travel with the functions."""
    import pickle

    from reportlake.llm import langid, toxicity
    from reportlake.llm.decontaminate import Index

    for thing in (langid.Model([], np.zeros((0, langid.SIZE))), toxicity.Field(), Index([(1, "a b c d e f")], 5, 0.8)):
        assert b"reportlake" not in pickle.dumps(vars(thing))
