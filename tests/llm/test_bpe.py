import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from reportlake.llm import bpe
from reportlake.llm.lexicon import Transducer
from tests.llm.helpers import from_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = open(PATH, encoding="utf-8").read()
THEIRS = Tokenizer.from_file(PATH)
KNOWN = Transducer.mapped(bpe.compile_lexicon(TEXT, sorted([b"the", b" the", b" there", b" ther", b"'s", b".", b"\n"])))


def ours(texts):
    data, offsets = bpe.arrays.string_buffer(pa.array(texts, pa.string()))
    own = bpe.vocabulary(TEXT)
    ids, at = bpe.encode_slice(bpe.Slice(data, offsets, list(own.special)), own, KNOWN)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def theirs(texts):
    return [e.ids for e in THEIRS.encode_batch([t or "" for t in texts], add_special_tokens=False)]


PIECES = st.sampled_from(
    ["'s", "'ll", "'re", "'", " ", "  ", "\n", "\t", "a", "the", " there", "ß", "é", "12", "٣", "!", "...", " ",
     " ", "\x1c", "😀", "<|endoftext|>", "<|endof", "text|>", "中", "S", "'S", "x" * 30, "'lla", "'ve'd"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=5))
def test_equal_to_library_on_pieces(texts):
    assert ours(texts) == theirs(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x3FFF), max_size=30), max_size=4))
def test_equal_to_library_on_any_text(texts):
    assert ours(texts) == theirs(texts)


def test_transducer_shares_suffixes_and_finds_ranks():
    words = sorted([b"walking", b"talking", b"talk", b"walk", b"stalking"])
    known = Transducer.mapped(Transducer.build(words, [[i, i + 1] for i in range(5)]).to_bytes())
    data = np.frombuffer(b"".join([*words, b"wal", b"walkings", b""]), np.uint8)
    ends = np.cumsum([len(w) for w in words] + [3, 8, 0])
    starts = ends - [*map(len, words), 3, 8, 0]
    assert known.rank(data, starts, ends).tolist() == [0, 1, 2, 3, 4, -1, -1, -1]
    assert len(known.final) < 16


def test_round_trip(spark):
    texts = ["Hello there's 12  x\n\n y", None, "", "<|endoftext|>", "é😀" * 50_000, "a\n b\t"]
    df = from_texts(spark, texts).selectExpr("*", "array(1) as ids", "7 as n_tokens")
    encoded = bpe.encode(df, PATH)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert got == dict(enumerate(theirs(texts)))
    back = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(from_texts(spark, []), PATH).count() == 0


def test_decode_replaces_broken_bytes(spark):
    own = bpe.vocabulary(TEXT)
    ids = [int(own.byte_id[b]) for b in b"a\xe2\x82b\xff"]
    df = spark.createDataFrame([(1, ids), (2, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, PATH).collect()}
    assert got == {1: THEIRS.decode(ids, skip_special_tokens=False), 2: ""}
