import random

import numpy as np

from reportlake.llm import langid
from tests.llm.helpers import documents, from_texts

SOUNDS = {"aa": ["tan", "kal", "mor"], "bb": ["öli", "üne", "ßter"], "cc": ["que", "llo", "ión"], "dd": ["wij", "ikx", "oek"]}


def corpus(n=240):
    rng = random.Random(1)
    for i in range(n):
        lang = sorted(SOUNDS)[i % 4]
        yield i, " ".join("".join(rng.choices(SOUNDS[lang], k=2)) for _ in range(rng.randint(3, 40))), lang, "s", 0


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and set(np.unique(code)) == {-1.0, 1.0}
    assert langid.codewords(4).shape == (4, 7)


def test_learns_and_decodes(spark):
    train = documents(spark, list(corpus()))
    model = langid.fit(train, "doc_id", "text", "lang")
    rows = [(i + 1000, t, l, s, n) for i, t, l, s, n in corpus(80)]
    odd = [(1, None, "aa", "s", 0), (2, "", "aa", "s", 0), (3, "12 !! 34", None, "s", 0), (None, "ß" * 9, None, "s", 0), (5, "tan" * 100_000, None, "s", 0)]
    got = {r.doc_id: r for r in langid.predict(documents(spark, rows + odd).selectExpr("*", "1 as score", "2 as lang_pred"), model).collect()}
    assert all(got[i].lang_pred == l and 0 < got[i].score <= 1 for i, _, l, _, _ in rows)
    assert [got[i].lang_pred for i in (1, 2, 3, None, 5)] == ["und", "und", "und", "bb", "aa"]
    assert [got[i].score for i in (1, 2, 3)] == [0.0, 0.0, 0.0]


def test_few_or_no_languages(spark):
    none = langid.fit(documents(spark, [(1, "abc", None, "s", 3), (2, None, "aa", "s", 0)]), "doc_id", "text", "lang")
    assert [r.lang_pred for r in langid.predict(from_texts(spark, ["abc"]), none).collect()] == ["und"]
    one = langid.fit(documents(spark, [(1, "abc", "aa", "s", 3), (1, "abc", "aa", "s", 3)]), "doc_id", "text", "lang")
    assert [(r.lang_pred, r.score) for r in langid.predict(from_texts(spark, ["x", ""]), one).collect()] == [("aa", 1.0), ("und", 0.0)]
    assert langid.predict(documents(spark, []), one).count() == 0
