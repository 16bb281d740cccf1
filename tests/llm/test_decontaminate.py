import random

import pytest

from reportlake.llm import decontaminate as D
from tests.llm.helpers import documents, from_texts, lower, words


def brute(docs, items, n=5, share=0.8):
    def grams(w, k):
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}

    out = set()
    for d, t in docs:
        for i, x in items:
            w = words(lower(x))
            k = min(n, len(w))
            if not k:
                continue
            own, here = grams(w, k), grams(words(lower(t)), k)
            if len(own & here) >= share * len(own):
                out.add((d, i, len(own), len(own & here)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_equal_to_brute_force(spark, block):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 60])))) for i in range(30)]
    texts = []
    for k in range(120):
        w = rng.choices(vocabulary, k=rng.choice([0, 3, 40, 600]))
        if k % 2:
            piece = rng.choice(items)[1].upper().split()
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = piece
        texts.append((k, "\n".join(w)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as n_found")
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id")
    got = {tuple(r) for r in D.contaminated(df, bench, block_bytes=block).collect()}
    assert got == brute(texts, items) and got


def test_odd_rows(spark):
    passage = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, " "), (None, "alpha beta gamma delta eps zeta")], "item_id bigint, text string")
    texts = [None, "", passage, passage + " " + "x y z " * 70_000, "Alpha beta\tgamma delta eps zeta"]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)] + [(2, passage, None, "s", 0), (None, passage, None, "s", 0)]
    docs = documents(spark, rows)
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(2, 1), (3, 1), (4, None), (None, 1)], key=repr)
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 1]
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.contaminated(from_texts(spark, []), bench).count() == 0
