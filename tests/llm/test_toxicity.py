import itertools
import random

import numpy as np

from reportlake.llm import toxicity
from tests.llm.helpers import documents


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    field = toxicity.Field()
    field.weights = rng.normal(0, 1.5, toxicity.SIZE)
    field.moves, field.start = rng.normal(0, 1, 4), rng.normal(0, 1, 2)
    feature = rng.integers(0, toxicity.SIZE, (2, 11))
    first = np.zeros(11, bool)
    first[[0, 4, 5]] = True
    want = []
    for part in (feature.T[:4], feature.T[4:5], feature.T[5:]):
        total, one = 0.0, np.zeros(len(part))
        for states in itertools.product((0, 1), repeat=len(part)):
            s = field.start[states[0]] + sum(field.weights[f].sum() for f, y in zip(part, states) if y)
            s += sum(field.moves[2 * i + j] for i, j in zip(states[:-1], states[1:]))
            total += np.exp(s)
            one += np.exp(s) * np.array(states)
        want += (one / total).tolist()
    assert np.allclose(field.messages(feature, first)[0], want)


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = ["".join(rng.choices(["ba", "do", "ki", "mu"], k=2)) for _ in range(rng.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "Rotten,"])
        yield i, " ".join(words), int(toxic)


def test_learns_from_document_labels(spark):
    train = spark.createDataFrame(list(corpus(400, 1)), "doc_id bigint, text string, toxic int")
    field = toxicity.fit(train, train)
    rows = [(i, t, None, "s", 0) for i, t, _ in corpus(100, 2)]
    odd = [(1000, None, None, "s", 0), (1001, "", None, "s", 0), (None, "x é 12 rotten", None, "s", 0), (1003, "ba " * 80_000 + "vilest", None, "s", 0)]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows + odd).selectExpr("*", "1 as score", "2 as spans"), field).collect()}
    assert all((got[i].score >= 0.3) == bool(y) for i, _, y in corpus(100, 2))
    assert got[1000].score == got[1001].score < 0.3
    assert [(s.start, s.end) for s in got[None].spans] == [(7, 13)]
    assert [(s.start, s.end) for s in got[1003].spans] == [(240_000, 240_006)]


def test_without_labels(spark):
    empty = spark.createDataFrame([(1, "a b", 0), (2, None, None)], "doc_id bigint, text string, toxic int")
    field = toxicity.fit(empty, empty)
    assert all(r.score < 0.3 for r in toxicity.score(empty, field).collect())
    assert toxicity.score(documents(spark, []), field).count() == 0
