import random

import numpy as np

from reportlake.llm import quality
from tests.llm.helpers import documents


def test_label_model_finds_the_accurate_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(6000) < 0.8
    right = [0.95, 0.9, 0.85, 0.55]
    vote = np.stack([np.where(rng.random(6000) < 0.2, quality.NONE, np.where(rng.random(6000) < r, truth, ~truth)) for r in right], axis=1)
    codes, where, counts = np.unique(quality.pattern(vote), return_inverse=True, return_counts=True)
    assert (quality.unpack(codes, 4)[where] == vote).all()
    p = quality.label_model(codes, counts.astype(float), 4)
    assert ((p[where] > 0.5) == truth).mean() > 0.93


def corpus(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        words = ["".join(rng.choices(["ba", "do", "ki", "mu", "te"], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 90))]
        bad = i % 6 == 0
        yield i, " ".join(w + "###$" for w in words) if bad else " ".join(words) + ".", None, "s", 0


def test_learns_without_labels(spark):
    model = quality.fit(documents(spark, list(corpus(400, 1))))
    odd = [(1000, None, None, "s", 0), (1001, " \n", None, "s", 0), (None, "bado kimu tedo ba mute kido", None, "s", 0), (1003, "x" * 200_000, None, "s", 0)]
    got = {r.doc_id: r for r in quality.score(documents(spark, list(corpus(100, 2)) + odd).selectExpr("*", "1 as score", "2 as id"), model).collect()}
    assert all(got[i].good == (i % 6 != 0) for i in range(100))
    assert got[1000].score == got[1001].score == 0 and got[None].good


def test_empty(spark):
    model = quality.fit(documents(spark, []))
    assert quality.score(documents(spark, []), model).count() == 0
    assert quality.score(documents(spark, [(1, "abc", None, "s", 3)]), model).count() == 1
