import random

import numpy as np
import pytest

from reportlake.llm import arrays, recompress, substring_dedup as S
from tests.llm.helpers import documents, words


def brute(rows, size):
    first = {}
    for d, t in sorted(rows):
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i:i + size]), (d, i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i:i + size])] < (d, i):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_equal_windows_have_equal_keys(levels):
    rng = np.random.default_rng(levels)
    x = rng.integers(0, 4, 4000).astype(np.uint64)
    x[2500:2900] = x[100:500]
    x[3500:3700] = 9
    hashes, first = arrays.mix(x), np.array([0, 1300, 1300, 2400, 4000])
    doc = np.repeat(np.arange(4), np.diff(first))
    for size in (1, 2, 5, 20):
        windows = np.flatnonzero(arrays.whole(doc, size))
        of, keys = recompress.anchors(hashes, first, windows, size, levels)
        seen = {}
        for p, k in zip(windows, keys[of].tolist()):
            assert seen.setdefault(tuple(x[p:p + size]), k) == k


def test_equal_to_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [rng.choices(vocabulary, k=rng.choice([19, 20, 21, 70])) for _ in range(12)]
    texts = ["", None, "a", "same " * 300, "a b " * 90, "word " * 19]
    for k in range(150):
        w = rng.choices(vocabulary, k=rng.choice([0, 5, 60, 400]))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        texts.append(rng.choice(["\n", " ", " \t"]).join(w))
    texts += [texts[20], texts[20], texts[30] + " end", "x y " * 60_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as v", "'k' as kept").repartition(7)
    for size in (20, 5):
        got = sorted(tuple(r) for r in S.drop_repeats(df, size=size).collect())
        assert got == brute(rows, size)


def test_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(5, passage, None, "s", 0), (5, passage, None, "s", 0), (None, passage, None, "s", 0), (7, "lead " + passage, None, "s", 0)]
    got = sorted(map(tuple, S.drop_repeats(documents(spark, rows)).collect()), key=repr)
    assert got == sorted([(5, 25, 0, passage)] * 2 + [(None, 25, 0, passage), (7, 26, 25, "lead")], key=repr)
    assert S.drop_repeats(documents(spark, [])).count() == 0


def test_worker_functions_travel_without_the_power_table():
    import pickle

    from reportlake.llm import arrays

    powers = arrays.Powers(arrays.BASE)
    up, down = powers.get(5)
    other = pickle.loads(pickle.dumps(powers))
    assert len(pickle.dumps(powers)) < 10_000
    assert (other.get(5)[0] == up).all() and (other.get(5)[1] == down).all()
