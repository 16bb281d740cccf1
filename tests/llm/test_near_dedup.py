import random

import numpy as np

from reportlake.llm import near_dedup as N
from reportlake.llm.components import components
from tests.llm.helpers import documents, from_texts, lower, words


def brute(rows, k=4):
    def grams(t):
        w = words(lower(t))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = {d: grams(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.sort(both[:240]), np.sort(both[60:])
    s = N.superminhash(np.concatenate([a, b, both[:3]]), np.array([0, 240, 480, 483]), 256)
    assert abs((s[0] == s[1]).mean() - 180 / 300) < 0.1
    assert (s < np.uint64(2**63)).all()


def naive(values, slots):
    """The algorithm element by element."""
    out = [2**64 - 1] * slots
    for v in values:
        p = list(range(slots))
        for j in range(slots):
            r = int(N.arrays.mix(np.array([(int(v) + (j + 1) * int(N.STEP_SEED)) % 2**64], np.uint64))[0])
            k = j + ((r & 0xFFFFFFFF) * (slots - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | r >> 32)
    return out


def test_signature_equals_plain_algorithm():
    rng = np.random.default_rng(2)
    sizes = [1, 3, 40, 200]
    values = np.concatenate([np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in sizes])
    offsets = np.cumsum([0, *sizes])
    got = N.superminhash(values, offsets, 16)
    for k in range(len(sizes)):
        assert got[k].tolist() == naive(values[offsets[k]:offsets[k + 1]], 16)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(500, k) for k in range(501, 540)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def group(rng, vocabulary, base, n, most):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        yield " ".join(w)


def test_equal_to_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(2000)]
    texts = ["", None, "one", "ONE", "one two", "a b c d", "A B c d", "x " * 90_000]
    for most in (1, 3, 6, 12):
        base = rng.choices(vocabulary, k=rng.choice([60, 150]))
        texts += group(rng, vocabulary, base, 60, most)
    chain = rng.choices(vocabulary, k=120)
    for k in range(12):
        chain = chain[3:] + rng.choices(vocabulary, k=3)
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choices(vocabulary, k=50)) for _ in range(60)]
    rng.shuffle(texts)
    df = from_texts(spark, texts).selectExpr("*", "1 as n", "2 as component", "3 as id")
    got = sorted(tuple(r) for r in N.near_groups(df, shingle=4).collect())
    assert got == brute(list(enumerate(texts)))


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", None, "s", 0), (1, "a b c d e f", None, "s", 0), (None, "a b c d e f", None, "s", 0), (2, None, None, "s", 0),
            (None, "", None, "s", 0), (3, "A B C D E F", None, "s", 0)]
    got = sorted(map(tuple, N.near_groups(documents(spark, rows), shingle=4).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (2, 0, 2, True), (None, 0, None, True), (3, 3, 1, False)], key=repr)
    kept = N.drop_near_copies(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 1, 2]
    assert N.near_groups(documents(spark, [])).count() == 0
