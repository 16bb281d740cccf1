import hashlib

import numpy as np
import pytest

from reportlake.llm import centroids as C

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, dims, k=8, rounds=10, seed=3):
    kept = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centers = [r[1] for r in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j])) if j in groups else c for j, c in enumerate(centers)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    of = [sum(d for _, j, d in out if j == c) for c in range(len(centers))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, of[j], sum(of), sha[j]) for i, j, d in out), key=repr)


def run(spark, rows, dims, **more):
    table = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id bigint, embedding array<double>, label int, v string, id string")
    return sorted((tuple(r) for r in C.cluster(table, dims=dims, **more).select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_equals_brute_force(spark, leading):
    rng = np.random.default_rng(leading)
    centers = rng.normal(0, 2, (5, 6))
    rows = [(i, (centers[i % 5] + rng.normal(0, 0.3, 6)).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)]  # one vector many times
    rows += [(7, rows[7][1]), (None, [1.0] * 6), (600, None), (601, []), (602, [1.0] * 5), (603, [1.0] * 7)]
    rows += [(604, [1.0] * 5 + [None]), (605, [1.0] * 5 + [float("nan")]), (606, [1.0] * 5 + [float("inf")]), (607, [-0.0] * 6)]
    assert run(spark, rows, 6, leading=leading) == brute(rows, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(a, b) for a in range(4) for b in range(4)] * 3)]
    assert run(spark, rows, 2, leading=1) == brute(rows, 2)


def test_few_vectors_empty_tables_and_large_components(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert run(spark, rows, 2, leading=1) == brute(rows, 2)
    assert run(spark, [], 2, leading=1) == []
    assert run(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], 2, leading=1) == brute([(2, [0.0, 0.0])], 2)
    rows = [(i, [100_000.0 + i * 0.001, -99_999.0 + (i % 7)]) for i in range(60)]
    assert run(spark, rows, 2, leading=1) == brute(rows, 2)


def test_the_bound_holds_and_filters():
    rng = np.random.default_rng(5)
    groups = rng.normal(0, 1, (8, 64)) * np.linspace(900, 5, 64)
    x = np.floor(groups[rng.integers(0, 8, 4000)] + rng.normal(0, 100, (4000, 64)) + 3000).astype(np.int64)
    centers = np.floor(groups + 3000).astype(np.int64)
    mean = x.mean(0)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    lead, rest = C.rotate(x.astype(float), mean, axes, 16)
    center_lead, center_rest = C.rotate(centers.astype(float), mean, axes, 16)
    exact = ((x[:, None] - centers) ** 2).sum(2)
    assert (C.bounds(lead, rest, center_lead, center_rest, mean) <= exact).all()
    best, distance, verified = C.nearest(x, lead, rest, centers, center_lead, center_rest, mean)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert verified < 2 * len(x)
