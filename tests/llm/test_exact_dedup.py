import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from reportlake.llm import exact_dedup
from tests.llm.helpers import documents, from_texts, lower


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.integers(1, 10**6), max_size=80))
def test_filter_round_trip(counts):
    keys = np.array(sorted(counts), np.uint64)
    values = np.array([counts[int(k)] for k in keys], np.int64)
    got = exact_dedup.decode(exact_dedup.encode(keys, values))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == values.tolist()


def test_merge_adds_counts():
    a = (np.array([1, 5, 2**63], np.uint64), np.array([1, 2, 300], np.int64))
    b = (np.array([5, 7], np.uint64), np.array([1, 1], np.int64))
    keys, counts = exact_dedup.merge([a, b])
    assert keys.tolist() == [1, 5, 7, 2**63] and counts.tolist() == [1, 3, 1, 300]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = []
    for i, text in rows:
        ids = groups[lower(text)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups(spark):
    texts = ["Abc", "aBC", "abc ", None, "", "É", "é", "x" * 300_000, "X" * 300_000] + ["Copy of one"] * 40
    rows = [*enumerate(texts), (3, None), (None, "abc"), (None, "only here"), (50, "abc"), (50, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as fp", "2 as norm", "'z' as sha")
    assert sorted(map(tuple, exact_dedup.exact_groups(df).collect()), key=repr) == brute(rows)


def test_empty_and_stage(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    docs = from_texts(spark, ["a", "A", None, "", "b"])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_dropping_tells_rows_of_one_id_apart(spark):
    rows = [(5, "A"), (5, "B"), (9, "a"), (None, "a"), (None, "C"), (None, "c"), (7, None), (8, ""), (3, "D"), (3, "d"), (3, "E"),
            (None, "F"), (2, "É"), (1, "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, (r.text or "").replace("C", "c").replace("D", "d")) for r in exact_dedup.drop_copies(docs).collect()]
    want = [(5, "B"), (9, "a"), (None, "c"), (8, ""), (3, "d"), (3, "E"), (None, "F"), (2, "É"), (1, "é")]
    assert sorted(got, key=str) == sorted(want, key=str)
