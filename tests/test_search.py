import math
import random
import re
from collections import Counter
from datetime import date
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reportlake.operators import evaluate, search
from reportlake.operators.search import Filters, SearchMode
from reportlake.plans import search_queries
from tests.compare import compare

CHUNKS = [
    ("c1", "d1", "Nghị định 09/2019/NĐ-CP", "legal", "common", "active",
     "Điều 8 quy định chế độ báo cáo định kỳ.", "09/2019/NĐ-CP", None),
    ("c2", "d2", "Hướng dẫn dân cư", "guideline", "population", "active",
     "Hướng dẫn thống kê dân cư và nhân khẩu.", None, "2025-01-01"),
    ("parent", "d1", "Nghị định 09/2019/NĐ-CP", "legal", "common", "active",
     "Toàn văn Điều 8 gồm các khoản báo cáo.", None, None),
]
SCHEMA = ("chunk_id string, document_id string, document_name string, document_type string, "
          "domain string, document_status string, content string, document_number string, "
          "effective_date string")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_bm25_equals_the_formula(spark, corpus):
    queries = ["09/2019/NĐ-CP Điều 8", "báo cáo báo cáo", "dân cư", "không có gì xyz"]
    rows = search.bm25_search(corpus, ask(spark, *queries), None, 5).collect()
    pattern = re.compile(r"[\wÀ-ỹ]+(?:[./-][\wÀ-ỹ]+)*")
    tokens = lambda s: [t.casefold() for t in pattern.findall(s)]
    bodies = {c[0]: tokens(" ".join(x for x in (c[2], c[7], c[6]) if x)) for c in CHUNKS}
    mean = sum(map(len, bodies.values())) / 3
    df = Counter(t for b in bodies.values() for t in set(b))
    for q, query in enumerate(queries):
        scores = {}
        for name, body in bodies.items():
            tf = Counter(body)
            scores[name] = sum(
                math.log(1 + (3 - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5
                / (tf[t] + 1.5 * (0.25 + 0.75 * len(body) / mean)) for t in tokens(query) if tf[t])
        expected = sorted(((n, s) for n, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))
        got = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in got] == [n for n, _ in expected]
        assert [r["score"] for r in got] == pytest.approx([s for _, s in expected])


def test_filters(spark, corpus):
    hits = lambda f: {r[0] for r in search.apply_filters(corpus, f).select("chunk_id").collect()}
    assert hits(Filters(domain="common")) == {"c1", "parent"}
    assert hits(Filters(effective_on=date(2024, 1, 1))) == {"c1", "parent"}
    assert hits(Filters(document_types=("legal",), document_ids=("d2",))) == set()
    assert hits(Filters(document_number="09/2019/NĐ-CP")) == {"c1"}
    assert Filters.for_request().document_status == "active"
    states = corpus.withColumn("processing_status", F.when(F.col("chunk_id") == "c1", "deleted"))
    assert states.filter(Filters().condition(states)).count() == 2
    assert states.filter(Filters().condition(states, by_processing_status=False)).count() == 3


@pytest.mark.parametrize("distance", search.DISTANCES)
def test_dense_equals_brute_force_with_copies(spark, distance):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8))
    data[100:200] = data[100]  # a third of all rows are copies
    queries = np.vstack([data[100:101], rng.normal(size=(3, 8))])
    corpus = spark.createDataFrame(
        [(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(data)],
        "chunk_id string, vector array<double>").repartition(5)
    asked = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id int, vector array<double>")
    rows = search.dense_search(corpus, asked, k=7, distance=distance).collect()
    for q, query in enumerate(queries):
        if distance == "COSINE":
            scores = data @ query / np.linalg.norm(data, axis=1) / np.linalg.norm(query)
        elif distance == "DOT":
            scores = data @ query
        elif distance == "EUCLID":
            scores = -np.linalg.norm(data - query, axis=1)
        else:
            scores = -np.abs(data - query).sum(1)
        order = sorted(range(300), key=lambda i: (-round(scores[i], 6), i))[:7]
        got = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in got] == [f"c{i:03d}" for i in order]


def ranked(spark, rows):
    return spark.createDataFrame(
        [(0, c, float(s), i) for i, (c, s) in enumerate(rows, 1)],
        "query_id int, chunk_id string, score double, rank int")


def test_fusion(spark):
    dense, lexical = ranked(spark, [("c1", 0.9), ("c2", 0.8)]), ranked(spark, [("c2", 5), ("c3", 4)])
    rows = search.reciprocal_rank_fusion(dense, lexical, 10, 10, 1, 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c2", "c3", "c1"]
    assert (rows[0]["dense_score"], rows[0]["lexical_score"]) == (0.8, 5.0)
    empty = lexical.limit(0)
    assert search.reciprocal_rank_fusion(dense, empty).count() == 2
    assert search.single_list(empty, lexical).count() == 2


def test_rerank(spark, corpus):
    candidates = ranked(spark, [("c2", 1.0), ("c1", 1.0)])
    best = search.rerank_by_overlap(candidates, ask(spark, "Điều 8 báo cáo"), corpus, 1).collect()
    assert [r["chunk_id"] for r in best] == ["c1"]
    scores = spark.createDataFrame([(0, "c1", 0.9), (0, "c2", float("nan"))],
                                   "query_id int, chunk_id string, reranker_score double")
    kept, warnings = search.rerank_by_scores(candidates, scores, 5)
    assert [r["chunk_id"] for r in kept.orderBy("rank").collect()] == ["c2", "c1"]
    assert warnings.count() == 1
    strict, errors = search.rerank_by_scores(candidates, scores, 5, strict=True)
    assert strict.count() == 0 and errors.first()["severity"] == "error"


def test_modes():
    assert SearchMode("auto").resolve() == (True, True, True)
    assert SearchMode("lexical").resolve() == (False, True, False)
    with pytest.raises(ValueError):
        SearchMode("dense", dense=False).resolve()
    with pytest.raises(ValueError):
        SearchMode("hybrid", lexical=False).resolve()


def test_retrieve_pipeline(spark, corpus):
    vectors = corpus.withColumn("vector", F.array(F.lit(1.0), F.length("chunk_id").cast("double")))
    queries = ask(spark, " Điều 8  báo cáo ", "  ").withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    rows = search.retrieve(vectors, queries, Filters.for_request(), final_k=2).collect()
    assert {r["query_id"] for r in rows} == {0}
    assert [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"])] == ["c1", "parent"]


def test_metrics(spark):
    retrieved = spark.createDataFrame([(0, x, i) for i, x in enumerate("axb", 1)],
                                      "query_id int, item string, rank int")
    expected = spark.createDataFrame([(0, "a"), (0, "b"), (1, "z")], "query_id int, item string")
    rows = {r["query_id"]: r for r in evaluate.retrieval_metrics(retrieved, expected, 3).collect()}
    assert rows[0]["hit_rate"] == 1 and rows[0]["recall"] == 1 and rows[0]["mrr"] == 1
    assert rows[0]["precision"] == pytest.approx(2 / 3)
    assert rows[0]["ndcg"] == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert rows[1]["recall"] == 0 and rows[1]["ndcg"] == 0


def test_short_passages_are_found(spark):
    texts = ["alpha beta gamma delta", "xalpha beta, gammas", "", None, "😀é ß two  words\nhere", "aaaa", " alpha"]
    asked = ["alpha beta gamma", "alpha", "pha be", "a", "", " ", "two  words", "ds\nhe", "aaa", "😀é", "é", "gammas and more", None,
             "beta, gammas", " alpha", "alphabetical", "beta gamma", "?", "a b"]
    tables = SimpleNamespace(
        documents=spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"),
        benchmark=spark.createDataFrame(list(enumerate(asked)), "item_id bigint, text string"),
    )
    want = sorted((i, f"{d}-chunk-00000") for i, p in enumerate(asked) for d, x in enumerate(texts) if None not in (p, x) and p in x)
    assert sorted(map(tuple, search_queries.passages_in_documents(tables).collect())) == want
    tables.benchmark = tables.benchmark.where("item_id = 0")
    assert sorted(map(tuple, search_queries.passages_in_documents(tables).collect())) == [(0, "0-chunk-00000")]


@pytest.mark.parametrize("name", ["retrieval_metrics", "mean_retrieval_metrics"])
def test_metrics_of_short_passages_equal_sql(spark, tmp_path, name):
    given = "/root/testdata/sf0.001"
    spark.read.parquet(f"{given}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.read.parquet(f"{given}/benchmark.parquet")
    words = F.split("text", r"\s+")
    short = items.withColumn("text", F.when(F.col("item_id") % 2 == 0, words[1]).otherwise(F.concat_ws(" ", words[1], words[2])))
    items.unionByName(short.withColumn("item_id", F.col("item_id") + 1_000_000)).write.parquet(f"{tmp_path}/benchmark.parquet")
    database = duckdb.connect()
    for table in ("documents", "benchmark"):
        database.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    problems, _ = compare(entry.queries()[name](spark, str(tmp_path)), database, entry.oracle_sql()[name])
    assert not problems, problems


def _texts(spark, n):
    rng = random.Random(n)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(3, 60)) + [f"r{rng.randint(0, 60)}" for _ in range(rng.randint(0, 4))]
        rows.append((f"c{i:04d}", " ".join(words)))
    corpus = spark.createDataFrame(rows + [("empty", ""), ("null", None)], "chunk_id string, content string")
    asked = [(i, " ".join([f"r{i}", *rng.sample(common, 6)])) for i in range(30)] + [(90, "w1 w2"), (91, "unknown"), (92, "w1 w1 w1")]
    return corpus, spark.createDataFrame(asked, "query_id int, query string")


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_bounds_lose_nothing(spark, k):
    corpus, queries = _texts(spark, 700)
    known = search.lexicon(corpus, queries)
    everything = search.score_all(known)
    best = search.rank_by(everything, [F.desc("fixed")], k)
    want = {(r["query_id"], r["chunk_id"], r["fixed"] / search.FIXED, r["rank"]) for r in best.collect()}
    got = search.bm25_search(corpus, queries, k=k, direct=0)
    assert {tuple(r) for r in got.select("query_id", "chunk_id", "score", "rank").collect()} == want
    if k < 10:
        assert search.promising_pairs(known, k).count() < everything.count() / 3


def test_bounds_spare_pairs_on_the_given_tables(spark):
    from reportlake.plans import adapters
    from reportlake.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.01")
    known = search.lexicon(adapters.corpus(t), adapters.queries(t), search.Filters.for_request())
    pairs, all_pairs = search.promising_pairs(known, 5).count(), search.score_all(known).count()
    print("scored pairs", pairs, "of", all_pairs)
    assert pairs < all_pairs / 10


@pytest.mark.parametrize("distance", search.DISTANCES)
def test_dense_tiles_equal_plain_search(spark, distance):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(0, 1, (300, 5)), 1)
    asked = np.round(rng.normal(0, 1, (40, 5)), 1)
    rows = [(i % 290, v.tolist()) for i, v in enumerate(vectors)] + [(900, [1.0, 2.0]), (901, None), (902, []), (903, [float("nan")] * 5), (904, [None] * 5)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)] + [("short", [2.0, 1.0]), ("none", None)], "query_id string, vector array<double>")
    got = search.dense_search(corpus, queries, k=7, distance=distance, query_tile=9, corpus_tile=50).collect()
    want = {}
    for name, q in [(f"q{i}", q) for i, q in enumerate(asked)]:
        if distance == "COSINE":
            s = vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q)
        elif distance == "DOT":
            s = vectors @ q
        elif distance == "EUCLID":
            s = -np.linalg.norm(vectors - q, axis=1)
        else:
            s = -np.abs(vectors - q).sum(1)
        first = sorted(zip(-np.round(s, 12), [i % 290 for i in range(300)]))[:7]
        kept = sorted({c: min(x for x, d in first if d == c) for _, c in first}.items(), key=lambda p: (p[1], p[0]))
        want |= {(name, c): (n + 1, round(-x, 9)) for n, (c, x) in enumerate(kept)}
    got = {(r["query_id"], r["chunk_id"]): (r["rank"], round(r["score"], 9)) for r in got}
    assert got.pop(("short", 900))[0] == 1
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    refused = {r["chunk_id"]: r["issue"] for r in search.refused_vectors(corpus, "chunk_id", distance).collect()}
    assert refused == {901: "missing_vector", 902: "empty_vector", 903: "non_finite_value", 904: "non_finite_value"}


def test_dense_search_of_nothing(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0])], "chunk_id bigint, vector array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vector array<double>")
    assert search.dense_search(corpus, queries).count() == 0
    assert [r["issue"] for r in search.refused_vectors(corpus, "chunk_id").collect()] == ["zero_vector"]
    assert search.dense_search(corpus, queries.limit(0), distance="DOT").count() == 0


def test_dense_search_sends_the_corpus_once_for_a_tile_of_queries_that_fits_a_worker(spark, monkeypatch):
    """The query over all vectors names no tiles of its own, and more queries than a slice stay one tile."""
    asked = {}
    with monkeypatch.context() as m:
        m.setattr(search, "dense_search", lambda *a, **options: asked.update(options) or spark.createDataFrame(
            [], "query_id int, chunk_id int, rank int, score double"))
        entry.queries()["dense_all"](spark, entry.SMALL)
    assert not {"query_tile", "corpus_tile"} & set(asked)
    monkeypatch.setattr(search, "SLICE", 64)
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(9000, 4)), 2).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "chunk_id int, vector array<float>")
    found = search.dense_search(rows, rows.withColumnRenamed("chunk_id", "query_id"), k=3, distance="DOT")
    tasks = re.findall(r"RepartitionByExpression \[tile#\d+\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())
    assert tasks == [str(spark.sparkContext.defaultParallelism)]
    scores = np.round(data.astype(np.float64) @ data.astype(np.float64).T, 12)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in found.collect()}
    want = {(q, n): int(c) for q in range(len(data)) for n, c in enumerate(np.lexsort((np.arange(len(data)), -scores[q]))[:3], 1)}
    assert got == want


def test_bounds_broadcast_nothing_that_grows_with_the_corpus(spark, monkeypatch):
    words = ("a b c", "a b", "a c c", "b c", "a")
    corpus = spark.createDataFrame([(f"c{n}", words[n % 5]) for n in range(40)], "chunk_id string, content string")
    queries = spark.createDataFrame([(0, "a b"), (1, "c a")], "query_id int, query string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    known, written, write = search.lexicon(corpus, queries), [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, even=True: written.append(plan(df)) or write(df, even))
    pairs = search.promising_pairs(known, 2)
    for text in (written[-1], plan(pairs)):
        assert "SortMergeJoin" in text and "Broadcast" not in text
    # The weights of the queries may be sent, the pairs may not.
    assert "SortMergeJoin [chunk_id" in plan(search.score_pairs(known, pairs))
