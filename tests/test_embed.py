import pytest
from pyspark.errors import PythonException

from reportlake.operators import embed, search


def test_batches_and_vectors(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(70)], "chunk_id int, body string").coalesce(1)

    def embedder(texts):
        assert len(texts) <= 32
        return [[3.0, 4.0] for _ in texts]

    rows = embed.embed(df, "body", embedder).collect()
    assert len(rows) == 70 and rows[0]["vector"] == [0.6, 0.8]


@pytest.mark.parametrize(
    "embedder",
    [lambda t: [], lambda t: [[1.0]] * (len(t) - 1) + [[1.0, 2.0]], lambda t: [[float("nan")]] * len(t),
     lambda t: [[0.0]] * len(t), lambda t: [[]] * len(t)])
def test_bad_vectors_are_refused(spark, embedder):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_id int, body string").coalesce(1)
    with pytest.raises(PythonException):
        embed.embed(df, "body", embedder).collect()


def test_search_with_the_stand_in(spark):
    df = spark.createDataFrame([("c1", "x"), ("c2", "y")], "chunk_id string, body string")
    corpus = embed.embed(df, "body", embed.hash_embedder)
    asked = embed.embed(spark.createDataFrame([(0, "y")], "query_id int, query string"), "query", embed.hash_embedder)
    best = search.dense_search(corpus, asked, k=1).first()
    assert best["chunk_id"] == "c2" and best["score"] == pytest.approx(1.0)
