"""User-supplied embedders and rerankers, called batch by batch inside the tasks."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reportlake.settings import EMBED_BATCH

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """Deterministic stand-in for a model: the first four bytes of the text's SHA-256, plus one."""
    return [[byte + 1.0 for byte in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def checked(vectors: list[list[float]], expected: int) -> np.ndarray:
    """Vectors as a matrix; refuses wrong counts, unequal or empty vectors and non-finite values."""
    if len(vectors) != expected:
        raise ValueError(f"embedder returned {len(vectors)} vectors for {expected} texts")
    if len({len(v) for v in vectors}) != 1 or not len(vectors[0]):
        raise ValueError("embedding vectors have inconsistent dimensions")
    matrix = np.asarray(vectors, dtype=np.float64)
    if not np.isfinite(matrix).all():
        raise ValueError("embedding vector contains a non-finite value")
    return matrix


def embed(df: DataFrame, column: str, embedder: Embedder, batch: int = EMBED_BATCH,
          normalize: bool = True) -> DataFrame:
    """Add `vector` for a text column; at most `batch` texts go to the embedder at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for start in range(0, len(frame), batch):
                texts = frame[column].iloc[start : start + batch].tolist()
                matrix = checked(embedder(texts), len(texts))
                if normalize:
                    norms = np.sqrt((matrix**2).sum(1, keepdims=True))
                    if not norms.all():
                        raise ValueError("cannot normalize a zero embedding vector")
                    matrix = matrix / norms
                parts.extend(matrix.tolist())
            yield frame.assign(vector=parts)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInPandas(run, f"{fields}, vector array<double>")


def score_pairs(df: DataFrame, query: str, content: str, scorer: Scorer) -> DataFrame:
    """Add `reranker_score` of (query, content) pairs for `search.rerank_by_scores`."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, contents: pd.Series) -> pd.Series:
        scores = scorer(queries.tolist(), contents.tolist())
        if len(scores) != len(queries):
            raise ValueError("reranker returned an invalid score count")
        return pd.Series(scores, dtype="float64")

    return df.withColumn("reranker_score", score(F.col(query), F.col(content)))
