"""Defaults of the retrieval and chunking parameters (fixed values of the workload)."""

from dataclasses import dataclass

# Fixed values.
CANDIDATE_TOP_K = 20
FINAL_TOP_K = 5
CONTEXT_TOKENS = 6000
RRF_K = 60
DENSE_WEIGHT = 1.0
LEXICAL_WEIGHT = 1.0
BM25_K1 = 1.5
BM25_B = 0.75
CHUNK_TARGET = 1200
CHUNK_MAX = 1800
CHUNK_OVERLAP = 150
EMBED_BATCH = 32
MAX_FILE_BYTES = 50 * 1024 * 1024
DEFAULT_DOCUMENT_STATUS = "active"
SYNTHETIC = "SYNTHETIC_TEST_DATA"
OFFICIAL = "OFFICIAL_CANDIDATE"


@dataclass(frozen=True)
class Bm25:
    k1: float = BM25_K1
    b: float = BM25_B


@dataclass(frozen=True)
class Chunking:
    target: int = CHUNK_TARGET
    maximum: int = CHUNK_MAX
    overlap: int = CHUNK_OVERLAP
