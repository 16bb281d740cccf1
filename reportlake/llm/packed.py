"""Packed arrays in rows: what a batch sends to one share of the keys is one row."""

import numpy as np
import pyarrow as pa

from reportlake.llm import arrays

LOW32 = np.uint64(0xFFFFFFFF)
BLOBS = "part int, a binary, b binary, c binary, d binary"


def shares(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys & LOW32) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def dealt(share: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per share with its rows of every column, packed."""
    order = np.argsort(share, kind="stable")
    edges = np.searchsorted(share[order], np.arange(parts + 1))
    rows = [k for k in range(parts) if edges[k] < edges[k + 1]]
    packed = [pa.array([c[order[edges[k]:edges[k + 1]]].tobytes() for k in rows], pa.binary()) for c in columns]
    packed += [pa.array([b""] * len(rows), pa.binary())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *packed], ["part", "a", "b", "c", "d"])


def gathered(stream, *types: str) -> list[np.ndarray]:
    held = [[np.zeros(0, t)] for t in types]
    for batch in stream:
        for into, name, kind in zip(held, "abcd", types):
            into += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist()]
    return [np.concatenate(x) for x in held]


def by_document(parts: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return dealt(shares(arrays.mix(ids.view(np.uint64)), parts), parts, ids, values)


def per_document(kind: str):
    def run(stream):
        ids, values = gathered(stream, "<i8", kind)
        order = np.lexsort((values, ids))
        ids, values = ids[order], values[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
        ids, values = ids[new], values[new]
        head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[head]), arrays.binary_rows(values, np.append(head, len(ids)))], ["id", "v"])

    return run
