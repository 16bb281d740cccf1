"""Whole Arrow batches of text as numpy arrays: words, hashes and n-grams without a loop per row.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are 64 bits wide and the same in
every task. Batches are cut into slices of whole documents, so memory depends on the slice and on
the longest single document only."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C13)
STEP = U64(0xD1342543DE82EF95)

_rng = np.random.Generator(np.random.PCG64(20))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, one to one on 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, made longer on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        # Functions take this along to the workers; the 32 MB of powers are made anew there.
        return type(self), (self.base,)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                row = np.full(size, factor, np.uint64)
                row[0] = 1
                setattr(self, name, np.cumprod(row))
        return self.up[:n], self.down[:n]


_powers = Powers(BASE)


def placed_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for spans of any length that do not overlap: the sum of a mixed value of
    every code and its place in the span, so that no pattern of codes cancels out."""
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = ragged(starts, lengths)
    place = (at - np.repeat(starts, lengths)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes[at] + place * STEP))])
    edges = np.cumsum(lengths)
    return mix(total[edges] - total[edges - lengths] + lengths.astype(np.uint64) * STEP)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number in their order; zero bytes follow the text."""
    out = text.astype(np.uint64)
    for width in (1, 2, 4):
        after = np.zeros_like(out)
        after[:-width] = out[width:]
        out = (out << np.uint64(8 * width)) | after
    return out


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for short spans, which may overlap. It is a polynomial in the codes: for long
    spans of few codes use `placed_hashes`."""
    up, down = _powers.get(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + lengths * STEP)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document stands alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


class Words:
    """Words of consecutive documents: `start`, `end` (bytes), `doc`, and `first` word per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> None:
        self.data, self.offsets = data, offsets
        inside = ~outside[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        edge = np.empty(len(data), bool)
        edge[:1] = True
        edge[1:] = ~inside[:-1]
        edge |= cut[:-1]
        self.start = np.flatnonzero(inside & edge)
        edge[-1:] = True
        edge[:-1] = ~inside[1:]
        edge |= cut[1:]
        self.end = np.flatnonzero(inside & edge) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return placed_hashes((LOWER_CODE if lower else BYTE_CODE)[self.data], self.start, self.end)


def ngrams(items: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive items (also across documents), by doubling."""
    if len(items) < n:
        return np.zeros(0, np.uint64)
    have, size, done, out = items, 1, 0, None
    factor = STEP
    while True:
        if n & size:
            part = have[done:done + len(items) - n + 1]
            out = part.copy() if out is None else out * factor + part
            done += size
        if done == n:
            return mix(out + U64(n))
        have = have[:-size] * factor + have[size:]
        size, factor = 2 * size, U64(int(factor) ** 2 % (1 << 64))


def whole(doc: np.ndarray, n: int) -> np.ndarray:
    """True where n items from here on belong to one document."""
    return doc[: len(doc) - n + 1] == doc[n - 1:] if len(doc) >= n else np.zeros(0, bool)


def shingle_sets(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (n words; of fewer words, the whole sequence) of every document,
    one after another, and the offsets of the documents."""
    keep = whole(words.doc, n)
    doc, value = words.doc[: len(keep)][keep], ngrams(hashes, n)[keep]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(1, n):
            of = words.count[short] == k
            if of.any():
                at = words.first[short[of]]
                extra[of] = ngrams(hashes, k)[at]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(words.count) + 1))


def batches(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for each slice of a batch."""
    data, offsets = string_buffer(batch.column(name))
    for a, b in slices(offsets):
        yield a, b, Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every range, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per range of `values`."""
    ends = (offsets * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]
    )
