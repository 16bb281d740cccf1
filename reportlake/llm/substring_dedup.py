"""Repeated passages: words covered by a window of consecutive words that also starts earlier.

Every window is filed under a symbol of the recompressed text (see `recompress`). Three shuffles of
packed arrays follow, none of which holds a whole document but the last:

1. symbol keys meet by share of the key space; keys seen twice go back to their documents;
2. only windows under repeated keys are hashed themselves and meet by key; all but the first start
   of each window go back to their documents;
3. documents drop the words those windows cover.

In each batch only the first occurrence of a key or window is sent, so a passage of a third of all
rows sends one entry a batch. A window is named by its symbol's key and its own hash, 128 bits."""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays, recompress, sieve
from reportlake.llm.packed import BLOBS, by_document, dealt, gathered, per_document, shares
from reportlake.llm.work import lean, stored

WINDOW = 20


def _windows(words: arrays.Words, size: int):
    hashes = words.hashes()
    windows = np.flatnonzero(arrays.whole(words.doc, size))
    of, keys = recompress.anchors(hashes, words.first, windows, size)
    return hashes, windows, of, keys


def _keys(parts: int, size: int):
    """Keys of all documents. One that several documents of a slice have is repeated for sure."""

    def run(stream):
        for batch in stream:
            ids = np.asarray(batch.column("id"))
            for first, _, words in arrays.batches(batch):
                _, windows, of, keys = _windows(words, size)
                if not len(keys):
                    continue
                doc = np.zeros(len(keys), np.int64)
                doc[of] = ids[first + words.doc[windows]]
                order = np.argsort(keys, kind="stable")
                keys, doc = keys[order], doc[order]
                head = np.r_[True, keys[1:] != keys[:-1]]
                many = np.add.reduceat(np.ones(len(keys), np.int64), np.flatnonzero(head)) > 1
                repeated = many[np.cumsum(head) - 1]
                yield dealt(shares(keys[head], parts), parts, keys[head], doc[head], many.astype(np.int8))
                own = by_document(parts, doc[repeated], keys[repeated])
                yield own.set_column(0, "part", pa.array(-1 - np.asarray(own.column("part")), pa.int32()))

    return run


def _repeated_keys(parts: int):
    """Negative parts already know their documents and only pass."""

    def run(stream):
        held = []
        for batch in stream:
            known = np.asarray(batch.column("part")) < 0
            if known.any():
                rows = batch.filter(pa.array(known))
                yield rows.set_column(0, "part", pa.array(-1 - np.asarray(rows.column("part")), pa.int32()))
            held.append(batch.filter(pa.array(~known)))
        keys, doc, many = gathered(held, "<u8", "<i8", "i1")
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, doc, many = keys[order], doc[order], many[order]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            count = np.diff(np.append(head, len(keys)))
            # Where a slice had the key more than once, its own documents know already.
            other = np.repeat((count > 1) | (np.maximum.reduceat(many, head) > 0), count) & (many == 0)
            yield by_document(parts, doc[other], keys[other])

    return run


def _candidates(bits):
    def run(stream):
        for batch in stream:
            ids = np.asarray(batch.column("id").fill_null(0))
            pick = sieve.test(bits.value, ids) & np.asarray(batch.column("id").is_valid())
            yield batch.filter(pa.array(pick))

    return run


def _hashed(parts: int, size: int):
    """Windows under repeated keys: (key, window hash, document, start), the first of each in a slice;
    the later ones of a slice are known to be removed (negative parts)."""

    def run(stream):
        for batch in stream:
            ids = np.asarray(batch.column("id"))
            wanted = [np.frombuffer(v, np.uint64) for v in batch.column("v").to_pylist()]
            for first, last, words in arrays.batches(batch):
                hashes, windows, of, keys = _windows(words, size)
                row = words.doc[windows]
                own = np.concatenate([arrays.mix(w ^ np.uint64(k)) for k, w in enumerate(wanted[first:last])] + [np.zeros(0, np.uint64)])
                anchor_row = np.zeros(len(keys), np.uint64)
                anchor_row[of] = row
                hit = np.isin(arrays.mix(keys ^ anchor_row), own)[of]
                start = windows[hit]
                key, doc, at = keys[of[hit]], ids[first + row[hit]], (start - words.first[row[hit]]).astype(np.int64)
                value = arrays.span_hashes(hashes, start, start + size)
                order = np.lexsort((at, doc, value))
                key, value, doc, at = key[order], value[order], doc[order], at[order]
                head = np.r_[True, (value[1:] != value[:-1]) | (key[1:] != key[:-1])][: len(value)]
                lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                later = ~head & ((doc != doc[lead]) | (at != at[lead]))
                yield dealt(shares(key[head], parts), parts, key[head], value[head], doc[head], at[head].astype(np.int32))
                own = by_document(parts, doc[later], at[later].astype(np.int32))
                yield own.set_column(0, "part", pa.array(-1 - np.asarray(own.column("part")), pa.int32()))

    return run


def _later(parts: int):
    """Starts of windows that also start earlier."""

    def run(stream):
        held = []
        for batch in stream:
            known = np.asarray(batch.column("part")) < 0
            if known.any():
                rows = batch.filter(pa.array(known))
                yield rows.set_column(0, "part", pa.array(-1 - np.asarray(rows.column("part")), pa.int32()))
            held.append(batch.filter(pa.array(~known)))
        key, value, doc, at = gathered(held, "<u8", "<u8", "<i8", "<i4")
        if len(key):
            order = np.lexsort((at, doc, key, value))
            key, value, doc, at = key[order], value[order], doc[order], at[order]
            head = np.r_[True, (value[1:] != value[:-1]) | (key[1:] != key[:-1])]
            lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            later = (doc != doc[lead]) | (at != at[lead])
            yield by_document(parts, doc[later], at[later])

    return run


def _digest(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _ready(bits):
    """Rows whose document has nothing to remove are finished; the others keep their text."""

    def run(stream):
        for batch in stream:
            ids = np.asarray(batch.column("id").fill_null(0))
            wait = sieve.test(bits.value, ids) & np.asarray(batch.column("id").is_valid())
            kept, count = [], []
            for text, hold in zip(batch.column("text"), wait):
                words = b"" if hold else text.as_buffer()
                words = words.to_pybytes().split() if words else []
                kept.append(None if hold else b" ".join(words).decode())
                count.append(len(words))
            text = pa.array([t if hold else None for t, hold in zip(batch.column("text").to_pylist(), wait)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), text, pa.array(count, pa.int64()), pa.array(kept, pa.string())], ["id", "text", "n_words", "kept"])

    return run


def _finish(size: int):
    def run(stream):
        for batch in stream:
            n_words, removed, kept = batch.column("n_words").to_pylist(), [], []
            rows = zip(batch.column("text").to_pylist(), batch.column("v").to_pylist(), batch.column("kept").to_pylist())
            for k, (text, starts, done) in enumerate(rows):
                if text is None:
                    removed.append(0)
                    kept.append(done)
                    continue
                words = text.encode().split()
                n_words[k] = len(words)
                at = np.frombuffer(starts or b"", np.int32)
                at = at[at + size <= len(words)]
                change = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
                stay = np.cumsum(change)[: len(words)] == 0
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join(compress(words, stay.tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    return run


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(id, v) of documents (id, text): the starts, as packed int32, of windows that also start in a
    document of smaller id or earlier in the same one."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.where("id is not null").mapInArrow(lean(_keys(parts, size)), BLOBS)
    repeated = named.repartition(parts, "part").mapInArrow(lean(_repeated_keys(parts)), BLOBS)
    wanted = stored(repeated.repartition(parts, "part").mapInArrow(lean(per_document("<u8")), "id bigint, v binary"), "keys")
    bits = spark.sparkContext.broadcast(sieve.build(wanted, "id"))
    texts = docs.mapInArrow(lean(_candidates(bits)), "id bigint, text string").join(wanted, "id")
    hashed = texts.mapInArrow(lean(_hashed(parts, size)), BLOBS)
    later = hashed.repartition(parts, "part").mapInArrow(lean(_later(parts)), BLOBS)
    return stored(later.repartition(parts, "part").mapInArrow(lean(per_document("<i4")), "id bigint, v binary"), "starts")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document: its id, n_words, n_removed, and `kept`: its text without the words that a
    window of `size` words covers which also starts earlier (in a document of smaller id, or earlier
    in the same one). Words are joined by one space.

    Windows are judged on the input. Null and blank texts have no words. A row without id is
    neither compared nor changed. Rows that share an id are versions of one document: in each, words
    at the removed places of any of them go. Other columns are ignored."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    starts = later_windows(source, size)
    bits = spark.sparkContext.broadcast(sieve.build(starts, "id"))
    ready = source.mapInArrow(lean(_ready(bits)), "id bigint, text string, n_words bigint, kept string")
    done = ready.join(starts, "id", "left").mapInArrow(
        lean(_finish(size)), "id bigint, n_words bigint, n_removed bigint, kept string")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
