"""Exact duplicates by counting quotient filters.

Every batch of documents becomes a counting quotient filter of 64-bit fingerprints: the high bits
(quotient) choose a home position, the low bits (remainder) are stored sorted within the run of
their quotient, and every slot has a count. Filters of the same share of the fingerprints merge
without loss by merging their sorted remainders. Only documents whose fingerprint counts above one
are compared byte by byte, by grouping their normalised texts."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays, sieve
from reportlake.llm.work import lean, settled, stored

LOAD = 0.75


def encode(fingerprints: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter of sorted distinct fingerprints. Layout: n, quotient bits, bytes per remainder, number
    of large counts; occupied bits by quotient; run-end bits by slot; remainders; counts of one
    byte, where 255 means a large count, listed at the end."""
    n = len(fingerprints)
    q = max(3, int(np.ceil(np.log2(max(n, 1) / LOAD))))
    width = (64 - q + 7) // 8
    quotient = (fingerprints >> np.uint64(64 - q)).astype(np.int64)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    run_end = np.ones(n, bool)
    run_end[:-1] = quotient[1:] != quotient[:-1]
    remainder = fingerprints & np.uint64((1 << (64 - q)) - 1)
    slots = remainder.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[small == 255].astype("<i8")
    return b"".join([
        struct.pack("<IBBI", n, q, width, len(large)), np.packbits(occupied).tobytes(),
        np.packbits(run_end).tobytes(), slots.tobytes(), small.tobytes(), large.tobytes(),
    ])


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and their counts."""
    n, q, width, n_large = struct.unpack_from("<IBBI", blob)
    at = struct.calcsize("<IBBI")
    raw = np.frombuffer(blob, np.uint8)
    home = np.flatnonzero(np.unpackbits(raw[at:at + (1 << q) // 8]))
    at += (1 << q) // 8
    run_end = np.unpackbits(raw[at:at + (n + 7) // 8])[:n].astype(np.int64)
    at += (n + 7) // 8
    slots = np.zeros((n, 8), np.uint8)
    slots[:, :width] = raw[at:at + n * width].reshape(n, width)
    at += n * width
    counts = raw[at:at + n].astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<i8", n_large, at + n)
    run = np.cumsum(run_end) - run_end
    quotient = home[run].astype(np.uint64) if n else np.zeros(0, np.uint64)
    return (quotient << np.uint64(64 - q)) | slots.view("<u8").ravel(), counts


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Union of filters: equal fingerprints add their counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _normalised(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = arrays.string_buffer(batch.column("text"))
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data), offsets


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(data))
    return [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _fingerprint(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def _digest_rows(stream):
    for batch in stream:
        digests = _digests(*_normalised(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(_fingerprint(digests)), pa.array([d.hex() for d in digests], pa.string())],
            ["id", "fp", "sha"],
        )


def _filters(parts: int):
    def run(stream):
        for batch in stream:
            keys = np.sort(np.asarray(batch.column("fp")).view(np.uint64))
            keys, counts = merge([(keys, np.ones(len(keys), np.int64))])
            share = (keys & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)
            order = np.argsort(share, kind="stable")
            edges = np.searchsorted(share[order], np.arange(parts + 1))
            blobs = {
                k: encode(keys[pick], counts[pick]) for k in range(parts)
                if edges[k] < edges[k + 1] for pick in [np.sort(order[edges[k]:edges[k + 1]])]
            }
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(blobs), pa.int32()), pa.array(list(blobs.values()), pa.binary())], ["part", "filter"]
            )

    return run


def _merged(stream):
    held: dict[int, list] = {}
    for batch in stream:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("filter").to_pylist()):
            runs = held.setdefault(part, [])
            runs.append(decode(blob))
            while len(runs) > 1 and len(runs[-1][0]) * 2 >= len(runs[-2][0]):
                runs[-2:] = [merge(runs[-2:])]
    for part, runs in held.items():
        blob = encode(*merge(runs))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "filter"]
        )


def _repeated(stream):
    for batch in stream:
        for blob in batch.column("filter").to_pylist():
            keys, counts = decode(blob)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["fp", "n"]
            )


def _passing(bits):
    def run(stream):
        for batch in stream:
            data, offsets = _normalised(batch)
            digests = _digests(data, offsets)
            fp = _fingerprint(digests)
            pick = np.flatnonzero(sieve.test(bits.value, fp))
            view = memoryview(np.ascontiguousarray(data))
            texts = [str(view[offsets[i]:offsets[i + 1]], "utf-8") for i in pick]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(pick)), pa.array(fp[pick]),
                 pa.array([digests[i].hex() for i in pick], pa.string()), pa.array(texts, pa.string())],
                ["id", "fp", "sha", "norm"],
            )

    return run


def counting_filter(fingerprints: DataFrame, parts: int | None = None) -> DataFrame:
    """Merged filters (part, filter) of a bigint column `fp`; the parts share the fingerprints out."""
    parts = parts or int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    built = fingerprints.select("fp").mapInArrow(lean(_filters(parts)), "part int, filter binary")
    return built.repartition(parts, "part").mapInArrow(lean(_merged), "part int, filter binary")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, keep_id (largest id of the documents with an equal text),
    group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Rows that share id
    and text stay or go together; each counts. A null id is kept only where no equal text has an id.
    An empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    digests = stored(source.mapInArrow(lean(_digest_rows), "id bigint, fp bigint, sha string"), "digests")
    repeated = stored(counting_filter(digests).mapInArrow(lean(_repeated), "fp bigint, n bigint"), "repeated")
    bits = spark.sparkContext.broadcast(sieve.build(repeated, "fp"))
    suspects = source.mapInArrow(lean(_passing(bits)), "id bigint, fp bigint, sha string, norm string").join(
        repeated.select("fp"), "fp", "left_semi"
    )
    groups = suspects.groupBy("fp", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    members = suspects.join(groups, ["fp", "norm"]).select("id", "keep_id", "group_size", "sha")
    alone = digests.join(repeated, "fp", "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha"
    )
    return members.unionAll(alone).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, that of the largest id, with all its columns.

    Rows are told apart by id and text: of rows that share an id, only the copies go. Rows without id
    go where an equal text has one; of equal rows of the same id, or of none, any one stays."""
    def copies():
        found = exact_groups(docs, id_col, text_col).where("group_size > 1")
        rows = found.groupBy(id_col, F.col("text_sha256").alias("mark"), "kept").agg(F.count(F.lit(1)).alias("n"))
        return rows.where("not kept or n > 1").select(id_col, "mark", "kept")

    listed = settled(docs.sparkSession, copies, "copies")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mark = F.sha2(F.translate(F.coalesce(text_col, F.lit("")), upper, upper.lower()), 256)
    left = sieve.without(docs, listed.where("not kept"), id_col, mark)
    repeated = listed.where("kept")
    if repeated.take(1):
        left, same = sieve.split(left, repeated, id_col, mark)
        left = left.unionAll(same.withColumn("__mark", mark).dropDuplicates([id_col, "__mark"]).select(*docs.columns))
    return left
