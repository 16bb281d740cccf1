"""Removal of long byte strings that stand more than once, by blockwise suffix sorting.

Equal strings of `size` bytes have the same least hash among their inner grams, so every window of `size`
bytes is filed under that gram (its anchor); consecutive windows with one anchor form a fragment.

1. Grams of all anchors are counted; a window whose anchor's gram stands once is unique.
2. The other fragments are written with their bytes, once per slice of text and content. A content that
   stands twice is repeated as a whole and needs no sorting.
3. Fragments under a gram with several contents meet by gram. A task takes blocks of whole grams and sorts
   the suffixes of a block bucket by bucket with a difference cover (see `suffixes`); neighbours that share
   `size` bytes are repeated. Grams with very many contents are not gathered: their contents are cut into
   parts filed under all bytes that the windows of a part share, and treated in the same way; what is
   common even then is summed window by window by digest.
4. Places of repeated windows go back to the texts. Equal texts share one name, so what is sent back
   grows with distinct texts.

Grams are only told apart by a 64-bit hash, which may file more together than needed; contents, texts and
windows are named by 128-bit BLAKE2 digests, and windows of a block are compared by their bytes."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays, sieve, suffixes
from reportlake.llm.work import lean, small_batches, stored

SIZE = 200
GRAM = 64
#: A text is read in pieces of so many windows, whatever its length; short texts share a piece.
PIECE = 1 << 20
#: Bytes of fragments that are sorted together; one gram's fragments are never split.
BLOCK = 2 << 20
#: Contents of a gram that are sorted in one task.
GATHERED = 512
#: Windows of a part into which contents of more common grams are cut.
PART = 8
NAME = 16
RUNS = "array<struct<low: int, high: int>>"
SPANS = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
LOW = np.uint64((1 << 24) - 1)


def name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NAME).digest()


def short(names: list[bytes]) -> np.ndarray:
    """The first eight bytes of some names as keys of a filter."""
    return np.frombuffer(b"".join(n[:8] for n in names), np.int64)


def keyed(rows: DataFrame, column: str) -> DataFrame:
    """The filter keys of a column of names."""

    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array(short(batch.column(0).to_pylist()))], ["key"])

    return rows.select(column).mapInArrow(lean(run), "key bigint")


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    square = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    square[:len(x)] = x
    square = square.reshape(rows, width)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def fragments(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """Runs of windows with one anchor in consecutive texts: first window, last window, hash of the gram."""
    at = np.arange(max(len(data) - gram + 1, 0))
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none
    keys = arrays.ngrams(arrays.BYTE_CODE[data], gram)
    least = sliding_minimum((keys & ~LOW) | at.astype(np.uint64), size - gram + 1)
    whole = np.ones(len(least) + size, bool)
    for end in offsets[1:-1]:  # windows that begin shortly before the end of a text reach into the next
        whole[max(end - size + 1, 0):end] = False
    windows = np.flatnonzero(whole[:len(least)])
    if not len(windows):
        return none, none, none
    anchor = (least[windows] & LOW).astype(np.int64)
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return windows[new], windows[np.append(new[1:], len(windows)) - 1], keys[anchor[new]].view(np.int64)


def thin(stream, column: str = "text"):
    """The rows of the batches in slices of about PIECE bytes of a column."""
    for batch in stream:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        for first, last in arrays.slices(np.concatenate([[0], np.cumsum(np.asarray(size), dtype=np.int64)]), PIECE):
            yield batch.slice(first, last - first)


def parts(batch: pa.RecordBatch, size: int):
    """Slices of a batch: (first row, bytes, offsets, place of the first byte in its text). A very long
    text comes in pieces whose windows do not overlap."""
    data, offsets = arrays.string_buffer(batch.column("text"))
    for first, last in arrays.slices(offsets, PIECE):
        start, end = int(offsets[first]), int(offsets[last])
        if end - start <= PIECE + size:
            yield first, data[start:end], offsets[first:last + 1] - start, 0
        else:
            for low in range(start, end - size + 1, PIECE):
                piece = data[low:min(low + PIECE + size - 1, end)]
                yield first, piece, np.array([0, len(piece)]), low - start


def _grams(size: int, gram: int):
    """Grams of anchors and how often a slice has them (at most twice is told)."""

    def run(stream):
        for batch in stream:
            for _, data, offsets, _ in parts(batch, size):
                keys, count = np.unique(fragments(data, offsets, size, gram)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.minimum(count, 2))], ["gram", "n"])

    return run


CONTENTS = "gram bigint, content binary, n bigint, windows int, bytes binary, owner binary, first bigint"


def _contents(size: int, gram: int, bits):
    """Fragments under repeated grams, a row for each place: gram, content (its name), windows, owner (the
    name of the text) and first window. Once per content and slice come its bytes and `n`, how often
    the slice has it."""

    def run(stream):
        for batch in stream:
            texts: dict[int, bytes] = {}
            for first, data, offsets, base in parts(batch, size):
                low, high, keys = fragments(data, offsets, size, gram)
                pick = np.flatnonzero(sieve.test(bits.value, keys))
                row = np.searchsorted(offsets, low[pick], "right") - 1
                whole, names, count, places = data.tobytes(), {}, {}, {}
                for a, b, key, r in zip(low[pick].tolist(), high[pick].tolist(), keys[pick].tolist(), row.tolist()):
                    if first + r not in texts:
                        texts[first + r] = name(batch.column("text")[first + r].as_buffer())
                    content = whole[a:b + size]
                    if content not in names:
                        names[content] = name(content)
                    count[content] = count.get(content, 0) + 1
                    # Equal texts share their places.
                    places[content, texts[first + r], a - int(offsets[r]) + base] = key
                told = set()
                new = [not (c in told or told.add(c)) for c, _, _ in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(places.values()), pa.int64()), pa.array([names[c] for c, _, _ in places], pa.binary()),
                     pa.array([count[c] if f else 0 for f, (c, _, _) in zip(new, places)], pa.int64()),
                     pa.array([len(c) - size + 1 for c, _, _ in places], pa.int32()),
                     pa.array([c if f else None for f, (c, _, _) in zip(new, places)], pa.binary()),
                     pa.array([o for _, o, _ in places], pa.binary()), pa.array([p for _, _, p in places], pa.int64())],
                    ["gram", "content", "n", "windows", "bytes", "owner", "first"])

    return run


def _passing(*tests):
    """Rows whose gram is in the first filter and not in the second, if there is one."""

    def run(stream):
        for batch in stream:
            grams = np.asarray(batch.column("gram"))
            keep = np.ones(len(grams), bool)
            for bits, wanted in tests:
                keep &= sieve.test(bits.value, grams) == wanted
            yield batch.filter(pa.array(keep))

    return run


def _sort_block(contents: dict[bytes, bytes], size: int):
    """Repeated windows of some contents: (content, runs of places)."""
    names, texts = list(contents), list(contents.values())
    length = np.array([len(t) for t in texts])
    start = np.cumsum(length) - length
    text = np.frombuffer(b"".join(texts), np.uint8)
    at = arrays.ragged(start, length - size + 1)
    found = suffixes.repeated(text, at, size)
    row = np.searchsorted(start, found, "right") - 1
    new = np.r_[True, (np.diff(found) != 1) | (row[1:] != row[:-1])][:len(found)]
    low = (found - start[row]).astype(np.int32)
    head = np.flatnonzero(new)
    high = low[np.append(head[1:], len(found))[:len(head)] - 1] + np.int32(1)
    hit, first = np.unique(row[head], return_index=True)
    runs = pa.StructArray.from_arrays([pa.array(low[head]), pa.array(high)], ["low", "high"])
    return pa.RecordBatch.from_arrays(
        [pa.array([names[k] for k in hit.tolist()], pa.binary()),
         pa.ListArray.from_arrays(pa.array(np.append(first, len(head)), pa.int32()), runs)], ["content", "runs"])


def _sorted_blocks(size: int, block: int):
    """Rows come sorted by gram. Grams with one content have nothing to compare."""

    def run(stream):
        pending: dict[bytes, bytes] = {}
        group: dict[bytes, bytes] = {}
        gram, held = None, 0
        for batch in stream:
            for key, content, text in zip(*(batch.column(c).to_pylist() for c in ("gram", "content", "bytes"))):
                if key != gram:
                    if len(group) > 1:
                        pending |= group
                        held += sum(map(len, group.values()))
                    group, gram = {}, key
                    if held > block:
                        yield _sort_block(pending, size)
                        pending, held = {}, 0
                group[content] = text
        if len(group) > 1:
            pending |= group
        if pending:
            yield _sort_block(pending, size)

    return run


def _windows(size: int):
    """Windows of contents: (window, n, content as two numbers, place). Equal windows of a few contents come
    once, with their sum and any one of their contents and places."""

    def run(stream):
        for batch in stream:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                count, origin = {}, {}
                for content, n, text in zip(*(part.column(c).to_pylist() for c in ("content", "n", "bytes"))):
                    high, low = struct.unpack(">qq", content)
                    for place in range(len(text) - size + 1):
                        window = name(text[place:place + size])
                        count[window] = count.get(window, 0) + n
                        origin[window] = high, low, place
                high, low, place = zip(*origin.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64()), pa.array(high, pa.int64()),
                     pa.array(low, pa.int64()), pa.array(place, pa.int32())], ["window", "n", "high", "low", "place"])

    return run


def _one_by_one(hot: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(content, runs) of repeated windows of contents too many to gather. `known` has (content, windows) of
    the same contents.

    A window that stands once belongs to one place of one content, so that sums by window tell all unique
    places without a join; repeated are the ranges between them. A content has at most size - gram + 1."""
    counted = hot.mapInArrow(lean(_windows(size)), "window binary, n bigint, high bigint, low bigint, place int")
    once = counted.groupBy("window").agg(
        F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("high", "low", "place"))).where("n = 1")
    content = F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("high", "low"))))
    rows = known.select("content", "windows", F.lit(None).cast("int").alias("place")).unionAll(
        once.select(content.alias("content"), F.lit(None).cast("int").alias("windows"), "place"))
    unique = rows.groupBy("content").agg(F.max("windows").alias("windows"), F.sort_array(F.collect_set("place")).alias("u"))
    between = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("u", lambda p: p + 1)).alias("low"),
                           F.concat("u", F.array("windows")).alias("high"))
    runs = F.filter(between, lambda r: r["low"] < r["high"]).cast(RUNS)
    return unique.select("content", runs.alias("runs")).where(F.size("runs") > 0)


def _cut(size: int, gram: int):
    """Contents cut into parts of up to PART windows that hold the gram at like places: rows as in CONTENTS,
    where `owner` is the content and `gram` names the bytes that all windows of such a part share."""

    def run(stream):
        for batch in stream:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows, count, told = {}, {}, set()
                for content, n, text in zip(*(part.column(c).to_pylist() for c in ("content", "n", "bytes"))):
                    keys = arrays.ngrams(arrays.BYTE_CODE[np.frombuffer(text[:size], np.uint8)], gram)
                    anchor, last = int(np.argmin(keys & ~LOW)), len(text) - size
                    for least in range((anchor - min(last, anchor)) // PART * PART, anchor + 1, PART):
                        most = min(least + PART - 1, size - gram)
                        low, high = max(0, anchor - most), min(last, anchor - least)
                        piece = text[low:high + size]
                        count[piece] = count.get(piece, 0) + n
                        rows[piece, content, low] = text[anchor - least:anchor - most + size]
                new = [not (p in told or told.add(p)) for p, _, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(short([name(c) for c in rows.values()])), pa.array([name(p) for p, _, _ in rows], pa.binary()),
                     pa.array([count[p] if f else 0 for f, (p, _, _) in zip(new, rows)], pa.int64()),
                     pa.array([len(p) - size + 1 for p, _, _ in rows], pa.int32()),
                     pa.array([p if f else None for f, (p, _, _) in zip(new, rows)], pa.binary()),
                     pa.array([o for _, o, _ in rows], pa.binary()), pa.array([f for _, _, f in rows], pa.int64())],
                    ["gram", "content", "n", "windows", "bytes", "owner", "first"])

    return run


def _status(found: DataFrame, size: int, gram: int, gathered: int, whole_grams: bool) -> DataFrame:
    """(content, runs) of contents with repeated windows: ranges of places, or null where all of them are.
    Contents of grams too common to gather are cut into parts once, then taken window by window."""
    spark = found.sparkSession
    contents = found.where("n > 0")
    counted = stored(contents.groupBy("gram", "content").agg(F.sum("n").alias("n")), "counted")
    several = stored(counted.groupBy("gram").agg(F.count("*").alias("contents")).where("contents > 1"), "several")
    mixed = spark.sparkContext.broadcast(sieve.build(several, "gram"))
    many = spark.sparkContext.broadcast(sieve.build(several.where(F.col("contents") > gathered), "gram"))

    few = contents.select("gram", "content", "bytes").mapInArrow(
        lean(_passing((mixed, True), (many, False))), "gram bigint, content binary, bytes binary")
    part = few.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        lean(_sorted_blocks(size, BLOCK)), f"content binary, runs {RUNS}")
    hot = contents.select("gram", "content", "n", "bytes").mapInArrow(
        lean(_passing((many, True))), "gram bigint, content binary, n bigint, bytes binary")
    if whole_grams:
        cut = stored(hot.mapInArrow(lean(_cut(size, gram)), CONTENTS), "parts")
        again = _placed(cut, _status(cut, size, gram, gathered, False)).select(
            "owner", F.struct(F.col("run.low").cast("int").alias("low"), F.col("run.high").cast("int").alias("high")).alias("run"))
        again = again.groupBy(F.col("owner").alias("content")).agg(F.collect_set("run").cast(RUNS).alias("runs"))
    else:
        known = contents.select("gram", "content", "windows").mapInArrow(
            lean(_passing((many, True))), "gram bigint, content binary, windows int")
        again = _one_by_one(hot, known, size)
    whole = counted.where("n > 1").select("content", F.lit(None).cast(RUNS).alias("runs"), F.lit(True).alias("all"))
    places = stored(part.unionAll(again), "places").withColumn("all", F.lit(False))
    # One row a content: those repeated as a whole have no runs, and all others stand in one place only.
    status = whole.unionAll(places).groupBy("content").agg(
        F.max("all").alias("all"), F.first("runs", ignorenulls=True).alias("runs"))
    # Written, so that the join with the places is a stage of its own, whose common contents can be split.
    return stored(status.select("content", F.when(~F.col("all"), F.col("runs")).alias("runs")), "status")


def _placed(found: DataFrame, status: DataFrame) -> DataFrame:
    """(owner, run): ranges of repeated windows, by their places in the owner."""
    every = F.array(F.struct(F.lit(0).alias("low"), F.col("windows").alias("high"))).cast(RUNS)
    marks = found.select("content", "windows", "owner", "first").join(status, "content").select(
        "owner", "first", F.explode(F.coalesce("runs", every)).alias("r"))
    return marks.select("owner", F.struct((F.col("first") + F.col("r.low")).alias("low"), (F.col("first") + F.col("r.high")).alias("high")).alias("run"))


def _covered(size: int):
    """Ranges of windows of an owner as the maximal ranges of bytes that they cover."""

    def run(stream):
        for batch in stream:
            out = []
            for own in batch.column("runs").to_pylist():
                spans: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"] - 1 + size) for r in own):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                out.append([{"low": low, "high": high} for low, high in spans])
            yield pa.RecordBatch.from_arrays([batch.column("owner"), pa.array(out, SPANS)], ["owner", "spans"])

    return run


def repeated_spans(docs: DataFrame, size: int = SIZE, gram: int = GRAM, gathered: int = GATHERED) -> DataFrame:
    """(owner, spans) of texts (column text) with repeated strings: the name of the text, and the maximal
    ranges low up to high of bytes covered by strings of `size` bytes that also start anywhere else. A
    text of which there are several rows is repeated as a whole."""
    spark = docs.sparkSession
    gram = min(gram, size)
    filed = docs.mapInArrow(lean(_grams(size, gram)), "gram bigint, n bigint")
    twice = stored(filed.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    bits = spark.sparkContext.broadcast(sieve.build(twice, "gram"))
    found = stored(docs.mapInArrow(lean(_contents(size, gram, bits)), CONTENTS), "contents")
    placed = _placed(found, _status(found, size, gram, gathered, True))
    runs = placed.repartition("owner").groupBy("owner").agg(F.collect_list("run").alias("runs"))
    # Merged here, once a text, not for every copy of it.
    return stored(runs.mapInArrow(lean(_covered(size)), "owner binary, spans array<struct<low: bigint, high: bigint>>"), "spans")


def _owned(batch: pa.RecordBatch, bits, hit: bool) -> pa.RecordBatch:
    owner = [name(t.as_buffer()) if t.is_valid else name(b"") for t in batch.column("text")]
    keep = pa.array(sieve.test(bits.value, short(owner)) == hit)
    return batch.append_column("owner", pa.array(owner, pa.binary())).filter(keep)


def _named(bits):
    """Rows whose text's name the filter holds, with that name."""

    def run(stream):
        for batch in thin(stream):
            yield _owned(batch, bits, True)

    return run


def _without(batch: pa.RecordBatch, spans_of: list) -> pa.RecordBatch:
    n_bytes, removed, spans, kept = [], [], [], []
    for text, own in zip(batch.column("text"), spans_of):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        out, end, gone = [], 0, 0
        for r in own or ():
            out.append(data[end:r["low"]])
            end = r["high"]
            gone += end - r["low"]
        out.append(data[end:])
        n_bytes.append(len(data))
        removed.append(gone)
        spans.append(len(own or ()))
        kept.append(b"".join(out))
    return pa.RecordBatch.from_arrays(
        [batch.column("__id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
        ["__id", "n_bytes", "n_removed", "n_spans", "kept"])


def _untouched(bits):
    """Rows whose text's name the filter does not hold, finished."""

    def run(stream):
        for batch in thin(stream):
            clean = _owned(batch, bits, False)
            yield _without(clean, [None] * clean.num_rows)

    return run


def _finish():
    def run(stream):
        for batch in thin(stream):
            yield _without(batch, batch.column("spans").to_pylist())

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM,
                 gathered: int = GATHERED) -> DataFrame:
    """One row per row of `docs`: its id, n_bytes, n_removed, n_spans (maximal removed runs) and `kept`: the
    UTF-8 bytes of its text without every byte that a string of `size` bytes covers which also starts
    anywhere else, in this document or another. A cut may fall inside a character, so `kept` is binary.

    Strings are judged on the input. A null text is empty. Every row is a document of its own, also where
    ids repeat or are null; copies remove each other. Other columns are ignored. `size` is at least 31."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    spans = repeated_spans(source.select("text"), size, gram, gathered)
    bits = spark.sparkContext.broadcast(sieve.build(keyed(spans, "owner"), "key"))
    kind = dict(source.dtypes)["__id"]
    out = f"__id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    hits = source.mapInArrow(lean(_named(bits)), f"__id {kind}, text string, owner binary")
    hits = hits.join(spans, "owner", "left").select("__id", "text", "spans")
    done = source.mapInArrow(lean(_untouched(bits)), out).unionAll(hits.mapInArrow(lean(_finish()), out))
    return done.withColumnRenamed("__id", id_col)
