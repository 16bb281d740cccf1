"""Fill-in-middle over seekable frames.

A text is stored as independent zstandard frames of at most FRAME bytes, each with the units and code
points that stand before it. Choosing a cut reads the counts and decompresses one frame; the output is
again a list of frames, in which only the cut ones are new. Digests read frames in order, so no step
but the first holds a whole text. Joined frames are a plain zstandard stream.

A unit is a word with the white space before it, or white space at the end of the text."""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays
from reportlake.llm.work import lean, stored

FRAME = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
FRAMES = "frames array<struct<units: bigint, chars: bigint, data: binary>>"
FRAME_TYPE = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("data", pa.binary())]))


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends (byte positions) of the units of consecutive texts."""
    space = arrays.IS_SPACE[data]
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    before_space = np.ones(len(data), bool)
    before_space[:-1] = space[1:]
    return np.flatnonzero(np.where(space, last, before_space | last)) + 1


def is_start(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80


def frame_edges(data: np.ndarray, size: int) -> list[int]:
    """Where the frames of one text begin, and its end. No code point is cut."""
    edges = [0]
    while edges[-1] + size < len(data):
        at = edges[-1] + size
        at -= int(np.argmax(is_start(data[at - 3:at + 1])[::-1]))
        edges.append(at)
    return [*edges, len(data)] if len(data) else [0]


def _frames(size: int, names: list[str]):
    def run(stream):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in stream:
            data, offsets = arrays.string_buffer(batch.column("text"))
            for first, last in arrays.slices(offsets):
                part = data[offsets[first]:offsets[last]]
                at = offsets[first:last + 1] - offsets[first]
                ends = unit_ends(part, at)
                begun = np.concatenate([[0], np.cumsum(is_start(part))])
                rows, units, chars, marked = [], [], [], []
                for k in range(last - first):
                    a, b = int(at[k]), int(at[k + 1])
                    edges = np.asarray(frame_edges(part[a:b], size)) + a
                    count = np.searchsorted(ends, edges, "right")
                    count -= count[0]
                    text = part[a:b].tobytes()
                    rows.append([
                        {"units": int(count[j]), "chars": int(begun[edges[j]] - begun[a]), "data": press.compress(text[edges[j] - a:edges[j + 1] - a])}
                        for j in range(len(edges) - 1)])
                    units.append(int(count[-1]))
                    chars.append(int(begun[b] - begun[a]))
                    marked.append(any(m in text for m in MARKS))
                kept = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(n) for n in names), pa.array(units, pa.int64()), pa.array(chars, pa.int64()),
                     pa.array(marked, pa.bool_()), pa.array(rows, FRAME_TYPE)],
                    [*names, "n", "n_chars", "marked", "frames"])

    return run


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FRAME) -> DataFrame:
    """One row per document: its id, `n` units, `n_chars` code points, `marked` (the text contains a mark)
    and `frames` (units and code points before the frame, compressed bytes). A null or empty text has no
    frame. Every row stands for itself, also where rows repeat or the id is null; other columns are
    ignored. Written to the shared folder."""
    source = docs.select(F.col(id_col).alias("__id"), F.col(id_col).cast("string").alias("__key"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["__id"]
    out = source.mapInArrow(
        lean(_frames(size, ["__id", "__key"])), f"__id {kind}, __key string, n bigint, n_chars bigint, marked boolean, {FRAMES}")
    return stored(out, "frames").withColumnRenamed("__id", id_col)


def draws(key: str, seed: int) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def locate(frames: list[dict], unit: int, n_chars: int, read) -> tuple[int, int, int]:
    """The cut after `unit` units: frame, byte in the frame, code points before it. Reads one frame."""
    if unit == 0:
        return 0, 0, 0
    which = int(np.searchsorted([f["units"] for f in frames], unit)) - 1
    data = np.frombuffer(read(frames[which]["data"]), np.uint8)
    # Inside the frame; a unit that ends with the frame shows only in the counts of the next one.
    space = arrays.IS_SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    wanted = unit - frames[which]["units"]
    at = int(ends[wanted - 1]) if wanted <= len(ends) else len(data)
    return which, at, frames[which]["chars"] + int(is_start(data[:at]).sum())


def pieces(frames: list[dict], start: tuple[int, int], end: tuple[int, int], read, press) -> list[bytes]:
    """Compressed frames of the bytes between two cuts; whole frames pass as they are."""
    out = []
    for k in range(start[0], min(end[0] + 1, len(frames))):
        data = frames[k]["data"]
        low = start[1] if k == start[0] else 0
        high = end[1] if k == end[0] else None
        if low or high is not None:
            text = read(data)[low:high]
            if not text:
                continue
            data = press(text)
        out.append(data)
    return out


def _cut(seed: int, rate: int, suffix_first: int):
    def run(stream):
        press = zstandard.ZstdCompressor(level=LEVEL).compress
        read = zstandard.ZstdDecompressor().decompress
        mark = {m: press(m) for m in MARKS}
        for batch in stream:
            forms, prefix_chars, middle_chars, outputs = [], [], [], []
            cells = zip(*(batch.column(c).to_pylist() for c in ("__key", "n", "n_chars", "marked")))
            for row, (key, n, n_chars, marked) in enumerate(cells):
                frames = batch.column("frames")[row].as_py()
                h = draws(key if key is not None else "null", seed)
                if not frames or marked or h[2] % 100 >= rate:
                    forms.append("plain")
                    prefix_chars.append(None)
                    middle_chars.append(None)
                    outputs.append([f["data"] for f in frames])
                    continue
                low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                first, second = locate(frames, low, n_chars, read), locate(frames, high, n_chars, read)
                prefix = pieces(frames, (0, 0), first[:2], read, press)
                middle = pieces(frames, first[:2], second[:2], read, press)
                suffix = pieces(frames, second[:2], (len(frames), 0), read, press)
                spm = h[3] % 100 < suffix_first
                if spm:
                    out = [mark[SUFFIX], *suffix, mark[PREFIX], *prefix, mark[MIDDLE], *middle]
                else:
                    out = [mark[PREFIX], *prefix, mark[SUFFIX], *suffix, mark[MIDDLE], *middle]
                forms.append("spm" if spm else "psm")
                prefix_chars.append(first[2])
                middle_chars.append(second[2] - first[2])
                outputs.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("n"), pa.array(forms, pa.string()), pa.array(prefix_chars, pa.int64()),
                 pa.array(middle_chars, pa.int64()), pa.array(outputs, pa.list_(pa.binary()))],
                ["__id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(frames: DataFrame, id_col: str = "doc_id", seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """One row per row of `framed`: id, n, form, prefix_chars, middle_chars and `output`, the new text as
    compressed frames in order.

    The cuts follow from the sha256 of `seed:id` (`null` for a null id). Of 100 documents about `rate` are
    rearranged, and of 100 of these about `suffix_first` as spm. Empty texts and texts that contain a
    mark are plain."""
    source = frames.withColumnRenamed(id_col, "__id")
    out = source.mapInArrow(
        lean(_cut(seed, rate, suffix_first)),
        f"__id {dict(source.dtypes)['__id']}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>")
    return out.withColumnRenamed("__id", id_col)


def spans(frames: list[bytes], form: str, read) -> list[tuple[int, int]]:
    """Byte ranges of the output that make up the original text, in its order."""
    size, tail, found = 0, b"", {}
    for data in frames:
        text = tail + read(data)
        base = size - len(tail)
        for m in MARKS:
            if m not in found and (at := text.find(m)) >= 0:
                found[m] = base + at
        size = base + len(text)
        tail = text[-2:]
    if form == "plain":
        return [(0, size)]
    order = sorted(found, key=found.get)
    ends = [found[m] for m in order[1:]] + [size]
    part = {m: (found[m] + len(m), end) for m, end in zip(order, ends)}
    return [part[PREFIX], part[MIDDLE], part[SUFFIX]]


def stream_of(frames: list[bytes], ranges: list[tuple[int, int]], read):
    """The bytes of some ranges, frame by frame."""
    for low, high in ranges:
        at = 0
        for data in frames:
            if at >= high:
                break
            size = zstandard.frame_content_size(data)
            if at + size > low:
                yield read(data)[max(low - at, 0):high - at]
            at += size


def _digests(stream):
    read = zstandard.ZstdDecompressor().decompress
    for batch in stream:
        made, rebuilt = [], []
        for row, form in enumerate(batch.column("form").to_pylist()):
            frames = batch.column("output")[row].as_py()
            for ranges, into in (([(0, 1 << 62)], made), (spans(frames, form, read), rebuilt)):
                digest = hashlib.sha256()
                for text in stream_of(frames, ranges, read):
                    digest.update(text)
                into.append(digest.hexdigest())
        out = batch.drop_columns(["output"])
        yield out.append_column("output_sha256", pa.array(made)).append_column("restored_sha256", pa.array(rebuilt))


def digests(done: DataFrame) -> DataFrame:
    """Digests of the output and of the text rebuilt from output and form, in place of `output`."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in done.dtypes if n != "output")
    return done.mapInArrow(lean(_digests), f"{kinds}, output_sha256 string, restored_sha256 string")


def _texts(stream):
    read = zstandard.ZstdDecompressor().decompress
    for batch in stream:
        made, rebuilt = [], []
        for row, form in enumerate(batch.column("form").to_pylist()):
            frames = batch.column("output")[row].as_py()
            made.append(b"".join(stream_of(frames, [(0, 1 << 62)], read)).decode())
            rebuilt.append(b"".join(stream_of(frames, spans(frames, form, read), read)).decode())
        out = batch.drop_columns(["output"])
        yield out.append_column("output", pa.array(made, pa.string())).append_column("restored", pa.array(rebuilt, pa.string()))


def texts(done: DataFrame) -> DataFrame:
    """The output as text, and the original text rebuilt from it and the form."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in done.dtypes if n != "output")
    return done.mapInArrow(lean(_texts), f"{kinds}, output string, restored string")
