"""Byte-level BPE with a transducer for frequent words and exact merges for all others.

Texts are cut into words by vectorised character classes, equal to the pattern of the public
vocabulary: contractions, an optional space before letters, numbers or other signs, white space.
Distinct words of a slice are looked up in the transducer; unseen words are merged pair by pair, the
pair of lowest rank first. Frequent words come from lossy counting over all documents; which words
it finds changes the speed only, never a result."""

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm import arrays
from reportlake.llm.lexicon import IntMap, Transducer
from reportlake.llm.work import lean

LEXICON_WORDS = 50_000
SUMMARY_WORDS = 50_000
CHUNK_BYTES = 1 << 19
#: Longer words are merged one by one by a heap.
LONG_WORD = 256
#: Longer words are not kept in the lexicon.
LEXICON_BYTES = 64

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
# The Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Pieces, merges and special tokens of a byte-level BPE file."""

    def __init__(self, text: str) -> None:
        parsed, letters = json.loads(text), byte_letters()
        vocab = parsed["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"]]
        self.listed = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        self.pairs = IntMap.build(self.listed)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    @functools.cached_property
    def ranks(self) -> dict[int, int]:
        return {pair: rank for rank, pair in enumerate(self.listed.tolist())}

    def merge_long(self, word: np.ndarray) -> list[int]:
        """Ids of one word of any length: places wait in a heap by the rank of the pair that begins there,
        so every merge costs a few heap steps."""
        ids, n, ranks = self.byte_id[word].tolist(), len(word), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [rank * n + i for i in range(n - 1) if (rank := ranks.get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get(ids[i] << 24 | ids[j]) != rank:
                continue  # merged meanwhile
            ids[i], ids[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := ranks.get(ids[a] << 24 | ids[b])) is not None:
                    heapq.heappush(heap, rank * n + a)
        return [x for x in ids if x >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word data[start:end], one after another, and how many each has."""
        long = ends - starts > LONG_WORD
        if not long.any():
            return self.merge_short(data, starts, ends)
        ids, some = self.merge_short(data, starts[~long], ends[~long])
        parts = [self.merge_long(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        counts = np.zeros(len(starts), np.int64)
        counts[~long], counts[long] = some, [len(p) for p in parts]
        out = np.zeros(counts.sum(), np.int64)
        first = np.cumsum(counts) - counts
        out[arrays.ragged(first[~long], some)] = ids
        out[arrays.ragged(first[long], counts[long])] = np.concatenate(parts)
        return out, counts

    def merge_short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of bounded length, one merge of every word at a time."""
        counts = ends - starts
        ids = self.byte_id[data[arrays.ragged(starts, counts)]]
        word = np.repeat(np.arange(len(starts)), counts)
        out = np.full(len(ids), -1, np.int64)
        place = np.arange(len(ids))
        none = len(self.merged)
        rank = np.full(len(ids), none, np.int64)
        changed = np.arange(max(len(ids) - 1, 0))
        while len(ids):
            # Only pairs with a new part are looked up again.
            found = self.pairs.find(ids[changed] << 24 | ids[changed + 1])
            rank[changed] = np.where((word[changed] == word[changed + 1]) & (found >= 0), found, none)
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[head, len(ids)])
            # The first pair of the lowest rank of each word: rank and position in one number.
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), head)
            more = best // len(ids) < none
            at = best[more] % len(ids)
            ids[at] = self.merged[rank[at]]
            keep = np.repeat(more, length)
            out[place[~keep]] = ids[~keep]
            keep[at + 1] = False
            new = np.zeros(len(ids), bool)
            new[at] = True
            rank[at] = none
            ids, word, place, rank, new = ids[keep], word[keep], place[keep], rank[keep], new[keep]
            new[:-1] |= new[1:]
            changed = np.flatnonzero(new[:-1]) if len(ids) else np.zeros(0, int)
        of = np.repeat(np.arange(len(starts)), counts)[out >= 0]
        return out[out >= 0], np.bincount(of, minlength=len(starts))


@functools.cache
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """True where all spans equal their partners byte by byte, eight bytes at a time."""
    size = end - start
    if not np.array_equal(size, other_end - other):
        return False
    words = arrays.words_at(data)
    at = 0
    while len(size):
        part = np.minimum(size - at, 8).astype(np.uint64)
        shift = np.uint64(64) - part * np.uint64(8)
        if ((words[start + at] ^ words[other + at]) >> shift).any():
            return False
        at += 8
        more = size > at
        size, start, other = size[more], start[more], other[more]
    return True


class Slice:
    """Words of consecutive documents: distinct ones as byte spans, and the number of each place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, special: list[str]) -> None:
        self.data = data
        raw = data.tobytes()
        char_at = np.flatnonzero((data & 0xC0) != 0x80)
        chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(chars)
        docs = np.searchsorted(char_at, offsets)
        cut = np.zeros(n + 1, bool)
        cut[docs] = True
        cut[n] = True
        marks = []
        for token in special:
            at = raw.find(token.encode())
            while at >= 0:
                inside = np.searchsorted(offsets, at, "right") - 1
                if at + len(token) <= offsets[inside + 1]:
                    first = int(np.searchsorted(char_at, at))
                    marks.append((first, first + len(token), token))
                    cut[[first, first + len(token)]] = True
                    at += len(token) - 1
                at = raw.find(token.encode(), at + 1)
        kind = char_classes()[chars]
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= cut[:n]
        # White space before a word: its last character stands alone or, if a space, joins the word.
        blank = np.zeros(n + 1, bool)
        blank[:n] = kind == SPACE
        last = np.flatnonzero(blank[:n] & ~blank[1:] & ~cut[1:])
        start[last] = True
        start[last[chars[last] == 32] + 1] = False
        # Contractions: 's 't 'm 'd 're 've 'll, where the apostrophe begins a word.
        quote = np.flatnonzero((chars == 39) & start & ~cut[1:])
        if len(quote):
            one = chars[quote + 1]
            third = np.minimum(quote + 2, n - 1)
            two = np.where((quote + 2 < n) & ~cut[quote + 2], chars[third], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                after = at + size
                after = after[after < n]
                start[after[(kind[after] == LETTER) & ~cut[after]]] = True
        for a, b, _ in marks:
            start[a + 1:b] = False
        first = np.flatnonzero(start)
        end = np.append(first[1:], n)
        hashes = arrays.placed_hashes(chars.astype(np.uint64), first, end)
        for a, _, token in marks:
            hashes[np.searchsorted(first, a)] = special.index(token)
        self.keys, where, self.place = np.unique(hashes, return_index=True, return_inverse=True)
        byte_at = np.append(char_at, len(data))
        self.start, self.end = byte_at[first[where]], byte_at[end[where]]
        if not same_bytes(data, byte_at[first], byte_at[end], self.start[self.place], self.end[self.place]):
            self.by_bytes(raw, byte_at[first], byte_at[end], hashes, len(special))
        self.marked = np.isin(self.keys, np.arange(len(special), dtype=np.uint64)) if marks else np.zeros(len(self.keys), bool)
        self.docs = np.searchsorted(first, docs)

    def by_bytes(self, raw: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, special: int) -> None:
        """Two words share a hash: number the words by their bytes. Keys above the special ones only need
        to differ."""
        known: dict = {}
        names = [raw[a:b] if h >= special else int(h) for a, b, h in zip(start.tolist(), end.tolist(), hashes.tolist())]
        self.place = np.array([known.setdefault(w, len(known)) for w in names], np.int64)
        where = np.unique(self.place, return_index=True)[1]
        self.keys = np.array([w if isinstance(w, int) else special + k for k, w in enumerate(known)], np.uint64)
        self.start, self.end = start[where], end[where]


def _slices(batch: pa.RecordBatch, special: list[str]):
    data, offsets = arrays.string_buffer(batch.column("text"))
    for a, b in arrays.slices(offsets, CHUNK_BYTES):
        yield a, b, Slice(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], special)


def _heavy(limit: int):
    """Lossy counting of the words of a task: each slice is one bucket, and words that cannot have
    more occurrences than there were buckets are let go. The `limit` most frequent are returned."""

    def run(stream):
        keys, counts, late, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        bucket = 0
        for batch in stream:
            for _, _, part in _slices(batch, []):
                seen = np.bincount(part.place, minlength=len(part.keys))
                at = np.searchsorted(keys, part.keys)
                held = np.zeros(len(part.keys), bool)
                inside = at < len(keys)
                held[inside] = keys[at[inside]] == part.keys[inside]
                counts[at[held]] += seen[held]
                # A long word is never worth a path of its own in the lexicon.
                new = np.flatnonzero(~held & (seen > 1) & (part.end - part.start <= LEXICON_BYTES))
                raw = part.data.tobytes()
                words = np.empty(len(new), object)
                words[:] = [raw[a:b] for a, b in zip(part.start[new].tolist(), part.end[new].tolist())]
                keys, counts = np.concatenate([keys, part.keys[new]]), np.concatenate([counts, seen[new]])
                late, names = np.concatenate([late, np.full(len(new), bucket)]), np.concatenate([names, words])
                bucket += 1
                order = np.argsort(keys, kind="stable")
                order = order[(counts + late)[order] > bucket]
                keys, counts, late, names = keys[order], counts[order], late[order], names[order]
        top = np.argsort(-counts, kind="stable")[:limit]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[top].tolist(), pa.binary()), pa.array(counts[top])], ["word", "n"]
        )

    return run


def frequent_words(docs: DataFrame, text_col: str = "text", words: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words over all documents, sorted; at most `words` reach the driver."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(lean(_heavy(SUMMARY_WORDS)), "word binary, n bigint")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return sorted(bytes(r["word"]) for r in top.select("word").collect())


def compile_lexicon(text: str, words: list[bytes]) -> bytes:
    """The mappable transducer of the words with their ids. `text` is the vocabulary file's content."""
    own = vocabulary(text)
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    ids, counts = own.merge(data, ends - sizes, ends)
    parts = np.split(ids, np.cumsum(counts)[:-1]) if words else []
    return Transducer.build(words, [p.tolist() for p in parts]).to_bytes()


@functools.lru_cache(maxsize=2)
def _mapped(blob: bytes) -> Transducer:
    return Transducer.mapped(blob)


def encode_slice(part: Slice, own: Vocabulary, known: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, one after another, and their offsets."""
    rank = known.rank(part.data, part.start, part.end)
    rank[part.marked] = -1
    count = np.zeros(len(rank), np.int64)
    first = np.zeros(len(rank), np.int64)
    seen = rank >= 0
    first[seen] = known.first[rank[seen]]
    count[seen] = known.first[rank[seen] + 1] - known.first[rank[seen]]
    new = np.flatnonzero(~seen & ~part.marked)
    ids, counts = own.merge(part.data, part.start[new], part.end[new])
    first[new] = len(known.ids) + np.cumsum(counts) - counts
    count[new] = counts
    marked = np.flatnonzero(part.marked)
    first[marked] = len(known.ids) + len(ids) + np.arange(len(marked))
    count[marked] = 1
    special = [own.special[token] for token in own.special]
    table = np.concatenate([known.ids, ids, [special[int(k)] for k in part.keys[marked]]]).astype(np.int32)
    sizes = count[part.place]
    flat = table[arrays.ragged(first[part.place], sizes)]
    return flat, np.concatenate([[0], np.cumsum(sizes)])[part.docs]


def _encode(vocabulary_text, lexicon):
    def run(stream):
        own, known = vocabulary(vocabulary_text.value), _mapped(lexicon.value)
        special = list(own.special)
        for batch in stream:
            names = [n for n in batch.schema.names if n != "text"]
            for a, b, part in _slices(batch, special):
                ids, offsets = encode_slice(part, own, known)
                values = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), values], [*names, "ids"])

    return run


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `ids array<int>` of every text, as the tokenizer file at `path` (read on the
    driver) encodes it without added special tokens; a special token in the text has its id.

    Null and empty texts have no ids. Rows are independent: repeated rows and null keys are kept."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        text = file.read()
    lexicon = compile_lexicon(text, frequent_words(docs, text_col))
    source = docs.select(*keep, F.col(text_col).alias("text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in source.drop("text").dtypes)
    run = _encode(spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(lexicon))
    return source.mapInArrow(lean(run), f"{schema}, ids array<int>")


def _decode(vocabulary_text, id_name):
    def run(stream):
        pieces = vocabulary(vocabulary_text.value).pieces
        for batch in stream:
            names = [n for n in batch.schema.names if n != id_name]
            column = batch.column(id_name)
            flat = np.asarray(column.flatten())
            ends = np.cumsum(np.asarray(column.value_lengths().fill_null(0)))
            texts, first = [], 0
            for last in ends.tolist():
                raw = b"".join(map(pieces.__getitem__, flat[first:last].tolist()))
                texts.append(raw.decode("utf-8", "replace"))
                first = last
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, "text"]
            )

    return run


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Replace the ids by the `text` they stand for, special tokens included; null ids give ''.
    Bytes that are no UTF-8 become U+FFFD."""
    with open(path, encoding="utf-8") as file:
        text = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.drop(ids_col).dtypes)
    return encoded.mapInArrow(lean(_decode(text, ids_col)), f"{schema}, text string")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
