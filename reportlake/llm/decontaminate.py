"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by the size of their shingle set. All items of a partition keep a MinHash
sketch of one length: so many of their smallest hash values that a document which holds the asked
share of an item's shingles must hold some of its sketch, whatever else it holds and however long
it is. Items wait in an index from sketch values; every document looks its shingles up, drops items
of which too much of the sketch is missing, and compares the rest shingle by shingle.

The index travels to the documents in blocks of bounded size, one pass per block; documents are
never shuffled."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm import arrays, sieve
from reportlake.llm.work import Sent, lean, stored

WORDS = 5
SHARE = 0.8
BLOCK_BYTES = 16 << 20


def sketch_length(size: int, share: float) -> int:
    """Values kept by the items of the size partition [2^k, 2^(k+1)): one more than may be missing."""
    upper = (2 << (size.bit_length() - 1)) - 1
    return min(size, upper - least_found(upper, share) + 1)


def least_found(size: int, share: float) -> int:
    return math.ceil(size * share - 1e-9)


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of n words; of fewer words, the whole sequence."""
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


class Index:
    def __init__(self, items: list[tuple[int, str]], n: int, share: float) -> None:
        self.n, self.share, self.ids, self.sets, self.lengths = n, share, [], [], []
        keys, owner = [], []
        data, offsets = arrays.string_buffer(pa.array([t for _, t in items], pa.string()))
        words = arrays.Words(data, offsets)
        values, at = arrays.shingle_sets(words, words.hashes(lower=True), n)
        for k, (item, text) in enumerate(items):
            own = values[at[k]:at[k + 1]]
            if len(own):
                keys.append(np.sort(own)[: sketch_length(len(own), share)])
                owner.append(np.full(len(keys[-1]), len(self.ids)))
                self.ids.append(item)
                self.sets.append(shingles(text.encode().lower().split(), n))
                self.lengths.append(min(n, int(words.count[k])))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.sketches = np.array([len(k) for k in keys], np.int64)
        keys = np.concatenate([*keys, np.zeros(0, np.uint64)])
        owner = np.concatenate([*owner, np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.owner, keys = owner[order], keys[order]
        self.keys, self.first = np.unique(keys, return_index=True)
        self.first = np.append(self.first, len(keys))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.most_missing = self.sizes - np.array([least_found(int(s), share) for s in self.sizes], np.int64)

    def search(self, words: arrays.Words) -> list[tuple[int, int, int]]:
        """(document, item, shingles found) of every document of a slice that holds enough of an item."""
        hashes = words.hashes(lower=True)
        docs, hits = [], []
        for n in sorted(set(self.lengths)):
            keep = arrays.whole(words.doc, n)
            value = arrays.ngrams(hashes, n)
            keep &= self.maybe[(value & np.uint64(0xFFFF)).astype(np.int64)]
            value, doc = value[keep], words.doc[: len(keep)][keep]
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            hit = self.keys[at] == value
            docs.append(doc[hit])
            hits.append(at[hit])
        if not docs:
            return []
        pair = np.unique(np.concatenate(docs) * len(self.keys) + np.concatenate(hits))
        doc, key = pair // len(self.keys), pair % len(self.keys)
        count = self.first[key + 1] - self.first[key]
        owner = self.owner[arrays.ragged(self.first[key], count)]
        both, found = np.unique(np.repeat(doc, count) * len(self.ids) + owner, return_counts=True)
        doc, item = both // len(self.ids), both % len(self.ids)
        enough = self.sketches[item] - found <= self.most_missing[item]
        out, last, held = [], -1, {}
        for d, i in zip(doc[enough].tolist(), item[enough].tolist()):
            if d != last:
                text = words.data[words.offsets[d]:words.offsets[d + 1]].tobytes().lower().split()
                last, held = d, {}
            n = self.lengths[i]
            if n not in held:
                held[n] = shingles(text, n)
            here = len(self.sets[i] & held[n])
            if here >= least_found(int(self.sizes[i]), self.share):
                out.append((d, i, here))
        return out


def _search(index):
    def run(stream):
        own = index.value
        for batch in stream:
            rows, items, found = [], [], []
            for a, _, words in arrays.batches(batch):
                for d, i, n in own.search(words):
                    rows.append(a + d)
                    items.append(i)
                    found.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "mark")), pa.array([own.ids[i] for i in items], pa.int64()),
                 pa.array([int(own.sizes[i]) for i in items], pa.int64()), pa.array(found, pa.int64())],
                ["id", "mark", "item", "n_shingles", "n_found"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                 mark: Column | None = None) -> DataFrame:
    """One row (id, item, n_shingles of the item, n_found) for each document that holds at least
    `share` of the distinct word shingles of an item, after lower-casing A-Z.

    An item of fewer words than a shingle is one shingle, found where its words follow each other in
    a document; null or blank items and documents match nothing. Rows that share an id are one
    document, or item, with the best match of its rows; null ids count as an id. With `mark`, rows of an id
    are told apart by that expression, and the result has it. Other columns are ignored. An empty table on either side gives no rows."""
    spark = docs.sparkSession
    marked = F.lit(None).cast("string") if mark is None else mark
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), marked.alias("mark"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    shape = "id bigint, mark string, item bigint, n_shingles bigint, n_found bigint"
    out = spark.createDataFrame([], shape)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        index = Index([(r["item"], r["text"]) for r in part.collect()], words, share)
        if index.ids:
            out = out.unionAll(source.mapInArrow(lean(_search(Sent(spark, index))), shape))
    best = F.max(F.struct(F.col("n_found") / F.col("n_shingles"), "n_shingles", "n_found"))
    return out.groupBy("id", "mark", "item").agg(best.alias("b")).select(
        F.col("id").alias(id_col), *([] if mark is None else ["mark"]), F.col("item").alias(item_col), "b.n_shingles", "b.n_found"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Of rows that share an id, or have
    none, those go whose own text holds an item."""
    mark = F.sha2(F.coalesce(options.get("text_col", "text"), F.lit("")), 256)
    gone = contaminated(docs, benchmark, id_col=id_col, mark=mark, **options).select(id_col, "mark").distinct()
    return sieve.without(docs, stored(gone, "leaks"), id_col, mark)
