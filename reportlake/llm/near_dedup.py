"""Near duplicates by SuperMinHash, banding, exact verification and union-find.

The signature gives every shingle a random permutation of the slots: in step j it offers the value
j + u (u in [0, 1)) to slot p[j]. Slots keep the smallest offer, so slots of one document are
correlated and vary less than independent hashes; a document stops as soon as all its slots are
below the next step.

Documents with equal shingle sets form a class, and only its smallest id goes on. Bands of slots
deal the ids into buckets. First every id is compared with the most central id of its buckets, so a
large group of copies costs one comparison a member. Ids of one bucket that are still in different
components are then compared too, if they agree on one of their rarest shingles, as every link must
(prefix filter), and that leaves room for enough others. All comparisons are of full sets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm import arrays, sieve
from reportlake.llm.components import components
from reportlake.llm.packed import BLOBS, by_document, dealt, gathered, per_document, shares
from reportlake.llm.work import lean, settled, stored

SHINGLE = 5
PERCENT = 80
ROWS = 4
BANDS = 32
FRACTION = np.uint64(0xFFFFFFFF)
#: Shingles of more documents count as common.
RARE = 62
STEP_SEED = np.uint64(0xA0761D6478BD642F)


def superminhash(values: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots): step in the high 32 bits, fraction in the low ones."""
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    out = np.full(n_docs * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    perm = None
    for j in range(slots):
        if not len(values):
            break
        random = arrays.mix(values + np.uint64((j + 1) * int(STEP_SEED) % 2**64))
        at = j + ((random & FRACTION) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        offer = (np.uint64(j) << np.uint64(32)) | (random >> np.uint64(32))
        rows = np.arange(len(values))
        if j == 0:
            slot = at
        else:
            slot = perm[rows, at]
            perm[rows, at] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, doc * slots + slot, offer)
        open_ = out.reshape(n_docs, slots).max(axis=1) >= np.uint64((j + 1) << 32)
        keep = open_[doc]
        if j == 0:
            values, doc, at = values[keep], doc[keep], at[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(values), 1))
            perm[np.arange(len(values)), at] = 0
            perm[:, 0] = at
        elif keep.mean() < 0.7:
            values, doc, perm = values[keep], doc[keep], perm[keep]
    return out.reshape(n_docs, slots)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.arange(bands, dtype=np.uint64)[None, :] * arrays.BASE
    for k in range(parts.shape[2]):
        key = arrays.mix(key + parts[:, :, k])
    return key


def set_digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    out = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(values ^ np.uint64(seed)))])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _sign(shingle: int, bands: int, rows: int):
    def run(stream):
        for batch in stream:
            for a, b, words in arrays.batches(batch):
                values, offsets = arrays.shingle_sets(words, words.hashes(lower=True), shingle)
                keys = band_keys(superminhash(values, offsets, bands * rows), bands)
                one, two = set_digests(values, offsets)
                ends = np.arange(b - a + 1) * bands
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("id", "mark")), pa.array(np.diff(offsets)), pa.array(one), pa.array(two),
                     arrays.binary_rows(keys.ravel(), ends)], ["id", "mark", "n", "d1", "d2", "bands"])

    return run


def _bands(stream):
    for batch in stream:
        keys = [np.frombuffer(b, np.int64) for b in batch.column("bands").to_pylist()]
        if keys:
            per = len(keys[0])
            ids, sizes = np.asarray(batch.column("id")), np.asarray(batch.column("n"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, per)), pa.array(np.repeat(sizes, per))],
                ["bucket", "id", "n"])


def _sets(shingle: int, bits):
    def run(stream):
        for batch in stream:
            known = batch.column("id").fill_null(-1)
            pick = sieve.test(bits.value, np.asarray(known)) & np.asarray(batch.column("id").is_valid())
            batch = batch.filter(pa.array(pick))
            for a, b, words in arrays.batches(batch):
                values, offsets = arrays.shingle_sets(words, words.hashes(lower=True), shingle)
                one, two = set_digests(values, offsets)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(one), pa.array(two), sets], ["id", "d1", "d2", "shingles"])

    return run


def _keys(parts: int):
    """Shingles of a batch by share, with the documents that have them; of one that more than RARE
    documents of the batch have, only that it is common."""

    def run(stream):
        for batch in stream:
            column = batch.column("shingles")
            keys = np.asarray(column.flatten()).view(np.uint64) >> np.uint64(6)
            owner = np.repeat(np.asarray(batch.column("id")), np.asarray(column.value_lengths()))
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(keys)))
            common = np.repeat(count > RARE, count)
            first = np.zeros(len(keys), bool)
            first[head] = True
            send = ~common | first
            yield dealt(shares(keys[send], parts), parts, keys[send], owner[send], common[send].astype(np.int8))

    return run


def _rare(parts: int):
    """Shingles of at most RARE documents go back to these, marked with their number."""

    def run(stream):
        keys, owner, common = gathered(stream, "<u8", "<i8", "i1")
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, owner, common = keys[order], owner[order], common[order]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.append(head, len(keys)))
            count = size.copy()
            count[np.maximum.reduceat(common, head) > 0] = RARE + 1
            rank = np.repeat(count, size)
            few = rank <= RARE
            yield by_document(parts, owner[few], (rank[few].astype(np.uint64) << np.uint64(58)) | keys[few])

    return run


def _prefixes(percent: int):
    """The first shingles of every document in one order for all: by number of documents, common ones
    last. Sets that are similar enough have one of them in common."""

    def run(stream):
        for batch in stream:
            ids, parts, rows = batch.column("id").to_pylist(), batch.column("component").to_pylist(), []
            for i, own, c, rare in zip(ids, batch.column("shingles"), parts, batch.column("v").to_pylist()):
                rare = np.frombuffer(rare or b"", np.uint64)
                keys = np.unique(np.asarray(own.values).view(np.uint64) >> np.uint64(6))
                rest = keys[~np.isin(keys, rare & np.uint64((1 << 58) - 1))] | np.uint64((RARE + 1) << 58)
                n = len(own.values)
                keep = n - -(-percent * n // 100) + 1
                order = np.sort(np.concatenate([rare, rest]))[:keep]
                rows.append((np.full(len(order), i), np.full(len(order), c), np.full(len(order), n), np.arange(len(order)), order.view(np.int64)))
            columns = [np.concatenate(x) for x in zip(*rows)] or [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["id", "component", "n", "at", "token"])

    return run


def linked(shared: Column, one: Column, other: Column, percent: int) -> Column:
    """Whether sets of these sizes with so many common shingles are similar enough."""
    return 100 * shared >= percent * (one + other - shared)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t")).cast("bigint")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", common)
    return both.where(linked(F.col("common"), F.size("s"), F.size("t"), percent)).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
                bands: int = BANDS, rows: int = ROWS, mark: Column | None = None) -> DataFrame:
    """One row per document: its id, n_shingles, component_id (smallest id it is linked with over any
    number of links, itself included), kept (it is that id).

    Documents are linked when 100 * common >= percent * union of their distinct word shingles, after
    lower-casing A-Z; a document of fewer words has one shingle, its whole sequence, and one without
    words is linked with nothing. Rows that share an id are linked like others; those of equal sets
    stay or go together. A row without id joins its class of equal sets and makes no other link.
    With `mark`, an expression, the result has its value for each row. Other columns are ignored; an empty
    table gives no rows."""
    spark = docs.sparkSession
    marked = F.lit(None).cast("string") if mark is None else mark
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), marked.alias("mark"), F.col(text_col).alias("text"))
    signed = stored(source.mapInArrow(lean(_sign(shingle, bands, rows)), "id bigint, mark string, n bigint, d1 bigint, d2 bigint, bands binary"), "signed")
    classes = stored(signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("id")), "classes")
    chosen = signed.join(classes.where("id is not null"), ["d1", "d2", "n", "id"], "left_semi")
    banded = chosen.select("id", "n", "bands").mapInArrow(lean(_bands), "bucket bigint, id bigint, n bigint")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    placed = stored(banded.join(full, "bucket"), "buckets")
    central = placed.groupBy("id").agg(F.sum("members").alias("central"))
    placed = stored(placed.drop("members").join(central, "id"), "buckets")

    # Every id against the most central id of its buckets.
    hub = placed.groupBy("bucket").agg(F.max(F.struct("central", -F.col("id"), "n").alias("hub")).alias("hub"))
    hub = hub.select("bucket", F.col("hub.central").alias("weight"), (-F.col("hub.col2")).alias("hub"), F.col("hub.n").alias("m"))
    small, large = F.least("n", "m"), F.greatest("n", "m")
    near = placed.join(hub, "bucket").where((F.col("id") != F.col("hub")) & (100 * small >= percent * large))
    star = near.groupBy("id").agg(F.max(F.struct("weight", -F.col("hub"))).alias("best"))
    star = stored(star.select(F.col("id").alias("a"), (-F.col("best.col2")).alias("b")), "star")
    bits = spark.sparkContext.broadcast(sieve.build(placed, "id"))
    sets = source.mapInArrow(lean(_sets(shingle, bits)), "id bigint, d1 bigint, d2 bigint, shingles array<bigint>")
    wanted = chosen.select("id", "d1", "d2").join(placed.select("id").distinct(), "id", "left_semi")
    sets = stored(sets.join(wanted, ["id", "d1", "d2"], "left_semi").select("id", "shingles"), "sets")
    links = stored(_verified(star, sets, percent), "links")
    part = components(links)

    # Ids of one bucket in different components, unless a link is ruled out.
    of = placed.join(part, "id", "left").withColumn("component", F.coalesce("component", "id")).drop("central")
    mixed = of.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    of = stored(of.join(mixed.select("bucket"), "bucket", "left_semi"), "mixed")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = stored(sets.join(of.select("id", "component").distinct(), "id"), "open")
    rare = rest.mapInArrow(lean(_keys(parts)), BLOBS).repartition(parts, "part").mapInArrow(lean(_rare(parts)), BLOBS)
    rare = rare.repartition(parts, "part").mapInArrow(lean(per_document("<u8")), "id bigint, v binary")
    prefix = stored(rest.join(rare, "id", "left").mapInArrow(
        lean(_prefixes(percent)), "id bigint, component bigint, n bigint, at bigint, token bigint"), "prefixes")
    main = of.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("members")).groupBy("bucket").agg(
        F.max_by("component", F.struct("members", "component")).alias("main"))
    minor = of.join(main, "bucket").where("component <> main").select("id").distinct()
    left = prefix.join(minor, "id", "left_semi").select(
        "token", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("component").alias("c_a"))
    # As the first common shingle of both, it leaves so many that can be common.
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at"))
    pairs = left.join(prefix, "token").where(
        (F.col("c_a") != F.col("component")) & linked(most, F.col("n_a"), F.col("n"), percent))
    pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    tested = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(_verified(pairs.join(tested, ["a", "b"], "left_anti"), sets, percent), "links")
    if more.take(1):
        part = components(links.unionAll(more))

    named = classes.join(part, "id", "left").select(
        "d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    some = signed.where("n > 0").select("id", "mark", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select("id", "mark", "n", "component")
    none = signed.where("n = 0").select("id", "mark", "n", F.col("id").alias("component"))
    return some.unionAll(none).select(
        F.col("id").alias(id_col), *([] if mark is None else ["mark"]), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, the smallest id, with all its columns. Rows without id stay. Links are
    between ids: where rows of one id have different texts, none of them goes, since only one of the
    texts may be a copy."""
    mark = F.xxhash64(F.coalesce(text_col, F.lit(""))).cast("string")

    def copies():
        of_id = near_groups(docs, id_col, text_col, mark=mark, **options).groupBy(id_col).agg(
            F.bool_or("kept").alias("kept"), (F.min(F.col("mark").cast("bigint")) != F.max(F.col("mark").cast("bigint"))).alias("several"))
        return of_id.where("not kept and not several").select(id_col)

    return sieve.without(docs, settled(docs.sparkSession, copies, "copies"), id_col)
