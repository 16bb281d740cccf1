"""Quality without labels: votes of heuristics, a label model, and a linear scorer.

Overlapping heuristics vote bad, good or not at all (most know one kind of junk and abstain on the
rest). Expectation-maximisation over the counts of vote
patterns of all documents estimates how each votes on good and on bad documents, and the posterior
of each pattern. A linear scorer over hashed bytes, byte triples and word
shapes learns the posteriors on a
bounded sample, so that it also judges texts on which no heuristic votes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays
from reportlake.llm.toxicity import _one_row, _summed
from reportlake.llm.work import stored

BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ("signs", "bars", "odd_ends", "word_length", "variety", "stutter", "lines", "capitals", "length")
#: The most training documents of the scorer, chosen by the hash of their id.
TRAIN_DOCS = 4000
BITS = 15
SIZE = 1 << BITS
STEPS, RATE, SCALE = 30, 0.3, 20.0
SLICE = 1 << 20


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes (documents x labellers)."""
    words = arrays.Words(data, offsets)
    n = words.count
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    space = arrays.IS_SPACE[data]
    sign = ~(letter | digit | space)
    long = words.end - words.start
    single = (long == 1) & sign[np.minimum(words.start, max(len(data) - 1, 0))] if len(data) else np.zeros(0, bool)
    hashes = words.hashes(lower=True)
    pair = np.unique(words.doc.astype(np.uint64) * arrays.STEP ^ (hashes >> np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(words.doc[pair], minlength=len(n)) / np.maximum(n, 1)
    breaks = _share(data == 10, offsets) * np.diff(offsets) + 1
    line = arrays.Words(data, offsets, np.arange(256) == 10)
    line_hash = line.hashes()
    first = np.unique(line.doc.astype(np.uint64) * arrays.STEP ^ line_hash, return_index=True)[1]
    fresh = np.bincount(line.doc[first], minlength=len(n)) / np.maximum(line.count, 1)
    mean_length = np.bincount(words.doc, weights=long, minlength=len(n)) / np.maximum(n, 1)
    of_words = lambda mask: np.bincount(words.doc, weights=mask, minlength=len(n)) / np.maximum(n, 1)
    signs, bars, capitals = _share(sign, offsets), of_words(single), _share(upper, offsets)

    ends = data[np.maximum(words.end - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    odd_ends = of_words(sign[np.maximum(words.end - 1, 0)] & ~np.isin(ends, np.frombuffer(b".,;:!?)\"'", np.uint8)) if len(data) else ends)
    same = np.zeros(len(words.doc))
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    stutter = of_words(same)
    some = n >= 5
    bad = [
        signs > 0.07, bars > 0.05, odd_ends > 0.1, some & ((mean_length < 2.5) | (mean_length > 12)),
        (n >= 50) & (distinct < 0.15), some & (stutter > 0.15), (breaks >= 4) & (fresh < 0.6), some & (capitals > 0.4), n < 3,
    ]
    out = np.where(np.stack(bad, axis=1), BAD, NONE)
    out[(n >= 20) & ~bad[-1], -1] = GOOD
    return out


def pattern(vote: np.ndarray) -> np.ndarray:
    return vote @ (3 ** np.arange(vote.shape[1]))


def unpack(code: np.ndarray, n: int) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(n) % 3


def label_model(patterns: np.ndarray, counts: np.ndarray, n: int, steps: int = 100) -> np.ndarray:
    """Posterior of "good" for every vote pattern. At the start a document is bad by as much as its bad
    votes outweigh its good ones, one bad vote more than one good."""
    vote = unpack(patterns, n)
    good, bad = (vote == GOOD).sum(axis=1), (vote == BAD).sum(axis=1)
    p = (good + 1) / (good + 4.0 * bad + 1.2)
    for _ in range(steps):
        old, logs = p, []
        for weight in (counts * (1 - p), counts * p):
            table = np.stack([np.bincount(vote[:, j], weights=weight, minlength=3) + 1 for j in range(n)])
            chance = np.log(table / table.sum(axis=1, keepdims=True))
            logs.append(np.log(weight.sum() + 1) + chance[np.arange(n), vote].sum(axis=1))
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(p - old).max() < 1e-6:
            break
    return p


def _grams(data: np.ndarray, offsets: np.ndarray):
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint64)
    yield doc, (wide * arrays.BASE >> np.uint64(64 - BITS)).astype(np.int64)
    value = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    keep = arrays.whole(doc, 3)
    yield doc[: len(keep)][keep], ((value + np.uint64(1 << 24))[keep] * arrays.BASE >> np.uint64(64 - BITS)).astype(np.int64)
    words = arrays.Words(data, offsets)
    hashes = words.hashes(lower=True)
    same = np.zeros(len(hashes), np.uint64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    shape = same * np.uint64(64) + np.minimum(words.end - words.start, 40).astype(np.uint64) + np.uint64(1 << 25)
    yield words.doc, (shape * arrays.BASE >> np.uint64(64 - BITS)).astype(np.int64)


def _z(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, weights[SIZE])
    for doc, feature in _grams(data, offsets):
        total = np.bincount(doc, weights=weights[feature], minlength=len(out))
        out += SCALE * total / np.maximum(np.bincount(doc, minlength=len(out)), 1)
    return out


def _parts(batch):
    data, offsets = arrays.string_buffer(batch.column("text"))
    for a, b in arrays.slices(offsets, SLICE):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _vote(stream):
    for batch in stream:
        codes = [pattern(votes(data, at)) for _, _, data, at in _parts(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(np.concatenate([*codes, np.zeros(0, np.int64)]), pa.int64())], ["id", "pattern"])


def _gradients(weights, posterior):
    def run(stream):
        total = np.zeros(SIZE + 1)
        for batch in stream:
            truth = np.array([posterior.value[c] for c in batch.column("pattern").to_pylist()])
            for a, b, data, at in _parts(batch):
                miss = truth[a:b] - 1 / (1 + np.exp(-np.clip(_z(weights.value, data, at), -30, 30)))
                total[SIZE] += miss.sum()
                for doc, feature in _grams(data, at):
                    count = np.maximum(np.bincount(doc, minlength=b - a), 1)
                    total[:SIZE] += np.bincount(feature, weights=(SCALE * miss / count)[doc], minlength=SIZE)
        yield _one_row(total)

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TRAIN_DOCS):
    """Posteriors of the vote patterns over all documents, and scorer weights from at most `sample`
    documents, chosen by the hash of their id. The driver gets one row per vote pattern (at most 3 to
    the number of labellers) and one weight vector per task of the sample."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    voted = stored(source.mapInArrow(_vote, "id bigint, pattern bigint"), "votes")
    rows = voted.groupBy("pattern").count().orderBy("pattern").collect()
    patterns, counts = np.array([r["pattern"] for r in rows], np.int64), np.array([r["count"] for r in rows], float)
    p = label_model(patterns, counts, len(LABELLERS)) if len(rows) else np.zeros(0)
    posterior = dict(zip(patterns.tolist(), p.tolist()))
    weights = np.zeros(SIZE + 1)
    if posterior:
        ids = voted.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).dropDuplicates(["id"])
        # The broadcast side has at most `sample` rows.
        chosen = stored(source.join(F.broadcast(ids), "id").select("text", "pattern").repartition(16), "sample")
        known, squares = spark.sparkContext.broadcast(posterior), np.full(SIZE + 1, 1e-8)
        for _ in range(STEPS):
            gradient = _summed(chosen, _gradients(spark.sparkContext.broadcast(weights), known))
            squares += gradient**2
            weights = weights + RATE * gradient / np.sqrt(squares)
    return posterior, weights


def _score(model):
    def run(stream):
        posterior, weights = model.value
        for batch in stream:
            score, code = [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, data, at in _parts(batch):
                z = 1 / (1 + np.exp(-np.clip(_z(weights, data, at), -30, 30)))
                blank = _share(arrays.IS_SPACE[data], at) * np.diff(at) == np.diff(at)
                score.append(np.where(blank, 0.0, z))
                code.append(pattern(votes(data, at)))
            weak = [posterior.get(c, 0.5) for c in np.concatenate(code).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate(score)), pa.array(weak, pa.float64())], ["id", "score", "posterior"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score (0 to 1, higher is better), posterior of the label model, good (score >= 0.5).

    Null and blank texts score 0. Rows are independent: repeated rows and null ids are kept. Other
    columns are ignored; an empty table gives no rows."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    run = _score(docs.sparkSession.sparkContext.broadcast(model))
    return source.mapInArrow(run, "id bigint, score double, posterior double").select(
        F.col("id").alias(id_col), "score", "posterior", (F.col("score") >= 0.5).alias("good"))

