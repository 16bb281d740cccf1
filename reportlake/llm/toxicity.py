"""Toxic spans and scores by a linear-chain conditional random field.

Tokens are runs of letters. Documents carry labels, tokens do not: in a toxic document the tokens
whose words are most over-frequent in toxic documents, compared with its other tokens, count as
labelled toxic (other words only travel with them, as in copies). The field has two states, weights
for hashed words and word beginnings (inflected forms share them), and transitions; it is trained by
gradients from
forward-backward marginals, one Spark pass over the stored sample per step. A document's score is a
logistic function of its marginals; runs of tokens of high marginal are its offending spans."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays
from reportlake.llm.work import Sent, first_of_each, stored

BITS = 18
SIZE = 1 << BITS
#: Features of a token: its whole word, and its first bytes.
BEGINNINGS = (4, 5)
#: The most training documents per label, chosen by the hash of their id.
TRAIN_PER_LABEL = 2000
STEPS = 12
RATE = 0.8
SHRINK = 1e-3
LEAST_DOCS = 3
LEAST_RATIO = np.log(6.0)
#: Words this much below the most over-frequent word of their document are not labelled.
BELOW_BEST = 1.2
LIMIT = 12.0
THRESHOLD = 0.3
SPAN_LEAST = 0.5

# Letters: ASCII letters and every byte of longer UTF-8 sequences.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


def chain(a: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_(t-1) a_t, each scaled to sum 1. a has shape (4, n): a00, a01, a10, a11.

    The chain is cut into about sqrt(n) pieces: products of all pieces at once, then their start
    vectors one after another, then all pieces at once again."""
    n = a.shape[1]
    if not n:
        return np.zeros((2, 0))
    width = int(np.ceil(np.sqrt(n)))
    rows = -(-n // width)
    full = np.zeros((4, rows * width))
    full[0] = full[3] = 1.0
    full[:, :n] = a
    full = np.ascontiguousarray(full.reshape(4, rows, width).transpose(0, 2, 1))
    p = full[:, 0].copy()
    for k in range(1, width):
        f = full[:, k]
        p = np.stack([p[0] * f[0] + p[1] * f[2], p[0] * f[1] + p[1] * f[3], p[2] * f[0] + p[3] * f[2], p[2] * f[1] + p[3] * f[3]])
        p /= p.sum(axis=0)
    begin = np.empty((2, rows))
    x, y = start
    for r, (p00, p01, p10, p11) in enumerate(p.T.tolist()):
        begin[:, r] = x, y
        x, y = x * p00 + y * p10, x * p01 + y * p11
        x, y = x / (x + y), y / (x + y)
    out = np.empty((2, width, rows))
    v0, v1 = begin
    for k in range(width):
        f = full[:, k]
        v0, v1 = v0 * f[0] + v1 * f[2], v0 * f[1] + v1 * f[3]
        total = v0 + v1
        v0, v1 = v0 / total, v1 / total
        out[0, k], out[1, k] = v0, v1
    return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]


class Field:
    """Word weights of the toxic state, transition and start scores, document calibration."""

    def __init__(self) -> None:
        self.weights = np.zeros(SIZE)
        self.moves = np.array([0.0, -2.0, 0.0, -1.0])
        self.start = np.array([0.0, -2.0])
        self.document = np.array([-LIMIT, 0.0, 0.0])

    def messages(self, feature: np.ndarray, first: np.ndarray):
        """Marginal of the toxic state, transfer matrices, forward and backward messages of tokens;
        `first` marks the first token of each document."""
        emit = np.exp(np.clip(self.weights[feature].sum(axis=0), -LIMIT, LIMIT))
        a = np.exp(self.moves)[:, None] * np.stack([np.ones_like(emit), emit, np.ones_like(emit), emit])
        a[0, first] = a[2, first] = np.exp(self.start[0])
        a[1, first] = a[3, first] = np.exp(self.start[1]) * emit[first]
        forward = chain(a, np.array([0.5, 0.5]))
        back = np.concatenate([np.array([[1.0], [0.0], [0.0], [1.0]]), a[:, :0:-1][[0, 2, 1, 3]]], axis=1)
        backward = chain(back, np.array([0.5, 0.5]))[:, ::-1]
        both = forward * backward
        return both[1] / both.sum(axis=0), a, forward, backward

    def gradient(self, feature: np.ndarray, first: np.ndarray, truth: np.ndarray):
        p, a, forward, backward = self.messages(feature, first)
        words = sum(np.bincount(row, weights=truth - p, minlength=SIZE) for row in feature)
        later = np.flatnonzero(~first)
        pair = np.stack([forward[i][later - 1] * a[2 * i + j][later] * backward[j][later] for i in (0, 1) for j in (0, 1)])
        seen = np.bincount(2 * truth[later - 1] + truth[later], minlength=4)
        moves = seen - (pair / pair.sum(axis=0)).sum(axis=1)
        start = np.bincount(truth[first], minlength=2) - np.array([(1 - p[first]).sum(), p[first].sum()])
        return np.concatenate([words, moves, start])

    def features(self, p: np.ndarray, tokens: arrays.Words) -> np.ndarray:
        """Per document: log odds of the largest marginal and log of the expected toxic tokens."""
        largest, total = np.full(len(tokens.count), 1e-6), np.zeros(len(tokens.count))
        some = np.flatnonzero(tokens.count)
        if len(some):
            largest[some] = np.clip(np.maximum.reduceat(p, tokens.first[some]), 1e-6, 1 - 1e-6)
            total[some] = np.add.reduceat(p, tokens.first[some])
        return np.stack([np.ones_like(total), np.log(largest / (1 - largest)), np.log1p(total)], axis=1)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.document, -30, 30)))


def _tokens(column):
    data, offsets = arrays.string_buffer(column)
    for a, b in arrays.slices(offsets):
        tokens = arrays.Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], NO_LETTER)
        codes = arrays.LOWER_CODE[tokens.data]
        ends = [tokens.end, *(np.minimum(tokens.start + k, tokens.end) for k in BEGINNINGS)]
        feature = np.stack([
            arrays.mix(arrays.span_hashes(codes, tokens.start, end) + np.uint64(k)) >> np.uint64(64 - BITS)
            for k, end in enumerate(ends)
        ]).astype(np.int64)
        first = np.zeros(feature.shape[1], bool)
        first[tokens.first[:-1][tokens.count > 0]] = True
        yield a, b, tokens, feature, first


def _one_row(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.astype("<f4").tobytes()], pa.binary())], ["v"])


def _summed(df: DataFrame, run) -> np.ndarray:
    """Sum of one vector per task; the stored sample has a fixed number of tasks."""
    rows = df.mapInArrow(run, "v binary").collect()
    return sum((np.frombuffer(r["v"], "<f4").astype(float) for r in rows), np.zeros(1))


def _document_counts(stream):
    total = np.zeros((2, SIZE + 1))
    for batch in stream:
        label = np.asarray(batch.column("label"))
        for a, b, tokens, feature, _ in _tokens(batch.column("text")):
            for row in feature:
                own = np.unique(tokens.doc * SIZE + row)
                np.add.at(total, (label[a:b][own // SIZE], own % SIZE), 1)
            total[:, SIZE] += np.bincount(label[a:b], minlength=2)
    yield _one_row(total.ravel())


def truths(ratio: np.ndarray, feature: np.ndarray, toxic: np.ndarray, tokens: arrays.Words) -> np.ndarray:
    """Token labels from document labels; `ratio` is -inf for words that never count."""
    value = np.where(toxic[tokens.doc], ratio[feature].max(axis=0), -np.inf)
    best = np.full(len(tokens.count), np.inf)
    some = np.flatnonzero(tokens.count)
    best[some] = np.maximum.reduceat(value, tokens.first[some])
    return ((value > -np.inf) & (value >= best[tokens.doc] - BELOW_BEST)).astype(np.int64)


def _gradients(field, ratio):
    def run(stream):
        total = np.zeros(SIZE + 6)
        for batch in stream:
            label = np.asarray(batch.column("label"))
            for a, b, tokens, feature, first in _tokens(batch.column("text")):
                if feature.size:
                    truth = truths(ratio.value, feature, label[a:b] == 1, tokens)
                    total += field.value.gradient(feature, first, truth)
        yield _one_row(total)

    return run


def _document_features(field):
    def run(stream):
        for batch in stream:
            label = np.asarray(batch.column("label"))
            for a, b, tokens, feature, first in _tokens(batch.column("text")):
                p = field.value.messages(feature, first)[0]
                rows = np.column_stack([label[a:b], field.value.features(p, tokens)])
                yield _one_row(rows.ravel())

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        push = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        beta = beta + np.clip(np.linalg.solve(curve, push), -2, 2)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = TRAIN_PER_LABEL) -> Field:
    """Train on at most `per_label` documents of each label (1 toxic, 0 not; others are left out) of
    `labels`, which names documents by the same id. Without both labels every score is near 0."""
    spark = docs.sparkSession
    rows = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = first_of_each(rows, "label", per_label).select("id", "label").dropDuplicates(["id"])
    rates = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    field = Field()
    if len(rates) < 2:
        return field
    # The broadcast side has at most 2 * per_label rows.
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = stored(source.join(F.broadcast(chosen), "id").select("text", "label").repartition(16), "sample")
    counts = _summed(sample, _document_counts).reshape(2, SIZE + 1)
    docs = counts[:, SIZE]
    ratio = np.log((counts[1, :SIZE] + 0.5) / (docs[1] + 1)) - np.log((counts[0, :SIZE] + 0.5) / (docs[0] + 1))
    counted = (ratio > LEAST_RATIO) & (counts[1, :SIZE] >= LEAST_DOCS)
    known = spark.sparkContext.broadcast(np.where(counted, ratio, -np.inf).astype(np.float32))
    field.weights = np.where(counted, 0.0, -1.0)
    squares = np.full(SIZE + 6, 1e-8)
    for _ in range(STEPS):
        gradient = _summed(sample, _gradients(Sent(spark, field), known))
        gradient[:SIZE] -= SHRINK * field.weights
        squares += gradient**2
        step = RATE * gradient / np.sqrt(squares)
        field.weights = field.weights + step[:SIZE]
        field.moves, field.start = field.moves + step[SIZE:SIZE + 4], field.start + step[SIZE + 4:]
    rows = sample.mapInArrow(_document_features(Sent(spark, field)), "v binary").collect()
    table = np.concatenate([np.frombuffer(r["v"], "<f4").astype(float).reshape(-1, 4) for r in rows])
    label = table[:, 0]
    true_share = np.array([rates[0], rates[1]], float)
    weight = (true_share / np.maximum(np.bincount(label.astype(int), minlength=2), 1))[label.astype(int)]
    field.document = logistic(table[:, 1:], label, weight * len(label) / weight.sum())
    return field


def _score(field):
    def run(stream):
        for batch in stream:
            names = [n for n in batch.schema.names if n != "text"]
            for a, b, tokens, feature, first in _tokens(batch.column("text")):
                p = field.value.messages(feature, first)[0]
                score = field.value.scores(field.value.features(p, tokens))
                spans = [[] for _ in range(b - a)]
                hot = np.flatnonzero(p >= SPAN_LEAST)
                new = np.r_[True, (np.diff(hot) > 1) | (tokens.doc[hot[1:]] != tokens.doc[hot[:-1]])][: len(hot)]
                heads = np.flatnonzero(new)
                chars = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
                for k, last in zip(heads, [*heads[1:], len(hot)] if len(heads) else []):
                    t, u = hot[k], hot[last - 1]
                    begin = chars[tokens.offsets[tokens.doc[t]]]
                    spans[tokens.doc[t]].append({
                        "start": int(chars[tokens.start[t]] - begin), "end": int(chars[tokens.end[u]] - begin), "p": float(p[t:u + 1].max())})
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(score), pa.array(spans, kind)], [*names, "score", "spans"])

    return run


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, score (0 to 1) and offending `spans` (start, end in code points, p) of every row, from its
    text alone. Null and empty texts score as texts without words. Rows are independent: repeated
    rows and null ids are kept. Other columns are ignored."""
    source = docs.select(id_col, F.col(text_col).alias("text"))
    run = _score(Sent(docs.sparkSession, field))
    return source.mapInArrow(
        run, f"`{id_col}` {source.dtypes[0][1]}, score double, spans array<struct<start:int,end:int,p:double>>")
