"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier per bit separates the languages
whose bit is one from the others: the log ratio of the n-gram distributions of both groups, averaged
over the n-grams of a text. Decoding weighs the loss of each bit by how reliably its classifier
answered for the language on held-back training documents; the codeword of the least loss wins, and
a text whose two best codewords are close is flagged as ambiguous."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from reportlake.llm import arrays
from reportlake.llm.work import Sent, first_of_each, lean, stored

BITS = 15
SIZE = 1 << BITS
#: The most training documents per language, chosen by the hash of their id; half of them set the
#: n-gram distributions, half the reliability of the bits.
TRAIN_PER_LANGUAGE = 2000
GRAMS = (1, 2, 3)
SMOOTH = 0.5
AMBIGUOUS = 0.1
UNKNOWN = "und"
SLICE = 1 << 18

# Bytes as n-grams see them: letters in lower case, other ASCII as a space, the rest unchanged.
SEEN = np.arange(256, dtype=np.uint32)
SEEN[:128] = 32
SEEN[97:123] = SEEN[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language: all distinct columns for up to 7 languages, else the best of
    32 random codes of 10 log2(n) bits."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 7:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range((1 << n - 1) - 1)]
        return np.array(columns, float).T
    rng, best = np.random.Generator(np.random.PCG64(n)), (-1, None)
    for _ in range(32):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > best[0] and (abs(code.sum(axis=0)) < n).all():
            best = (apart, code)
    return best[1]


def grams(data: np.ndarray, offsets: np.ndarray):
    """(document, feature) of all n-grams of a slice, one order at a time; blank ones are left out."""
    seen = SEEN[data]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = np.zeros(len(seen), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = (value[: len(seen) - n + 1] << np.uint64(8)) | seen[n - 1:] if n > 1 else seen.astype(np.uint64)
        keep = doc[: len(value)] == doc[n - 1:]
        keep &= value != np.uint64(int.from_bytes(b" " * n, "big"))
        if n in GRAMS:
            hashed = ((value[keep] + np.uint64(n << 24)) * arrays.BASE) >> np.uint64(64 - BITS)
            yield doc[: len(value)][keep], hashed.astype(np.int64)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate([[0], np.cumsum((SEEN[data] != 32) & (data < 128))])
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _counts(stream):
    totals: dict[str, np.ndarray] = {}
    for batch in stream:
        data, offsets = arrays.string_buffer(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for a, b in arrays.slices(offsets, SLICE):
            names = sorted(set(langs[a:b]))
            of = np.array([names.index(x) for x in langs[a:b]], np.int64)
            own = offsets[a:b + 1] - offsets[a]
            for doc, feature in grams(data[offsets[a]:offsets[b]], own):
                both = np.bincount(of[doc] * SIZE + feature, minlength=len(names) * SIZE).reshape(-1, SIZE)
                for name, row in zip(names, both):
                    totals[name] = totals.get(name, 0) + row
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()), pa.array([t.astype("<i8").tobytes() for t in totals.values()], pa.binary())],
        ["lang", "counts"],
    )


class Model:
    """Languages, their codewords, a weight row per bit, the scale and reliability of the bits."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs))
        smooth = counts + SMOOTH
        share = smooth / smooth.sum(axis=1, keepdims=True) if len(langs) else np.zeros((0, SIZE))
        self.weights = np.zeros((SIZE, self.code.shape[1]), np.float32)
        for bit in range(self.code.shape[1]):
            one = self.code[:, bit] > 0
            self.weights[:, bit] = np.log(share[one].mean(axis=0) / share[~one].mean(axis=0))
        self.scale = np.ones(self.code.shape[1])
        self.reliable = np.ones_like(self.code)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log ratio per bit of every document."""
        total = np.zeros((len(offsets) - 1, self.weights.shape[1]))
        count = np.zeros(len(offsets) - 1)
        for doc, feature in grams(data, offsets):
            if not len(doc):
                continue
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            total[doc[first]] += np.add.reduceat(self.weights[feature], first, axis=0, dtype=np.float64)
            count += np.bincount(doc, minlength=len(count))
        return total / np.maximum(count, 1)[:, None]

    def calibrate(self, langs: list[str], margins: np.ndarray) -> None:
        """Bring margins to a common scale; measure for each language how often each bit is right."""
        if not len(langs) or not self.code.shape[1]:
            return
        self.scale = 2.0 / np.maximum(np.abs(margins).mean(axis=0), 1e-6)
        of = np.array([self.langs.index(x) for x in langs])
        for row in range(len(self.langs)):
            own = margins[of == row]
            right = (np.sign(own) == self.code[row]).sum(axis=0) + 1.0
            self.reliable[row] = right / (len(own) + 2.0)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and the lead over the second in weighted loss."""
        n = len(margins)
        if len(self.langs) == 1:
            return np.zeros(n, int), np.ones(n), np.ones(n)
        weight = self.reliable / self.reliable.sum(axis=1, keepdims=True)
        loss = np.einsum("nlb,lb->nl", np.logaddexp(0, -(margins * self.scale)[:, None, :] * self.code[None]), weight)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(n)
        likely = np.exp(-4 * (loss - loss[rows, order[:, 0]][:, None]))
        return order[:, 0], 1 / likely.sum(axis=1), loss[rows, order[:, 1]] - loss[rows, order[:, 0]]


def _margins(model):
    def run(stream):
        for batch in stream:
            data, offsets = arrays.string_buffer(batch.column("text"))
            parts = [
                model.value.margins(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                for a, b in arrays.slices(offsets, SLICE)
            ]
            rows = np.concatenate(parts) if parts else np.zeros((0, model.value.code.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(rows.tolist(), pa.list_(pa.float64()))], ["lang", "margins"]
            )

    return run


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Learn from at most `per_language` documents of each language; rows without text or language are
    left out. Only one count vector per language and task, and one short row per document of the
    bounded sample, reach the driver."""
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    chosen = first_of_each(rows, "lang", per_language).select("id", F.col("turn") % 2)
    chosen = chosen.toDF("id", "half").dropDuplicates(["id"])
    source = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    source = source.where("lang is not null and text is not null")
    # The broadcast side has at most per_language rows for each language.
    sample = stored(source.join(F.broadcast(chosen), "id").select("text", "lang", "half").repartition(16), "sample")
    counted = sample.where("half = 1").drop("half").mapInArrow(lean(_counts), "lang string, counts binary").collect()
    langs = sorted({r["lang"] for r in counted})
    counts = np.zeros((len(langs), SIZE))
    for r in counted:
        counts[langs.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    model = Model(langs, counts)
    sent = Sent(spark, model)
    held = sample.where("half = 0").drop("half").mapInArrow(lean(_margins(sent)), "lang string, margins array<double>").collect()
    held = [r for r in held if r["lang"] in langs]
    bits = model.code.shape[1]
    model.calibrate([r["lang"] for r in held], np.array([r["margins"] for r in held], float).reshape(len(held), bits))
    return model


def _predict(model):
    def run(stream):
        own = model.value
        for batch in stream:
            data, offsets = arrays.string_buffer(batch.column("text"))
            lang, score, lead = [], [], []
            for a, b in arrays.slices(offsets, SLICE):
                part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                known = has_letter(part, at) & bool(own.langs)
                if own.langs:
                    best, p, gap = own.decode(own.margins(part, at))
                else:
                    best = p = gap = np.zeros(b - a, int)
                lang += [own.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                score.append(np.where(known, p, 0.0))
                lead.append(known & (gap < AMBIGUOUS))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(lang, pa.string()),
                 pa.array(np.concatenate([*score, np.zeros(0)])), pa.array(np.concatenate([*lead, np.zeros(0, bool)]).astype(bool))],
                [*names, "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred, score (0 to 1), ambiguous of every row, from its text alone.

    A text that is null or has no letter, and any text if the model knows no language, is `und` with
    score 0. Rows are independent: repeated rows and null ids are kept. Other columns are ignored."""
    source = docs.select(id_col, F.col(text_col).alias("text"))
    run = _predict(Sent(docs.sparkSession, model))
    return source.mapInArrow(lean(run), f"`{id_col}` {source.dtypes[0][1]}, lang_pred string, score double, ambiguous boolean")


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents in a language that the model knows, with all their columns; texts that are null or
    have no letter go. Ambiguous texts stay, since a short clean one may be ambiguous. If the model knows
    no language, all texts with letters stay."""
    source = docs.withColumn("__text", F.col(text_col))
    names, any_language = docs.columns, bool(model.langs)
    run = _predict(Sent(docs.sparkSession, model))

    def known(stream):
        for batch in stream:
            plain = batch.select(["__text"]).rename_columns(["text"])
            if any_language:
                lang = next(iter(run(iter([plain])))).column("lang_pred")
                good = pa.compute.not_equal(lang, UNKNOWN)
            else:
                good = pa.array(has_letter(*arrays.string_buffer(plain.column("text"))))
            yield batch.filter(good).select(names)

    return source.mapInArrow(lean(known), docs.schema)
