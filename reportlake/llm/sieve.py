"""A one-hash Bloom filter of fixed size over 64-bit keys: a broadcast with a hard bound.

It only saves a shuffle: rows it passes are always joined exactly afterwards, so an overfull
filter costs time and never changes a result."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reportlake.llm.work import lean

BITS = 1 << 24


def build(df: DataFrame, column: str) -> np.ndarray:
    """The filter of a bigint column. At most BITS / 64 rows reach the driver, whatever the input."""
    at = F.col(column).bitwiseAND(BITS - 1)
    rows = (
        df.select(at.alias("at")).where("at is not null")
        .groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def test(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def split(docs: DataFrame, listed: DataFrame, id_col: str, mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` that `listed`, a stored table, does not name, and those that it names. Rows that
    the filter clears stay where they are; only the few others are shuffled and compared exactly.

    A row is named by its id, and a null id is in no table. With `mark`, it is named by its id, which
    may be null, and by the value of that expression, the column `mark` of the table."""
    bits = docs.sparkSession.sparkContext.broadcast(build(listed, id_col))
    nulls = mark is not None

    def part(hit: bool):
        def run(stream):
            for batch in stream:
                ids = batch.column(id_col).cast(pa.int64())
                valid = np.asarray(ids.is_valid())
                maybe = test(bits.value, np.asarray(ids.fill_null(0))) & valid | (nulls & ~valid)
                yield batch.filter(pa.array(maybe == hit))

        return docs.mapInArrow(lean(run), docs.schema)

    names = listed.select(F.col(id_col).alias("__id"), *([F.col("mark").alias("__named")] if nulls else []))
    same = F.col(id_col).eqNullSafe(F.col("__id")) if nulls else F.col(id_col) == F.col("__id")
    hits = part(True)
    if nulls:
        hits, same = hits.withColumn("__mark", mark), same & (F.col("__mark") == F.col("__named"))
    out = part(False).unionAll(hits.join(names, same, "left_anti").select(*docs.columns))
    return out, hits.join(names, same, "left_semi").select(*docs.columns)


def without(docs: DataFrame, gone: DataFrame, id_col: str, mark: Column | None = None) -> DataFrame:
    """The rows of `docs` that are not in `gone`, with all columns."""
    return split(docs, gone, id_col, mark)[0]
