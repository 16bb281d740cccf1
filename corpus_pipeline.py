"""The training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. Every stage judges all that its predecessor kept."""

import functools

from pyspark.sql import DataFrame, SparkSession

from reportlake.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from reportlake.llm.plans import TOKENIZER, table
from reportlake.llm.work import held_out, settled, stored


#: Where the session does not say: bytes of the rows that go to a Python worker at once, and rows
#: that the Parquet reader holds at once.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def small_batches(stage):
    """A stage whose texts travel in small batches: a batch lies in the executor and in its worker at the
    same time, and what one stage took the next one finds taken."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, size in SMALL.items():
            if name not in spark.conf.getAll:
                spark.conf.set(name, size)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without text or letters go."""
    model = settled(spark, lambda: langid.fit(docs.where(~held_out("doc_id")), "doc_id", "text", "lang"))
    return langid.keep(docs, model)


@small_batches
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last of equal documents."""
    return exact_dedup.drop_copies(docs)


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by shingles of five words."""
    return near_dedup.drop_near_copies(docs)


@small_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode(docs, TOKENIZER, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The classifier of the first stage and the tokenizer of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
