"""Registered queries and their SQL counterparts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given Parquet tables of one scale factor, read on access."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, query: str, *names: str) -> DataFrame:
        return self.spark.sql(query, **{name: getattr(self, name) for name in names})


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of the tables under its name, with its SQL text when there is one."""

    def register(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(Tables(spark, folder))

        QUERIES[key] = run
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register
