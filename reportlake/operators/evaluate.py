"""Retrieval metrics per query and on average."""

from pyspark.sql import DataFrame, functions as F


def retrieval_metrics(retrieved: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """retrieved (query_id, item, rank), expected (query_id, item) -> one row per query.

    Every query of either side is reported; without expected items all metrics are 0."""
    truth = expected.select("query_id", "item").distinct().withColumn("relevant", F.lit(1))
    needed = truth.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    top = F.col("rank") <= k
    hit = F.col("relevant").isNotNull()
    lists = (
        retrieved.join(truth, ["query_id", "item"], "left")
        .groupBy("query_id")
        .agg(
            F.count_if(top).alias("n_selected"),
            F.count_distinct(F.when(top & hit, F.col("item"))).alias("n_hits"),
            F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
            F.sum(F.when(top & hit, 1 / F.log2(F.col("rank") + 1.0))).alias("gain"),
        )
    )
    both = lists.join(needed, "query_id", "full_outer").na.fill(0, ["n_selected", "n_hits", "n_expected"])
    best = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_expected", F.lit(k).cast("bigint")).cast("int"))),
        F.lit(0.0),
        lambda total, i: total + 1 / F.log2(i + 1.0),
    )
    zero = F.lit(0.0)
    return both.select(
        "query_id",
        F.when(F.col("n_hits") > 0, 1.0).otherwise(zero).alias("hit_rate"),
        F.coalesce(F.try_divide("n_hits", "n_expected"), zero).alias("recall"),
        F.coalesce(F.try_divide("n_hits", "n_selected"), zero).alias("precision"),
        F.coalesce(1.0 / F.col("first_hit"), zero).alias("mrr"),
        F.when(F.col("n_expected") > 0, F.coalesce("gain", zero) / best).otherwise(zero).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    names = ("hit_rate", "recall", "precision", "mrr", "ndcg")
    return metrics.agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n_queries"))
