"""Connected components of links between ids, by union-find within tasks and contraction between them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportlake.llm.work import lean, stored


def _forest(stream):
    """Union-find over the links of one task: every id with the smallest id it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in stream:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = np.array([(root(x), x) for x in parent if root(x) != x], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links (a, b) but the smallest of each component, which is
    the component's name.

    Every id hooks to its smallest neighbour, chains are halved until all point to their end, and
    links between the ends remain; each round at least halves the ids that still have links."""
    edges = stored(links.where("a <> b").mapInArrow(lean(_forest), "a bigint, b bigint").distinct(), "links")
    maps = []
    while edges.take(1):
        hooks = stored(edges.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "hooks")
        while True:
            far = hooks.select(F.col("id").alias("component"), F.col("component").alias("far"))
            jumped = stored(hooks.join(far, "component", "left").select("id", F.coalesce("far", "component").alias("component"), "far"), "hooks")
            hooks = jumped.drop("far")
            if not jumped.where("far is not null").take(1):
                break
        maps.append(hooks)
        for side in ("a", "b"):
            to = hooks.select(F.col("id").alias(side), F.col("component").alias("to"))
            edges = edges.join(to, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
        edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = maps[-1]
    for earlier in maps[-2::-1]:
        to = out.select(F.col("id").alias("component"), F.col("component").alias("to"))
        out = earlier.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")).unionAll(out)
    return stored(out, "components")
