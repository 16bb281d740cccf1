import pathlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportlake.operators import blocks, chunks, distribution, ordered, packing


def plain(rows, target):
    """Groups one row after another: (size, opens, alone) in order."""
    out, group, used = [], -1, None
    for size, opens, alone in rows:
        if used is None or opens or alone or used + size > target:
            group, used = group + 1, 0
        out.append(group)
        used = None if alone else used + size + packing.SEPARATOR
    return out


def sequence(rng, n):
    return [(rng.choice([0, 0, 1, 3, rng.randint(0, 40)]), rng.random() < 0.1, rng.random() < 0.1) for _ in range(n)]


@pytest.mark.parametrize("target", [0, 1, 5, 20, 100])
def test_tiles_give_what_one_pass_gives(target):
    rng = random.Random(target)
    for _ in range(200):
        rows = sequence(rng, rng.randint(1, 60))
        tile, groups, used, got = rng.randint(1, 20), 0, None, []
        for a in range(0, len(rows), tile):
            size, opens, alone = (np.array(c) for c in zip(*rows[a:a + tile]))
            fresh = packing._fresh(opens, alone)
            got += packing.numbers(groups, used, size, fresh, target).tolist()
            table = packing.transition(size, fresh, bool(alone[-1]), target)
            assert len(table["limits"]) <= target // packing.SEPARATOR + 1
            groups, used = packing.advance(groups, used, table, target)
        assert got == plain(rows, target)


@pytest.mark.parametrize("tile", [1, 7, 4096])
def test_documents_span_tasks(spark, tile):
    rng = random.Random(tile)
    made = {f"d{d}": sequence(rng, n) for d, n in enumerate([900, 1, 40, 3])}
    rows = [(d, i, *r) for d, own in made.items() for i, r in enumerate(own)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows + [(None, 0, 1, False, False)], "doc string, at int, size int, opens boolean, alone boolean")
    packed = packing.pack(df, "doc", "at", F.struct("at"), F.col("size"), F.col("opens"), F.col("alone"), 30, tile)
    got = {(r["doc"], r["item"]["at"]): r["group"] for r in packed.collect()}
    assert got == {(d, i): g for d, own in made.items() for i, g in enumerate(plain(own, 30))}


def test_empty_and_gaps_in_the_order(spark):
    df = spark.createDataFrame([("d", 10, 5), ("d", 900, 5), ("d", 901, 5), ("d", 901, 5)], "doc string, at bigint, size int")
    arguments = "doc", "at", F.struct("at", "size"), F.col("size"), F.lit(False), F.lit(None).cast("boolean"), 14, 100
    assert sorted(r["group"] for r in packing.pack(df, *arguments).collect()) == [0, 0, 1, 1]
    assert packing.pack(df.limit(0), *arguments).count() == 0


def test_packing_behind_a_join_that_becomes_a_broadcast_at_run_time(spark):
    """Sizes are known only when the job runs: a sort-merge join is planned and replaced."""
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "500k"}
    old = {name: spark.conf.get(name, None) for name in limits}
    for name, limit in limits.items():
        spark.conf.set(name, limit)
    try:
        rows = spark.range(20_000).select(
            (F.col("id") % 2_000).cast("string").alias("doc"), F.floor(F.col("id") / 2_000).cast("int").alias("at"),
            F.sha2(F.col("id").cast("string"), 512).alias("text"))
        packed = packing.pack(rows, "doc", "at", F.struct("at", "text"), F.lit(10), F.lit(False), F.lit(False), 40)
        got = {(r["doc"], r["at"]): r["group"] for r in packed.select("doc", "item.at", "group").collect()}
    finally:
        for name, limit in old.items():
            spark.conf.unset(name) if limit is None else spark.conf.set(name, limit)
    each = plain([(10, False, False)] * 10, 40)
    assert got == {(str(d), i): g for d in range(2_000) for i, g in enumerate(each)}


def moved(spark, action) -> int:
    """Bytes that an action writes for shuffles."""
    context = spark.sparkContext
    context.setJobGroup("moved", "")
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("moved") for s in tracker.getJobInfo(j).stageIds}
    return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))


def text_blocks(spark, documents, lines, characters):
    text = F.substring(F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(-(-characters // 64))]), 1, characters)
    return spark.range(documents * lines).select(
        (F.col("id") % documents).cast("string").alias("document_id"), F.concat(F.lit("b"), F.col("id")).alias("block_id"),
        F.lit("paragraph").alias("block_type"), text.alias("text"), F.lit(1).alias("page_number"),
        F.floor(F.col("id") / documents).cast("int").alias("source_order"), F.lit(None).cast(blocks.TABLE_TYPE).alias("table"))


def listed(spark, documents, times=1):
    return spark.range(documents * times).select((F.col("id") % documents).cast("string").alias("document_id"), F.lit("legal").alias("document_type"))


@pytest.mark.parametrize("tile", [1, 3, 4096])
def test_blocks_packed_in_their_tiles(spark, tile):
    """Groups of four blocks of 300 characters, whatever the tiles; a document listed twice counts once."""
    found = blocks.propagate_structure(ordered.tiled(text_blocks(spark, 5, 30, 290), "source_order", tile), tile=tile)
    got = chunks.pack(found, listed(spark, 5, 2)).select("document_id", "group", F.transform("blocks", lambda b: b["at"]).alias("at")).collect()
    assert len(got) == 5 * 8
    assert {(r["document_id"], r["group"]): r["at"] for r in got} == {
        (str(d), g): list(range(g * 4, min(g * 4 + 4, 30))) for d in range(5) for g in range(8)}


def test_texts_move_once_from_structure_to_groups(spark):
    """Random text of 4 MB; half of it is left when compressed. It was shuffled four times."""
    source = text_blocks(spark, 500, 20, 400)
    once = moved(spark, lambda: source.repartition(4, "document_id").write.format("noop").mode("overwrite").save())
    found = blocks.propagate_structure(ordered.tiled(source, "source_order", 8), tile=8)
    packed = chunks.pack(found, listed(spark, 500))
    assert 0 < moved(spark, lambda: packed.write.format("noop").mode("overwrite").save()) < 2.5 * once


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f.name for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data")}
    old = files()
    table = distribution.materialize(spark.range(1000).repartition(4, "id"), even=False)
    for _ in range(50):
        left = files() - old
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 1000
