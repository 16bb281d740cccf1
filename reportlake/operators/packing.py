"""Greedy packing of an ordered sequence into groups, as a segmented scan.

A group that starts at a row holds all rows that end within `target` of its start; a row that opens, or
that stands alone, starts the next group. Where a group starts thus decides all groups after it. A
sequence is cut into tiles. Each tile is summed up as a table: how much of an open group comes in, and
by that how many groups start in the tile and how much of the last one goes out. The table is short,
since only rows within `target` of the tile's begin can be the first to start a group. The tables of a
sequence are folded in order, a row a tile, and every tile is then numbered on its own, so one sequence
may span any number of tasks and only tiles are ever held."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = 4096
SEPARATOR = 2


def reach(size: np.ndarray, fresh: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Where every row begins in its tile, and the first row after the group that starts at it.
    `fresh` marks rows that start a group whatever stands before."""
    begin = np.cumsum(size + SEPARATOR) - size - SEPARATOR
    at = np.arange(len(size))
    full = np.maximum(np.searchsorted(begin + size, begin + target, "right"), at + 1)
    marked = np.append(np.flatnonzero(fresh), len(size))
    return begin, np.minimum(full, marked[np.searchsorted(marked[:-1], at, "right")])


def first_start(size: np.ndarray, begin: np.ndarray, fresh: np.ndarray, room: int) -> int:
    """The first row of a tile that starts a group, where an open group has `room` left."""
    marked = np.flatnonzero(fresh)
    fits = int(np.searchsorted(begin + size, room, "right"))
    return min(fits, int(marked[0])) if len(marked) else fits


def transition(size: np.ndarray, fresh: np.ndarray, closes: bool, target: int) -> dict:
    """The table of a tile. Entry r stands for a first start at row r, which is where an open group with
    room in [limits[r - 1], limits[r]) ends: groups that start, and what is used of the last (-1: the
    open group holds the whole tile)."""
    n = len(size)
    begin, after = reach(size, fresh, target)
    total = int((size + SEPARATOR).sum())
    count, last, jump = np.append(np.ones(n, np.int64), 0), np.arange(n + 1), np.append(after, n)
    while (jump[:n] < n).any():  # doubles the groups that a step passes
        count, last, jump = count + count[jump], np.where(jump < n, last[jump], last), jump[jump]
    rows = first_start(size, begin, fresh, target)
    used = np.where(np.arange(rows + 1) < n, total - np.append(begin, 0)[last[:rows + 1]], -1)
    return {"limits": (begin + size)[:rows].tolist(), "starts": count[:rows + 1].tolist(), "used": used.tolist(),
            "total": total, "closes": closes}


def advance(groups: int, used: int | None, table: dict, target: int) -> tuple[int, int | None]:
    """Groups so far and use of the open one (None: none is open) behind a tile."""
    r = 0 if used is None else int(np.searchsorted(table["limits"], target - used, "right"))
    if used is not None and table["used"][r] < 0:
        used += table["total"]
    else:
        groups, used = groups + table["starts"][r], table["used"][r]
    return groups, None if table["closes"] else used


def numbers(groups: int, used: int | None, size: np.ndarray, fresh: np.ndarray, target: int) -> np.ndarray:
    """Group of every row of a tile."""
    begin, after = reach(size, fresh, target)
    starts = np.zeros(len(size), np.int64)
    at = 0 if used is None else first_start(size, begin, fresh, target - used)
    while at < len(size):
        starts[at] = 1
        at = int(after[at])
    return groups - 1 + np.cumsum(starts)


def runs(stream, *names: str):
    """Batches that end where a run of equal values ends, and the edges of their runs. Only the last run
    of a batch waits for the next one."""
    held = None
    for batch in stream:
        if not batch.num_rows:
            continue
        batch = batch if held is None else pa.concat_batches([held, batch])
        new = np.zeros(batch.num_rows - 1, bool)
        for name in names:
            column = batch.column(name)
            new |= np.asarray(pc.fill_null(pc.not_equal(column[1:], column[:-1]), True))
        edges = [0, *(np.flatnonzero(new) + 1).tolist()]
        if len(edges) > 1:
            yield batch.slice(0, edges[-1]), edges
        held = batch.slice(edges[-1])
    if held is not None:
        yield held, [0, held.num_rows]


def _measures(batch: pa.RecordBatch):
    size, opens, alone = (np.asarray(batch.column(c)).astype(t) for c, t in (("size", np.int64), ("opens", bool), ("alone", bool)))
    return size, opens, alone


def _fresh(opens: np.ndarray, alone: np.ndarray) -> np.ndarray:
    out = opens | alone
    out[1:] |= alone[:-1]
    return out


TABLE = "limits array<bigint>, starts array<bigint>, used array<bigint>, total bigint, closes boolean"
TABLE_TYPES = {"limits": pa.list_(pa.int64()), "starts": pa.list_(pa.int64()), "used": pa.list_(pa.int64()), "total": pa.int64(), "closes": pa.bool_()}


def _tables(target: int):
    def run(stream):
        for batch, edges in runs(stream, "key", "tile"):
            size, opens, alone = _measures(batch)
            made = [transition(size[a:b], _fresh(opens[a:b], alone[a:b]), bool(alone[b - 1]), target) for a, b in zip(edges, edges[1:])]
            first = batch.take(pa.array(edges[:-1]))
            yield pa.RecordBatch.from_arrays(
                [first.column("key"), first.column("tile"), *(pa.array([m[c] for m in made], t) for c, t in TABLE_TYPES.items())],
                ["key", "tile", *TABLE_TYPES])

    return run


def enters(used: int | None, table: dict, target: int) -> bool:
    """Whether the first row of a tile belongs to the group that comes in open."""
    return used is not None and int(np.searchsorted(table["limits"], target - used, "right")) > 0


def _fold(target: int):
    """State in front of every tile, and whether its last group goes on in the next one."""
    def run(stream):
        key, groups, used, held = None, 0, None, None
        for batch in stream:
            kinds = pa.schema([batch.schema.field("key"), ("tile", pa.int64()), ("groups", pa.int64()), ("used", pa.int64()), ("leaves", pa.bool_())])
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, groups, used = row["key"], 0, None
                if held is not None:
                    out.append(held | {"leaves": enters(used, row, target)})
                held = {"key": key, "tile": row["tile"], "groups": groups, "used": used}
                groups, used = advance(groups, used, row, target)
            yield pa.RecordBatch.from_pylist(out, kinds)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"leaves": False}], kinds)

    return run


NUMBERS = "numbers array<int>, enters boolean, leaves boolean"


def _numbered(target: int):
    """Every tile begins with its state."""
    def run(stream):
        for batch, edges in runs(stream, "key", "tile"):
            size, opens, alone = _measures(batch)
            first = batch.take(pa.array(edges[:-1]))
            states = first.select(["groups", "used", "leaves"]).to_pylist()
            made = [numbers(s["groups"], s["used"], size[a + 1:b], _fresh(opens[a + 1:b], alone[a + 1:b]), target)
                    for s, a, b in zip(states, edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [first.column("key"), first.column("tile"), pa.array(made, pa.list_(pa.int32())),
                 pa.array([int(n[0]) < s["groups"] for s, n in zip(states, made)]), first.column("leaves")],
                ["key", "tile", "numbers", "enters", "leaves"])

    return run


def numbered(measures: DataFrame, target: int) -> DataFrame:
    """(key, tile, numbers, enters, leaves): the groups of a tile's rows in their order, whether the first one
    began in a tile before, and whether the last one goes on behind.

    measures: key, tile, order, tie, size, opens, alone. No text is moved here."""
    kind, place = dict(measures.dtypes)["key"], ["order", "tie"]
    tables = _together(measures, "key", "tile").sortWithinPartitions("key", "tile", *place).mapInArrow(
        _tables(target), f"key {kind}, tile bigint, {TABLE}")
    state = tables.repartition("key").sortWithinPartitions("key", "tile").mapInArrow(
        _fold(target), f"key {kind}, tile bigint, groups bigint, used bigint, leaves boolean")
    # The state of a tile is a row before its first one; it has no order and so comes first.
    none = {c: F.lit(None).cast("bigint").alias(c) for c in ("order", "tie", "groups", "used")}
    heads = state.select(
        "key", "tile", none["order"], none["tie"], F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("opens"),
        F.lit(False).alias("alone"), "groups", "used", "leaves")
    ready = heads.unionByName(measures.select("*", none["groups"], none["used"], F.lit(False).alias("leaves")))
    return _together(ready, "key", "tile").sortWithinPartitions("key", "tile", *[F.asc_nulls_first(c) for c in place]).mapInArrow(
        _numbered(target), f"key {kind}, tile bigint, {NUMBERS}")


def measured(rows: DataFrame, size: Column, opens: Column, alone: Column) -> DataFrame:
    """What `numbered` takes, of rows with key, tile, order and tie."""
    return rows.select(
        "key", "tile", "order", "tie", size.cast("bigint").alias("size"), F.coalesce(opens, F.lit(False)).alias("opens"),
        F.coalesce(alone, F.lit(False)).alias("alone"))


def with_groups(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (key, tile, order, tie, item) with their `group`, and `split`: whether it has rows in other tiles too."""
    place = F.row_number().over(Window.partitionBy("key", "tile").orderBy("order", "tie"))
    group = F.element_at("numbers", F.col("place"))
    split = (F.col("enters") & (group == F.element_at("numbers", F.lit(1)))) | (F.col("leaves") & (group == F.element_at("numbers", F.lit(-1))))
    return rows.withColumn("place", place).join(numbers, ["key", "tile"]).select("key", "tile", "item", group.alias("group"), split.alias("split"))


def collected(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """(key, group, items) of rows like those of `with_groups`.

    Rows meet by tile, and a group inside one tile is collected where it lies; only groups that span tiles move again."""
    known = with_groups(rows, numbers)
    items = F.collect_list("item").alias("items")
    whole = known.filter(~F.col("split")).groupBy("key", "tile", "group").agg(items).drop("tile")
    return whole.unionByName(known.filter("split").groupBy("key", "group").agg(items))


def pack(rows: DataFrame, key: str, order: str, item: Column, size: Column, opens: Column, alone: Column,
         target: int, tile: int = TILE) -> DataFrame:
    """(key, group, item) of every row, groups numbered from 0 in each key's order.

    `order` is an integer, dense enough that a range of `tile` values is a fit load; rows of equal order
    follow `item`. Rows without a key or an order form no group and are left out."""
    source = rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull()).select(
        F.col(key).alias("key"), F.floor(F.col(order) / tile).cast("bigint").alias("tile"), F.col(order).cast("bigint").alias("order"),
        size.alias("size"), opens.alias("opens"), alone.alias("alone"), item.alias("item"), F.xxhash64(item).alias("tie"))
    numbers = numbered(measured(source, F.col("size"), F.col("opens"), F.col("alone")), target)
    return with_groups(source.select("key", "tile", "order", "tie", "item"), numbers).select(F.col("key").alias(key), "group", "item")


def _together(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of equal columns in one partition.

    Where a join or grouping below has placed rows by the same columns, Spark leaves a plain repartition
    out, and adaptive planning may then turn that join into one which places nothing. No step below
    places by this hash, so the shuffle stays."""
    return rows.repartition(F.xxhash64(*columns))
