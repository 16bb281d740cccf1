"""Running values over an integer order, safe for groups of any size.

A plain window puts a whole group into one task. Here a group is cut into tiles of consecutive
order values: windows run inside tiles, one summary row per tile is combined over the group, and
the value carried into each tile is joined back. Rows that were `tiled` before keep their tiles, and
steps that follow on the same tiles find them in place."""

from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = 50_000


def tiled(df: DataFrame, order: str, tile: int = TILE) -> DataFrame:
    """Rows with their `_tile`; such rows stay as they are."""
    return df if "_tile" in df.columns else df.withColumn("_tile", F.floor(F.col(order) / tile).cast("bigint"))


def _windows(group: list[str], order: str):
    inside = (
        Window.partitionBy(*group, "_tile")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_tile")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return inside, earlier


def last_values(
    df: DataFrame, group: list[str], order: str, values: dict[str, Column], tile: int = TILE
) -> DataFrame:
    """Add for each name the latest non-null value up to and including the row."""
    inside, earlier = _windows(group, order)
    source = tiled(df, order, tile).withColumns({f"_v_{n}": v for n, v in values.items()})
    local = source.withColumns(
        {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}
    )
    ends = source.groupBy(*group, "_tile").agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(n)
            for n in values
        ]
    )
    carried = ends.select(
        *group,
        "_tile",
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values],
    )
    joined = local.join(carried, [*group, "_tile"], "left")
    result = joined.withColumns({n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in values})
    return result.drop(*{"_tile"} - set(df.columns), *[f"_{k}_{n}" for k in "vlc" for n in values])


def running_sum(
    df: DataFrame, group: list[str], order: str, values: dict[str, Column], tile: int = TILE
) -> DataFrame:
    """Add for each name the sum up to and including the row."""
    inside, earlier = _windows(group, order)
    source = tiled(df, order, tile).withColumns({f"_v_{n}": v for n, v in values.items()})
    local = source.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    ends = source.groupBy(*group, "_tile").agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    carried = ends.select(
        *group, "_tile", *[F.sum(n).over(earlier).alias(f"_c_{n}") for n in values]
    )
    joined = local.join(carried, [*group, "_tile"], "left")
    result = joined.withColumns(
        {
            n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
            for n in values
        }
    )
    return result.drop(*{"_tile"} - set(df.columns), *[f"_{k}_{n}" for k in "vlc" for n in values])


def renumber(
    df: DataFrame, group: list[str], order: str, name: str, tile: int = TILE
) -> DataFrame:
    """Add the zero-based position of the row in its group, by unique order values."""
    counted = running_sum(df, group, order, {name: F.lit(1)}, tile)
    return counted.withColumn(name, F.col(name) - 1)
