"""Row numbers and NTILE over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions import ascending
from tillscope.sources import written_table

# monotonically_increasing_id() keeps the row number within a partition in the lower 33 bits.
ROW_BITS = 33
#: Neighbouring rows whose weights are added up in one window group.
RUN_ROWS = 1 << 20


def add_ntile(
    df: DataFrame, k: int, order: Sequence[Column], tie: str, name: str = "tile"
) -> DataFrame:
    """Add the number of the k equal-count tiles a row falls into, from 1.

    The rows are ordered by ``order`` (ascending, NULL last; negate a number to sort it down), then
    by ``tie``, then by the other columns, so the tiles are the same on every run even if ``tie``
    repeats: rows that still tie are equal.
    """
    rest = [
        f.name for f in df.schema.fields if f.name != tie and not isinstance(f.dataType, T.MapType)
    ]
    placed = add_position(df, [*order, F.col(tie), *[F.col(c) for c in rest]], "_position", "_total")
    tile = tile_of(F.col("_position"), F.col("_total"), k)
    return placed.select(*df.columns, tile.alias(name))


def add_position(df: DataFrame, order: Sequence[Column], position: str, total: str) -> DataFrame:
    """Add each row's number in the order (from 0; ascending, NULL last) and the number of rows.

    A plain window would send all rows to one task. Here the table is sorted the distributed way,
    by ranges of the sort key, and written once with each row's number within its partition. The
    sizes of the partitions then turn that into the position in the whole table. One value shared
    by a third of the rows is cut into several ranges if a later sort key tells its rows apart. The
    positions are read from the written table, so a task that runs again cannot shift them.
    """
    keys = {f"_k{i}": key for i, key in enumerate(order)}
    numbered = (
        df.withColumns(keys)
        .orderBy(*ascending(*keys))
        .withColumn("_id", F.monotonically_increasing_id())
        .select(*df.columns, "_id")
    )
    placed = (
        written_table(numbered, "sorted")
        .withColumn("_part", F.shiftright("_id", ROW_BITS))
        .withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    )
    # One row per partition of the sort: small enough for one task and for a broadcast.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias(total),
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_before") + F.col("_row")).alias(position), total
    )


def add_weight_before(
    df: DataFrame, order: Sequence[Column], weight: str, before: str, total: str
) -> DataFrame:
    """Add the summed weight of all rows earlier in the order, and of all rows.

    For runs of equal values with their counts this is the position of the first row of a run,
    without a row for every row behind it. The rows are sorted and written as by
    :func:`add_position`; the sums then run within the partitions of that sort, one task each.
    """
    placed = add_position(df, order, "_row", "_rows").withColumn(
        "_part", F.floor(F.col("_row") / F.lit(RUN_ROWS))
    )
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_weight"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_part",
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_weight").over(Window.partitionBy()).alias(total),
    )
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + F.col("_within")).alias(before), total)
    )


def tile_start(tile: Column, total: Column, k: int) -> Column:
    """Position of the first row of a tile, which is that of ``total`` rows behind the last one."""
    more = total % k
    size = F.floor((total - more) / k).cast("long")
    return (tile - 1) * size + F.least(tile - 1, more)


def tile_of(position: Column, total: Column, k: int) -> Column:
    """Tile of a position: the first ``total % k`` tiles hold one row more than the others."""
    more = total % k
    size = F.floor((total - more) / k).cast("long")
    in_large = more * (size + 1)
    large = F.floor(position / (size + 1))
    small = more + F.floor((position - in_large) / F.greatest(size, F.lit(1)))
    return (F.when(position < in_large, large).otherwise(small) + 1).cast("long")
