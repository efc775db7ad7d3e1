"""Customers grouped by a trait: equal counts, equal widths and percentile curves."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.constants import BIN_MARGIN
from tillscope.functions import ascending, range_label
from tillscope.operators.ntile import add_ntile, add_weight_before, tile_of, tile_start
from tillscope.operators.traits import TRAITS


def equal_count_groups(traits: DataFrame, by: str, k: int = 5) -> DataFrame:
    """``k`` groups of equally many customers in the order of a trait.

    Per group: smallest and largest value, mean of the other traits, number of customers.
    """
    tiled = add_ntile(traits, k, [F.col(by)], "user_id")
    groups = tiled.groupBy("tile").agg(
        F.min(by).alias("left_range"), F.max(by).alias("right_range"), *_group_aggregates(by)
    )
    return _labelled(groups, by)


def equal_width_groups(
    traits: DataFrame,
    by: str,
    k: int = 5,
    trim_sigma: float | None = None,
    both_edges: bool = True,
    empty_as_zero: bool = False,
    lower: float | None = None,
) -> DataFrame:
    """``k`` groups of equally wide value ranges of a trait.

    ``trim_sigma`` leaves out customers further than that many standard deviations from the mean
    and appends each cut-off side as a row of its own. Neighbouring ranges share their edge, and
    a value on it counts in both, unless ``both_edges`` is off. An empty range has the count 1 that
    a right join with ``count(*)`` gives, unless ``empty_as_zero`` is on. ``lower`` replaces the
    smallest value as the start of the first range; the customers below it are a row of their own.

    Each row looks up its ranges in a small array, so the customers are aggregated map-side and
    only the groups are shuffled.
    """
    value = F.col(by).cast("double")
    low, high = _trim_limits(traits, value, trim_sigma)
    kept = traits if low is None else traits.filter(value.between(low, high))
    first, last = kept.agg(F.min(value), F.max(value)).first()
    if last is None:
        edges = [None] * (k + 1)  # no customer has the trait, so there are no ranges either
    else:
        first, last = (first if lower is None else lower), last + BIN_MARGIN
        edges = [first + (last - first) * i / float(k) for i in range(k + 1)]
    bins = F.array(
        *[
            F.struct(
                F.lit(no).alias("no"),
                F.lit(left).cast("double").alias("left_edge"),
                F.lit(right).cast("double").alias("right_edge"),
            )
            for no, (left, right) in enumerate(pairwise(edges), start=1)
        ]
    )
    floors = [x for x in (low, lower) if x is not None]
    below = F.lit(False) if not floors else value < max(floors)
    above = F.lit(False) if high is None else value > high
    group_nos = (
        F.when(below, F.array(F.lit(0)))
        .when(above, F.array(F.lit(k + 1)))
        .otherwise(F.transform(F.filter(bins, _contains(value, both_edges)), lambda b: b["no"]))
    )
    groups = (
        traits.withColumn("no", F.explode(group_nos))
        .groupBy("no")
        .agg(
            F.min(value).alias("smallest"), F.max(value).alias("largest"), *_group_aggregates(by)
        )
    )
    ranges = traits.sparkSession.range(1).select(F.inline(bins))
    is_tail = ~F.col("no").between(1, k)
    filled = (
        ranges.join(groups, "no", "full")
        .withColumn("left_range", F.when(is_tail, F.col("smallest")).otherwise(F.col("left_edge")))
        .withColumn("right_range", F.when(is_tail, F.col("largest")).otherwise(F.col("right_edge")))
        .withColumn("count", F.coalesce("count", F.lit(0 if empty_as_zero else 1)))
        .drop("no", "smallest", "largest", "left_edge", "right_edge")
        .filter(F.col("left_range").isNotNull())
    )
    return _labelled(filled.distinct() if trim_sigma is not None else filled, by)


def trait_percentile_curve(traits: DataFrame, k: int = 100) -> DataFrame:
    """Mean of each trait in its own ``k`` tiles, best customers first.

    Tile 1 holds the highest order values, the shortest silence and the highest frequency; the
    three orders are independent of each other. Customers with an unknown trait are left out of
    all three, which makes the tiles equally large.
    """
    known = traits.dropna(subset=list(TRAITS))
    best_first = {
        "order_avg": -F.col("order_avg"),
        "activity": F.col("activity"),
        "frequency": -F.col("frequency"),
    }
    # Customers of one value are alike for its curve: a row per trait and value, with their number,
    # takes the place of a row per trait and customer. Counted map-side, days of silence and numbers
    # of orders come down to few rows before anything is shuffled or sorted.
    entries = F.array(
        *[
            F.struct(
                F.lit(no).alias("no"),
                order.cast("double").alias("place"),
                F.col(trait).cast("double").alias("value"),
            )
            for no, (trait, order) in enumerate(best_first.items())
        ]
    )
    listed = known.select(F.explode(entries).alias("e")).select("e.*")
    runs = listed.groupBy("no", "place", "value").agg(F.count(F.lit(1)).alias("customers"))
    placed = add_weight_before(runs, [F.col("no"), F.col("place")], "customers", "_before", "_total")
    total = F.floor(F.col("_total") / len(TRAITS)).cast("long")
    first = F.col("_before") - F.col("no") * total
    past = first + F.col("customers")
    # A run lies in one tile or goes on over several; each takes its part of the customers.
    tiles = F.sequence(tile_of(first, total, k), tile_of(past - 1, total, k))
    shared = (
        placed.select("no", "value", total.alias("total"), first.alias("first"), past.alias("past"), F.explode(tiles).alias("ntile"))
        .withColumn(
            "rows",
            F.least("past", tile_start(F.col("ntile") + 1, F.col("total"), k))
            - F.greatest("first", tile_start(F.col("ntile"), F.col("total"), k)),
        )
    )
    means = shared.groupBy("no", "ntile").agg(
        (F.sum(F.col("value") * F.col("rows")) / F.sum("rows")).alias("mean"), F.sum("rows").alias("rows")
    )
    curves = [
        F.max(F.when(F.col("no") == no, F.col("mean"))).alias(f"{trait}_avg")
        for no, trait in enumerate(best_first)
    ]
    by_tile = means.groupBy("ntile").agg(*curves, F.max("rows").alias("count"))
    return by_tile.select(*[f"{trait}_avg" for trait in TRAITS], "ntile", "count").orderBy("ntile")


def _group_aggregates(by: str) -> list[Column]:
    others = [t for t in TRAITS if t != by]
    return [*[F.avg(t).alias(f"{t}_avg") for t in others], F.count(F.lit(1)).alias("count")]


def _labelled(groups: DataFrame, by: str) -> DataFrame:
    left, right = F.col("left_range"), F.col("right_range")
    return groups.orderBy(*ascending("left_range", "right_range")).select(
        range_label(left, right).alias("range"),
        left.cast("decimal(10,2)").alias("left_range"),
        right.cast("decimal(10,2)").alias("right_range"),
        *[f"{t}_avg" for t in TRAITS if t != by],
        "count",
    )


def _contains(value: Column, both_edges: bool):
    def test(b: Column) -> Column:
        under = value <= b["right_edge"] if both_edges else value < b["right_edge"]
        return (value >= b["left_edge"]) & under

    return test


def _trim_limits(
    traits: DataFrame, value: Column, sigma: float | None
) -> tuple[float | None, float | None]:
    """Mean minus and plus ``sigma`` standard deviations; read once, so that every row falls on
    exactly one side of them."""
    if sigma is None:
        return None, None
    mean, deviation = traits.agg(F.avg(value), F.stddev_pop(value)).first()
    if mean is None:
        return None, None
    return mean - sigma * deviation, mean + sigma * deviation
