from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillscope import operators as op
from tillscope.operators.ntile import ROW_BITS
from tillscope.sources import intermediate_tables, written_table


@pytest.fixture
def scattered(spark):
    """Sorted tables keep all their partitions, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def expected_tiles(size, k):
    """Tile sizes of NTILE: the larger tiles come first."""
    sizes = [size // k + (i < size % k) for i in range(k)]
    return [tile for tile, n in enumerate(sizes, start=1) for _ in range(n)]


def tiles_of(df):
    return {r.user_id: r.tile for r in df.collect()}


@pytest.mark.parametrize(("rows", "k"), [(7, 5), (3, 5), (1, 5), (10, 10), (9, 1)])
def test_tile_sizes(scattered, rows, k):
    df = scattered.range(rows).select(F.col("id").alias("user_id"))
    tiled = op.add_ntile(df, k, [], "user_id")
    assert [t for _, t in sorted(tiles_of(tiled).items())] == expected_tiles(rows, k)


def test_no_rows(spark):
    df = spark.range(0).select(F.col("id").alias("user_id"))
    assert op.add_ntile(df, 5, [F.col("user_id")], "user_id").collect() == []


@pytest.mark.parametrize("kind", ["even", "ties", "third", "nulls"])
@pytest.mark.parametrize("k", [1, 5, 100, 2000])
def test_same_as_the_window_function(scattered, kind, k):
    pick = random.Random(k)
    values = {
        "even": lambda: pick.random(),
        "ties": lambda: float(pick.randint(1, 4)),
        "third": lambda: 1.0 if pick.random() < 0.34 else pick.random() * 2,
        "nulls": lambda: None if pick.random() < 0.2 else pick.random(),
    }[kind]
    rows = [(i, values()) for i in range(1200)]
    pick.shuffle(rows)
    df = scattered.createDataFrame(rows, "user_id long, v double").repartition(5)
    up = [F.col("v").asc_nulls_last(), F.col("user_id")]
    plain = df.withColumn("tile", F.ntile(k).over(Window.orderBy(*up)).cast("long"))
    ours = op.add_ntile(df, k, [F.col("v")], "user_id")
    assert tiles_of(ours) == tiles_of(plain)
    down = [F.col("v").desc_nulls_first(), F.col("user_id")]
    plain = df.withColumn("tile", F.ntile(k).over(Window.orderBy(*down)).cast("long"))
    keys = [F.col("v").isNotNull(), -F.col("v")]
    assert tiles_of(op.add_ntile(df, k, keys, "user_id")) == tiles_of(plain)


@pytest.mark.parametrize("partitions", ["1", "2", "50", "400"])
def test_the_number_of_partitions_does_not_matter(scattered, partitions):
    scattered.conf.set("spark.sql.shuffle.partitions", partitions)
    df = scattered.range(300).select(F.col("id").alias("user_id"), (F.col("id") % 3).alias("v"))
    tiled = tiles_of(op.add_ntile(df, 7, [F.col("v")], "user_id"))
    order = sorted(range(300), key=lambda i: (i % 3, i))
    assert [tiled[i] for i in order] == expected_tiles(300, 7)


def test_text_ties(scattered):
    df = scattered.range(100).select(F.concat(F.lit("u"), F.col("id")).alias("user_id"))
    tiled = tiles_of(op.add_ntile(df, 9, [F.lit(1)], "user_id"))
    assert [t for _, t in sorted(tiled.items())] == expected_tiles(100, 9)


def test_a_value_shared_by_a_third_of_the_rows_is_cut(scattered):
    rows = [(i, 1.0 if i < 2000 else float(i)) for i in range(6000)]
    df = scattered.createDataFrame(rows, "user_id long, v double")
    ordered = df.orderBy("v", "user_id").withColumn("id", F.monotonically_increasing_id())
    sizes = written_table(ordered, "cut").groupBy(F.shiftright("id", ROW_BITS)).count().collect()
    assert len(sizes) == 7
    assert max(r["count"] for r in sizes) < 2 * 6000 / 7


def test_traits(lines):
    sales = lines(
        [(1, 1, "A", "2016-01-01", 1, 10), (1, 1, "B", "2016-01-01", 1, 20), (1, 2, "A", "2016-01-31", 1, 30),
         (2, 3, "A", "2016-03-01", 1, 5)]
    )
    found = {r.user_id: tuple(r)[1:] for r in op.user_traits(sales).collect()}
    assert found == {1: (30.0, 30, 1.0), 2: (5.0, 0, 0.5)}


def test_traits_of_one_day(lines):
    row, = op.user_traits(lines([(1, 1, "A", "2016-01-01", 1, 10)])).collect()
    assert tuple(row) == (1, 10.0, 0, None)


def test_traits_without_sales(lines):
    assert op.user_traits(lines([])).collect() == []


def test_traits_of_an_audience_use_the_dates_of_all_sales(lines, spark):
    sales = lines([(1, 1, "A", "2016-01-01"), (2, 2, "A", "2016-01-31"), (2, 3, "A", "2016-03-01")])
    audience = spark.createDataFrame([(1,), (1,), (9,)], "user_id long")
    found = {r.user_id: tuple(r)[1:] for r in op.user_traits(sales, audience).collect()}
    assert found == {1: (10.0, 60, 0.5), 9: (None, None, 0.0)}
    given = op.user_traits(sales, audience, max_date=date(2016, 1, 11), span_days=300)
    assert given.filter("user_id = 1").first().activity == 10
    assert given.filter("user_id = 1").first().frequency == pytest.approx(0.1)


def test_traits_view_has_comments(lines, spark):
    traits = op.user_traits(lines([(1, 1, "A", "2016-01-01")]))
    op.register_users_trait(traits, "traits_probe")
    assert spark.table("traits_probe").schema["activity"].metadata["comment"]


def test_first_order_ignores_the_status(lines, spark):
    orders = lines([(1, 1, "A", "2016-01-01", 1, 1, "Open"), (1, 2, "A", "2016-02-01"), (2, 3, "A", "2016-03-01")])
    assert {(r.user_id, str(r.min_date)) for r in op.user_min_order_date(orders).collect()} == {
        (1, "2016-01-01"), (2, "2016-03-01")
    }
    within = spark.createDataFrame([(2,), (2,)], "user_id long")
    assert [r.user_id for r in op.user_min_order_date(orders, within).collect()] == [2]


def test_equal_counts(traits, tuples):
    groups = tuples(op.equal_count_groups(traits([7, 6, 5, 4, 3, 2, 1]), "order_avg"))
    assert [(r[0], r[-1]) for r in groups] == [
        ("1.00-2.00", 2), ("3.00-4.00", 2), ("5.00-5.00", 1), ("6.00-6.00", 1), ("7.00-7.00", 1)
    ]


def test_inner_edges_count_twice(traits):
    values = [0, 20, 40, 60, 80, 99.9999]
    groups = op.equal_width_groups(traits(values), "order_avg").collect()
    assert [(r.range, r["count"]) for r in groups] == [
        ("0.00-20.00", 2), ("20.00-40.00", 2), ("40.00-60.00", 2), ("60.00-80.00", 2), ("80.00-100.00", 2)
    ]
    half_open = op.equal_width_groups(traits(values), "order_avg", both_edges=False).collect()
    assert [r["count"] for r in half_open] == [1, 1, 1, 1, 2]


def test_empty_ranges_count_one_or_zero(traits):
    skewed = traits([0, 0, 100], "activity")
    assert [r["count"] for r in op.equal_width_groups(skewed, "activity").collect()] == [2, 1, 1, 1, 1]
    groups = op.equal_width_groups(skewed, "activity", empty_as_zero=True).collect()
    assert [r["count"] for r in groups] == [2, 0, 0, 0, 1]
    assert [r.order_avg_avg for r in groups] == [1.0, None, None, None, 1.0]


def test_trimmed_sides_become_rows(traits):
    values = [10.0] * 50 + [11.0] * 50 + [1000.0, -1000.0]
    groups = op.equal_width_groups(traits(values), "order_avg", trim_sigma=3).collect()
    assert [(r.range, r["count"]) for r in (groups[0], groups[-1])] == [
        ("-1000.00--1000.00", 1), ("1000.00-1000.00", 1)
    ]
    assert [r["count"] for r in groups[1:-1]] == [50, 1, 1, 1, 50]


def test_lower_edge_can_be_given(traits):
    groups = op.equal_width_groups(traits([10, 20]), "order_avg", k=2, lower=0.0).collect()
    assert [r.range for r in groups] == ["0.00-10.00", "10.00-20.00"]


def test_values_below_the_lower_edge_are_a_row_of_their_own(traits):
    groups = op.equal_width_groups(traits([-5, 0, 10, 20]), "order_avg", k=2, lower=0.0).collect()
    assert [(r.range, r["count"]) for r in groups] == [("-5.00--5.00", 1), ("0.00-10.00", 2), ("10.00-20.00", 1)]


def test_unknown_trait_has_no_ranges(traits):
    assert op.equal_width_groups(traits([None, None], "frequency"), "frequency").collect() == []


def test_percentile_curve_against_brute_force(spark):
    pick = random.Random(3)
    rows = [(i, pick.random() * 100, pick.randint(0, 30), float(pick.randint(1, 3))) for i in range(530)]
    rows.append((999, 5.0, 3, None))
    df = spark.createDataFrame(rows, "user_id long, order_avg double, activity int, frequency double")
    curve = op.trait_percentile_curve(df, k=20).collect()
    known = rows[:-1]
    tiles = expected_tiles(len(known), 20)

    def means(position, reverse):
        ordered = sorted((r[position] for r in known), reverse=reverse)
        groups = {}
        for tile, value in zip(tiles, ordered):
            groups.setdefault(tile, []).append(value)
        return [pytest.approx(sum(g) / len(g)) for _, g in sorted(groups.items())]

    assert [r.ntile for r in curve] == list(range(1, 21))
    assert [r.order_avg_avg for r in curve] == means(1, True)
    assert [r.activity_avg for r in curve] == means(2, False)
    assert [r.frequency_avg for r in curve] == means(3, True)
    assert sum(r["count"] for r in curve) == 530


@pytest.mark.parametrize("rows, k", [(0, 3), (1, 3), (2, 5), (7, 7), (100, 9), (101, 10)])
def test_percentile_curve_of_ties_and_few_customers(spark, monkeypatch, rows, k):
    monkeypatch.setattr("tillscope.operators.ntile.RUN_ROWS", 3)
    pick = random.Random(rows)
    traits = [(i, float(pick.randint(1, 4)), pick.randint(0, 2), float(pick.randint(1, 30))) for i in range(rows)]
    df = spark.createDataFrame(traits, "user_id long, order_avg double, activity int, frequency double")
    curve = op.trait_percentile_curve(df, k=k).collect()
    tiles = expected_tiles(rows, k)
    assert [r.ntile for r in curve] == sorted(set(tiles))
    for position, reverse, name in ((1, True, "order_avg_avg"), (2, False, "activity_avg"), (3, True, "frequency_avg")):
        ordered = sorted((t[position] for t in traits), reverse=reverse)
        for r in curve:
            own = [v for t, v in zip(tiles, ordered) if t == r.ntile]
            assert r[name] == pytest.approx(sum(own) / len(own)) and r["count"] == len(own)


def test_percentile_curve_sorts_values_and_not_customers(spark):
    """Few days of silence and few frequencies: their rows in the sort are as few."""
    rows = [(i, float(i), i % 5, float(i % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "user_id long, order_avg double, activity int, frequency double")
    with intermediate_tables(spark) as paths:
        op.trait_percentile_curve(df).collect()
        stored = spark.read.parquet(paths[0]).groupBy("no").count().collect()
    assert {r.no: r["count"] for r in stored} == {0: 3000, 1: 5, 2: 3}
