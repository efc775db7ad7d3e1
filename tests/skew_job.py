"""Run queries over tables with a hot order, customer, product and month, with an event log.

Started by ``test_skew.py`` in a process of its own: ``skew_job.py FOLDER QUERY...``. Writes the
tables and the log into the folder.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from tillscope.plans.queries import QUERIES  # noqa: E402
from tillscope.session import local_session  # noqa: E402

LINES, ORDERS = 1_500_000, 150_000


def hot(share: float, value: int, count: int, salt: int):
    """A third of the rows have one value, the others are spread over ``count``."""
    place = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1000))
    return F.when(place < int(share * 1000), F.lit(value)).otherwise(
        F.pmod(F.xxhash64(F.lit(salt + 1), "id"), F.lit(count))
    )


def write_tables(spark, folder: str) -> None:
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(2000)).cast("int"))
    spark.range(ORDERS).select(
        F.col("id").alias("o_orderkey"),
        hot(0.34, 7, 20_000, 1).alias("o_custkey"),
        F.lit("F").alias("o_orderstatus"),
        F.when(F.pmod("id", F.lit(3)) == 0, F.lit("1998-04-18").cast("date")).otherwise(day).cast("timestamp").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(LINES).select(
        hot(0.34, 3, ORDERS, 3).alias("l_orderkey"),
        hot(0.34, 5, 5_000, 5).alias("l_partkey"),
        # Values that do not compress: adaptive execution judges a partition by its bytes.
        (F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(10**6)) / 100).alias("l_quantity"),
        (F.pmod(F.xxhash64(F.lit(12), "id"), F.lit(10**8)) / 100).alias("l_extendedprice"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.range(5_000).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'ECONOMY' AS p_type", "'Brand#2' AS p_brand", "1 AS p_size"
    ).write.parquet(f"{folder}/part.parquet")
    spark.range(20_000).selectExpr(
        "id AS c_custkey", "id % 25 AS c_nationkey", "1.0D AS c_acctbal"
    ).write.parquet(f"{folder}/customer.parquet")


def main(folder: str, names: list[str]) -> None:
    Path(folder, "events").mkdir()
    spark = local_session(
        4, app="skew",
        **{
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{folder}/events",
            "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.compress": "false",
            "spark.checkpoint.dir": f"{folder}/shared",
            # A hot partition is split between map outputs, so there must be many of those.
            "spark.sql.files.maxPartitionBytes": "192k",
            "spark.sql.files.openCostInBytes": "16k",
            "spark.sql.shuffle.partitions": "40",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        },
    )
    write_tables(spark, folder)
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
