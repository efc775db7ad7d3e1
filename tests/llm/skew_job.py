"""Run corpus operators over tables in which one key holds a third of the rows, with an event log.

Started by ``test_skew.py`` in a process of its own: ``skew_job.py FOLDER``.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

from tillscope.llm import line_dedup, minhash  # noqa: E402
from tillscope.llm.components import components  # noqa: E402
from tillscope.session import local_session  # noqa: E402

ROWS = 60_000


def sentence(seed, count: int):
    """``count`` words that follow from a column."""
    return F.concat_ws(" ", *[F.lower(F.hex(F.xxhash64(seed, F.lit(k)))) for k in range(count)])


def passages(spark):
    """Every third document holds one passage, the next third one of many, each between own lines."""
    shared = F.when(F.pmod("id", F.lit(3)) == 0, F.lit(0)).when(F.pmod("id", F.lit(3)) == 1, 1 + F.pmod("id", F.lit(5000)))
    lines = [sentence(F.concat(F.lit("p"), shared), 26), sentence(F.concat(F.lit("q"), shared), 26)]
    text = F.concat_ws("\n", sentence(F.col("id"), 9), *lines, sentence(-F.col("id") - 1, 9))
    return spark.range(0, ROWS, numPartitions=30).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source")
    )


def hub(spark):
    """A star of a third of the edges, chains and loose pairs."""
    spread = F.pmod(F.xxhash64("id"), F.lit(ROWS)) + ROWS
    return spark.range(0, 3 * ROWS, numPartitions=30).select(
        F.when(F.col("id") < ROWS, F.lit(ROWS // 2)).otherwise(spread).alias("a"),
        F.when(F.col("id") < ROWS, F.col("id")).otherwise(F.col("id") + ROWS).alias("b"),
    )


def one_id(spark):
    """A third of the rows share their id, with texts of their own."""
    return spark.range(0, ROWS, numPartitions=30).select(
        F.when(F.pmod("id", F.lit(3)) == 0, F.lit(777)).otherwise(F.col("id")).alias("doc_id"),
        sentence(F.col("id"), 12).alias("text"),
    )


def main(folder: str) -> None:
    Path(folder, "events").mkdir()
    spark = local_session(
        4, app="skew",
        **{
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": f"file://{folder}/events",
            "spark.eventLog.rolling.enabled": "false",
            "spark.eventLog.compress": "false",
            "spark.checkpoint.dir": f"{folder}/shared",
            "spark.sql.shuffle.partitions": "40",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            # The operators split hot keys themselves, whatever adaptive execution makes of them.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.enabled": "false",
        },
    )
    for name, build in {
        "lines": lambda: line_dedup.repeated_runs(passages(spark)),
        "components": lambda: components(hub(spark)),
        "next": lambda: minhash.with_next(one_id(spark), ["text"], 500),
    }.items():
        spark.sparkContext.setJobGroup(name, name)
        build().write.parquet(f"{folder}/{name}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1])
