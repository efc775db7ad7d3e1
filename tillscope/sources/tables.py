"""Sources, sinks and tables written part-way through a job."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table; the tenant is part of the name, never of the code."""
    return spark.table(name)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table read in parallel slices of a numeric or date column.

    The bounds only shape the slices: rows outside them land in the first or the last one.
    """
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def register_view(df: DataFrame, name: str, comments: dict[str, str] | None = None) -> DataFrame:
    """Register a session view whose columns carry comments; returns the commented DataFrame."""
    comments = comments or {}
    commented = df.select(
        *[
            F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c)
            for c in df.columns
        ]
    )
    commented.createOrReplaceTempView(name)
    return commented


def rewrite_where(df: DataFrame, condition: Column, column: str, value: object, path: str) -> DataFrame:
    """Write the table with :func:`update_where` applied to a new path, and read it from there.

    For a table in folders, :func:`update_in_place` rewrites only the folders that change.
    """
    update_where(df, condition, column, value).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def update_where(df: DataFrame, condition: Column, column: str, value: object) -> DataFrame:
    """The table with ``column`` set to ``value`` where the condition holds (NULL counts as no).

    Write the result to a new path or partition; with a table format that has it, use ``UPDATE``.
    """
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


_open_scopes: list[list[str]] = []
_open_tables: list[list[tuple[str, str]]] = []


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    Used where a result far smaller than the fact table is read several times: the fact table is
    then scanned once, a lost executor costs no recomputation, and the file sizes tell Catalyst
    whether the table is small enough to broadcast. The files stay until the caller's
    :func:`intermediate_tables` scope ends; without one they follow the folder's retention.
    """
    path = intermediate_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def intermediate_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the caller's :func:`intermediate_tables` scope."""
    path = f"{shared_folder(spark)}/tillscope-{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def intermediate_name(name: str, kind: str = "TABLE") -> str:
    """A new name for a catalog table or view, dropped with the caller's scope as well."""
    found = f"tillscope_{name}_{uuid.uuid4().hex}"
    if _open_tables:
        _open_tables[-1].append((kind, found))
    return found


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Remove, at the end, every intermediate table written or named inside, on any file system.

    Read or save the results before the scope ends: they are computed from these tables.
    """
    paths: list[str] = []
    names: list[tuple[str, str]] = []
    _open_scopes.append(paths)
    _open_tables.append(names)
    try:
        yield paths
    finally:
        _open_scopes.pop()
        _open_tables.pop()
        for kind, name in reversed(names):
            spark.sql(f"DROP {kind} IF EXISTS {name}")
        for path in paths:
            folder, files = _file_system(spark, path)
            files.delete(folder, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else inside the warehouse.

    Every executor must reach it. A path in the machines' own file system may be a mount that all
    of them share: unless the master is local, the executors are asked once per session, and a
    machine-local folder is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = folder or spark.conf.get("spark.sql.warehouse.dir")
    _, files = _file_system(spark, folder)
    local = spark.sparkContext.master.startswith("local")
    if files.getUri().getScheme() == "file" and not local:
        _ask_executors(spark, folder)
    return folder.rstrip("/")


_reached: set[tuple[str, str]] = set()


def _ask_executors(spark: SparkSession, folder: str) -> None:
    """Raise unless rows that executors write into the folder are there for the driver and for others.

    On a folder of each machine's own the rows stay behind on the disks of those that wrote them.
    Two small tasks per core are written and read back, so that all executors known by then take
    part; the driver alone cannot tell.
    """
    context = spark.sparkContext
    if (context.applicationId, folder) in _reached:
        return
    tasks = 2 * context.defaultParallelism
    path = f"{folder.rstrip('/')}/tillscope-reached-{uuid.uuid4().hex}"
    refusal = ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        found = spark.read.schema("id long").parquet(path).count()
    except (PySparkException, Py4JJavaError) as error:
        raise refusal from error
    finally:
        probe, files = _file_system(spark, path)
        files.delete(probe, True)
    # The driver is listed as an executor, too.
    if found < tasks or len(context._jsc.sc().statusTracker().getExecutorInfos()) < 2:
        raise refusal
    _reached.add((context.applicationId, folder))


def modified_at(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds, on any file system."""
    folder, files = _file_system(spark, path)
    return files.getFileStatus(folder).getModificationTime()


def _file_system(spark: SparkSession, path: str) -> tuple:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())
