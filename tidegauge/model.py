"""Schemas and small helpers shared by the operators."""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READINGS_SCHEMA = "reading_id long, endpoint_name string, timestamp timestamp_ntz, value_raw double, value_cal double, memo string, arrived timestamp_ntz"
#: Rows a task should hold at most where a group has to be in memory.
ROWS_PER_TASK = 250_000
#: Rows (of a few hundred bytes) up to which a side may be collected and broadcast; larger sides take the shuffled way.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the test data or of any directory laid out like it."""
    utc(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def value_or_null(col: Column | str) -> Column:
    """NaN means missing; Spark's aggregates only skip NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def has_value(col: Column | str) -> Column:
    """Neither NULL nor NaN."""
    col = F.col(col) if isinstance(col, str) else col
    return col.isNotNull() & ~F.isnan(col)


def significant(col: Column | str, digits: int) -> Column:
    """A double rounded to so many significant digits; NULL stays NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col.isNotNull(), F.format_string(f"%.{digits - 1}e", col)).cast("double")


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC. Needs a session in UTC, see :func:`utc`."""
    col = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(col.cast("timestamp"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless Python finds it there by its path or working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    if root in (os.path.abspath(p) for p in places if p) or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), package), "zip", root, package))


def utc(spark: SparkSession) -> None:
    """All times of this library are UTC; a session in another zone is set to it. Makes sure of the package, too."""
    ship(spark)
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def floor_div(col: Column, by: Column | int) -> Column:
    """Integer division towards minus infinity."""
    by = F.lit(by) if isinstance(by, int) else by
    return F.call_function("div", col - F.pmod(col, by), by)


def partitions_for(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Number of shuffle partitions so that each holds about ``rows_per_task`` rows; the count is a metadata-only scan for parquet."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, math.ceil(df.count() / rows_per_task))


def stored_bytes(df: DataFrame) -> int:
    """Size of the files that a plan reads, as the optimizer knows it; 0 where it doesn't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 2**60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    Only an input of fewer files than cores is shuffled, and that one is small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def collected_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> list | None:
    """The rows if there are at most ``max_rows``, else None. Never brings more than ``max_rows + 1`` rows to the driver."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def local_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once and held as a local relation if it is small; a larger one comes back as it is."""
    rows = collected_if_small(df, max_rows)
    return df if rows is None else df.sparkSession.createDataFrame([tuple(r) for r in rows], df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side once its size has been checked; a larger one comes back as it is and is joined by shuffle."""
    local = local_if_small(df, max_rows)
    return df if local is df else F.broadcast(local)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one below the warehouse folder if the session runs on
    this machine alone (tests), else an error: a cluster's executors don't share a machine's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
