"""Resampling of a stream: the batch grid's buckets as event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge import model
from tidegauge.operators import series


def resample_stream(readings: DataFrame, name: str, timestamp: str, value: str, step_s: int, stop_s: int, reducer: str = "mean", late_s: int = 600) -> DataFrame:
    """``(name, t, x)``: one row per series and bucket once the watermark passes it; ``t`` is the bucket's centre.

    Buckets are those of a batch grid that ends at ``stop_s``. Readings more than ``late_s`` behind the newest are dropped
    by the watermark; those without name, time or value don't count. ``timestamp`` is a timestamp with zone (or is cast).
    """
    if reducer not in ("count", "sum", "mean", "var", "std", "min", "max", "first", "last"):
        raise ValueError(f"{reducer} can't be kept incrementally")
    r = readings.withColumn("at__", F.col(timestamp).cast("timestamp")).withWatermark("at__", f"{late_s} seconds")
    r = r.select(F.col(name).cast("string").alias("name"), F.unix_micros("at__").alias("us__"), "at__", model.value_or_null(F.col(value).cast("double")).alias("x"))
    r = r.where("name is not null and x is not null").withColumns({"t": F.col("us__") / 1_000_000, "i": F.lit(0).cast("long")})
    window = F.window("at__", f"{step_s} seconds", f"{step_s} seconds", f"{stop_s % step_s} seconds")
    out = r.groupBy("name", window.alias("w")).agg(series.reducer(reducer).cast("double").alias("x"))
    return out.select("name", (F.unix_seconds("w.start") + step_s / 2).cast("double").alias("t"), "x")


def write_whole(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that keeps the whole result, as it is after each batch, as parquet below ``path``, written by the executors.

    ``once`` works off what is there and ends. Both folders have to be shared by all machines. Until the first batch the table
    is empty.
    """
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(path)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    return (q.trigger(availableNow=True) if once else q).start()
