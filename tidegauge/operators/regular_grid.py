"""Irregular readings onto a regular grid per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model

DAY_S = 86_400


def regular_series(readings: DataFrame, periods: DataFrame, max_gap_s: int = 60, broadcast_rows: int = model.BROADCAST_ROWS) -> DataFrame:
    """``(endpoint_name, day, cell_start, n, value, filled, status)``: one row per step of each endpoint's period.

    Cells start at multiples of ``period_s`` since 1970 (seconds, UTC), include their start and belong to the UTC day
    of their start. The series of a day reaches from the cell of its first to that of its last reading with a value;
    a cell that begins on the day before (periods that don't divide a day) counts to the day of its readings.
    ``n`` readings with a value fell into the cell, ``value`` is their mean; ``filled`` is ``value`` or, in an empty
    cell at most ``max_gap_s`` after the last one with a value, that one's value. ``status`` is ``read``, ``filled`` or
    ``missing``. A reading delivered more than once (same ``reading_id``) counts once; readings without id all count.
    Endpoints without a positive ``period_s`` or without readings give no row; NULL and NaN values and NULL times don't
    count.

    The sequence of a day is generated from its first and last cell and left-joined to the aggregated cells; the keys
    of the join contain the cell, so that a hot endpoint spreads. The fill window is one endpoint's day.
    """
    spark = readings.sparkSession
    model.utc(spark)
    p = periods.where("endpoint_name is not null and period_s > 0").groupBy("endpoint_name").agg(F.min("period_s").cast("long").alias("period_s"))
    small = model.collected_if_small(p, broadcast_rows)
    if small is None:
        p = p.withColumn("e", F.col("endpoint_name"))
    else:  # endpoints travel as numbers
        p = F.broadcast(spark.createDataFrame([(r["endpoint_name"], r["period_s"], i) for i, r in enumerate(small)], "endpoint_name string, period_s long, e int"))
    r = readings.where(model.has_value("value_raw") & F.col("timestamp").isNotNull()).select(
        "endpoint_name", model.micros("timestamp").alias("us"), "reading_id", F.col("value_raw").alias("v"))
    r = r.join(p, "endpoint_name").select(
        "e", model.floor_div(F.col("us"), DAY_S * 1_000_000).cast("int").alias("day"), model.floor_div(F.col("us"), F.col("period_s") * 1_000_000).alias("cell"), "reading_id", "v")
    key = ["e", "day", "cell"]
    # One exchange on the cell serves three steps: telling deliveries apart, aggregating the cell, and the join. The days' spans
    # come from a second scan of three columns: it sends a row per task and day, an exchange for both would have to go twice.
    cells = r.repartition(*key).groupBy(*key, F.coalesce(F.col("reading_id"), -1 - F.monotonically_increasing_id()).alias("id")).agg(F.min("v").alias("v"))
    cells = cells.groupBy(*key).agg(F.count("*").alias("n"), F.avg("v").alias("value"))
    spans = r.groupBy("e", "day").agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    grid = spans.select("e", "day", F.explode(F.sequence("lo", "hi")).alias("cell"))
    full = grid.join(cells, key, "left").withColumn("read", F.when(F.col("n").isNotNull(), F.col("cell")))
    w = W.partitionBy("e", "day").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    # what a query doesn't ask for, such as the values, doesn't travel
    full = full.withColumns({"last_read": F.last("read", ignorenulls=True).over(w), "last_value": F.last("value", ignorenulls=True).over(w)})
    full = full.join(p, "e")
    near = (F.col("cell") - F.col("last_read")) * F.col("period_s") <= max_gap_s
    return full.select(
        "endpoint_name", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"),
        (F.col("cell") * F.col("period_s")).alias("cell_start"), F.coalesce("n", F.lit(0)).alias("n"), "value",
        F.when(near, F.col("last_value")).alias("filled"),
        F.when(F.col("n").isNotNull(), "read").when(near, "filled").otherwise("missing").alias("status"),
    )


def empty_cells(series: DataFrame) -> DataFrame:
    """``(endpoint_name, cell_start)`` of the steps without a reading."""
    return series.where("status <> 'read'").select("endpoint_name", "cell_start")
