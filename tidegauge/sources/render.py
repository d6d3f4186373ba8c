"""Series and frames as JSON and CSV."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge import model


def date_text(t: Column | str) -> Column:
    """Seconds since 1970 as ``YYYY-MM-DDTHH:MM:SS`` (UTC)."""
    t = F.col(t) if isinstance(t, str) else t
    return F.date_format(F.timestamp_seconds(F.floor(t).cast("long")).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")


def series_json(df: DataFrame, start: float, stop: float) -> DataFrame:
    """``(name, json)``: start, length, times from the start to a tenth of a second and values to six significant digits;
    missing values are null.

    The points of one series meet in one row: a rendering for series that a person or a plot reads.
    """
    points = F.transform(F.array_sort(F.collect_list(F.struct("t", "i", "x"))), lambda p: F.struct(F.round(p["t"] - start, 1).alias("t"), model.significant(p["x"], 6).alias("x")))
    rows = df.groupBy("name").agg(points.alias("p"))
    body = F.struct(F.lit(start).alias("start"), F.lit(stop - start).alias("length"), F.col("p.t").alias("t"), F.col("p.x").alias("x"))
    return rows.select("name", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def series_csv(df: DataFrame, label: str) -> DataFrame:
    """Columns ``DateTime``, ``TimeStamp`` (to a tenth of a second) and the label, for ``write.csv``."""
    return df.select(date_text("t").alias("DateTime"), F.round("t", 1).alias("TimeStamp"), F.col("x").alias(label))


def frame_csv(frame: DataFrame) -> DataFrame:
    """A wide frame with its two time columns, for ``write.csv``."""
    return frame.select(date_text("t").alias("DateTime"), F.round("t", 1).alias("TimeStamp"), *[f"`{c}`" for c in frame.columns if c != "t"])


def number(x: float | None) -> str:
    """Six significant digits, missing as nan."""
    return "nan" if x is None or math.isnan(x) else f"{x:.6g}"


def frame_lines(frame: DataFrame) -> list[str]:
    """A small frame's CSV text, line by line, in time order."""
    shown = frame_csv(frame).orderBy("TimeStamp")
    rows = [f"{r[0]},{r[1]:.12g}," + ",".join(number(x) for x in r[2:]) for r in shown.toLocalIterator()]
    return [",".join(shown.columns), *rows]


def frame_json(frame: DataFrame) -> str:
    """A small frame as JSON: column names, and rows as arrays."""
    shown = frame_csv(frame).orderBy("TimeStamp")
    rows = [[r[0], r[1], *(None if x is None else float(f"{x:.6g}") for x in r[2:])] for r in shown.toLocalIterator()]
    return json.dumps({"columns": shown.columns, "table": rows})


def sensor_json(fields: list[str], delimiter: str = ".") -> Column:
    """Chosen fields of a sensor row as JSON; name and label chains are joined."""
    columns = {
        "number": F.col("number"), "name": F.array_join("name", delimiter).alias("name"), "label": F.array_join("label", ", ").alias("label"),
        "calibration": F.col("calibration"), "options": F.col("options"),
    }
    return F.to_json(F.struct(*(columns[f] for f in fields)))
