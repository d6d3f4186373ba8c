"""Resampling: series onto a shared grid of time buckets, reduced, filled and set side by side.

Buckets are anchored to the span's end: the first begins at ``stop - ceil((stop - start) / step) * step + offset``; they are
half-open and bear the time of their centre. The grid is computed once and shared by all series of a frame.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.operators import fill as filling
from tidegauge.operators import series as S


@dataclass(frozen=True)
class Grid:
    """Buckets ``[first + k step, first + (k + 1) step)`` for k below ``n``."""

    first: float
    step: float
    n: int

    @classmethod
    def by_time(cls, start: float, stop: float, step: float, offset: float = 0.0) -> Grid:
        """Grid over a span. A step that isn't positive is an error; an empty span has no bucket."""
        if not step > 0 or not math.isfinite(step):
            raise ValueError(f"the step has to be positive: {step}")
        if not start < stop:
            return cls(start, step, 0)
        first = stop - math.ceil((stop - start) / step) * step + offset
        n = max(0, math.ceil((stop - first - step / 2) / step))
        return cls(first, step, n)

    @classmethod
    def of_series(cls, df: DataFrame, step: float, start: float = math.nan, stop: float = math.nan, offset: float = 0.0) -> Grid:
        """Grid over given bounds; a start that is NaN or not positive is that of the first point, a stop that is NaN or not
        above the start that of the last. Without a point and without bounds there is no bucket."""
        own = math.isnan(start) or start <= 0 or math.isnan(stop) or stop <= start
        a, b = df.agg(F.min("t"), F.max("t")).first() if own else (start, stop)
        if a is None:
            return cls(0.0, step, 0)
        start = a if math.isnan(start) or start <= 0 else start
        return cls.by_time(start, b if math.isnan(stop) or stop <= start else stop, step, offset)

    def with_offset(self, offset: float, stop: float) -> Grid:
        first = self.first + offset
        return Grid(first, self.step, max(0, math.ceil((stop - first - self.step / 2) / self.step)))


def align(df: DataFrame, how: str, spans: dict[str, tuple[float, float]] | None = None) -> Grid:
    """Grid that suits several series.

    ``auto``: the upper median of their sampling intervals (1 if there is none), starts and stops; ``min``: the shortest
    interval (10) over the union of spans; ``max``: the longest (10) over their intersection. A span is that of the points,
    the last one excluded as an end, unless ``spans`` gives it. Without a series there is no bucket; repeated times that make
    the interval 0 are an error. Only the three resulting numbers come to the driver.
    """
    if how not in ("auto", "min", "max"):
        raise ValueError(f"no alignment {how}")
    own = S.sampling_interval(df)
    if spans is None:
        own = own.join(df.groupBy("name").agg(F.min("t").alias("a"), F.max("t").alias("b")), "name")
    else:
        given = df.sparkSession.createDataFrame([(n, float(a), float(b)) for n, (a, b) in spans.items()], "name string, a double, b double")
        own = given.join(own, "name", "left")
    upper = lambda c: F.expr(f"percentile_disc(0.5) within group (order by {c} desc)")
    chosen = {"auto": (upper("dt"), upper("a"), upper("b")), "min": (F.min("dt"), F.min("a"), F.max("b")), "max": (F.max("dt"), F.max("a"), F.min("b"))}[how]
    dt, a, b = own.agg(*chosen).first()
    if a is None:
        return Grid(0.0, 1.0, 0)
    return Grid.by_time(a, b, dt if dt is not None else 1.0 if how == "auto" else 10.0)


def resample(
    df: DataFrame, grid: Grid, reducer: str, filler: str = "none", value: float | None = None, names: list[str] | None = None, rows_per_task: int = model.ROWS_PER_TASK
) -> DataFrame:
    """``(name, k, t, x)``: every series on every bucket of the grid.

    ``names`` are the series wanted; without them, those that occur. A bucket without a value is NULL (``count``: 0 in a
    bucket with points, NULL in one without) before filling. Medians of buckets of more than ``rows_per_task`` points come
    from :func:`tidegauge.operators.series.ranked`; fillers run over the grid, one row a bucket.
    """
    keyed = into_buckets(df, grid)
    if reducer == "median" and S.longest(keyed, ("name", "k")) > rows_per_task:
        buckets = S.ranked(keyed, F.floor(F.col("n") / 2), keys=("name", "k"))
    else:
        buckets = keyed.groupBy("name", "k").agg(S.reducer(reducer, centre_of(grid)).cast("double").alias("x"))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "name string") if names is not None else df.select("name").distinct()
    return on_grid(buckets, grid, every, filler, value)


def into_buckets(df: DataFrame, grid: Grid) -> DataFrame:
    """Points with the number ``k`` of their bucket; those outside the grid drop out."""
    return df.withColumn("k", F.floor((F.col("t") - grid.first) / grid.step)).where((F.col("k") >= 0) & (F.col("k") < grid.n))


def on_grid(buckets: DataFrame, grid: Grid, every: DataFrame, filler: str = "none", value: float | None = None) -> DataFrame:
    """``(name, k, t, x)`` of reduced buckets ``(name, k, x)``: every series of ``every`` on every bucket, filled."""
    centre = F.lit(grid.first) + (F.col("k") + 0.5) * grid.step
    if grid.n == 0:
        return every.select("name", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("t"), F.lit(None).cast("double").alias("x")).where("false")
    cells = every.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.n - 1).cast("long"))).alias("k"))
    full = cells.join(buckets, ["name", "k"], "left").select("name", "k", centre.alias("t"), "x")
    return filling.fill(full, filler, value, slice_seconds=None)


def centre_of(grid: Grid):
    """Centre of the bucket that a point lies in."""
    return F.lit(grid.first) + (F.floor((F.col("t") - grid.first) / grid.step) + 0.5) * grid.step


def frame(df: DataFrame, grid: Grid, names: list[str], reducer: str, filler: str = "none", value: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Wide frame ``(t, <one column per series>)`` in the order of ``names``, one row per bucket.

    ``columns`` renames them; a series without a point is a column of NULLs.
    """
    return widen(resample(df, grid, reducer, filler, value, names), names, columns)


def widen(long: DataFrame, names: list[str], columns: list[str] | None = None) -> DataFrame:
    """A column per series of a resampled long table."""
    wide = long.groupBy("t").pivot("name", names).agg(F.first("x"))
    for old, new in zip(names, columns or names):
        if old != new:
            wide = wide.withColumnRenamed(old, new)
    return wide


def numbered_columns(n: int) -> list[str]:
    """Names of columns without a name."""
    return [f"Column{i:03d}" for i in range(n)]
