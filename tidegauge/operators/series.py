"""Series as long DataFrames ``(name, i, t, x)``: projections, filters, slices and reducers.

``t`` are seconds since 1970 (double), ``i`` orders points of equal time, NULL in ``x`` means missing (NaN is turned into
NULL by :func:`to_series`). A span (start, stop) is a plan parameter, not data.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model


def to_series(df: DataFrame, name: str, t: Column | str, x: str, i: str | None = None) -> DataFrame:
    """Long series from any table; timestamps become seconds, NaN becomes NULL, rows without name or time drop out.

    Without ``i`` points of equal time are ordered by value, which makes every result deterministic.
    """
    t = F.col(t) if isinstance(t, str) else t
    kind = dict(df.select(t.alias("t")).dtypes)["t"]
    seconds = model.micros(t) / 1_000_000 if kind.startswith("timestamp") else t.cast("double")
    order = F.col(i).cast("long") if i else F.lit(0).cast("long")
    out = df.select(F.col(name).cast("string").alias("name"), order.alias("i"), seconds.alias("t"), model.value_or_null(F.col(x).cast("double")).alias("x"))
    return out.where("name is not null and t is not null")


# ---- projections and filters


def apply(df: DataFrame, mapper: Callable[[Column], Column]) -> DataFrame:
    """x -> f(x); times stay."""
    return df.withColumn("x", mapper(F.col("x")))


def keep(df: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Points whose value satisfies the predicate; a missing value doesn't."""
    return df.where(F.coalesce(predicate(F.col("x")), F.lit(False)))


def dropna(df: DataFrame) -> DataFrame:
    return df.where("x is not null")


def keepna(df: DataFrame) -> DataFrame:
    return df


def slice_points(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Points ``start`` up to, not including, ``stop`` of each series, counted from 0; bounds beyond the series are clipped."""
    w = W.partitionBy("name").orderBy("t", "i", "x")
    # the bound on the plain row number lets the window stop early, on either side of its exchange
    first = df.withColumn("n__", F.row_number().over(w)).where(F.col("n__") <= max(0, stop))
    return first.where(F.col("n__") > start).drop("n__")


def between(df: DataFrame, start: float, stop: float) -> DataFrame:
    """Half-open time range."""
    return df.where((F.col("t") >= start) & (F.col("t") < stop))


# ---- reducers: aggregates over (t, x, i); NULL where the group has no value

def _order() -> Column:
    return F.struct("t", "i", "x")


def _given(c: Column) -> Column:
    return F.when(F.col("x").isNotNull(), c)


REDUCERS: dict[str, Callable[[Column | None], Column]] = {
    "count": lambda c: F.count("x"),
    "sum": lambda c: F.sum("x"),
    "mean": lambda c: F.avg("x"),
    "var": lambda c: F.var_samp("x"),
    "std": lambda c: F.stddev_samp("x"),
    "sem": lambda c: F.sqrt(F.var_samp("x") / F.count("x")),
    # the upper median: element n/2 of the sorted values, never an average
    "median": lambda c: F.expr("percentile_disc(0.5) within group (order by x desc)"),
    "min": lambda c: F.min("x"),
    "max": lambda c: F.max("x"),
    "first": lambda c: F.min_by("x", _given(_order())),
    "last": lambda c: F.max_by("x", _given(_order())),
    # nearest to the centre; of two equally near points the later
    "middle": lambda c: F.min_by("x", _given(F.struct(F.abs(F.col("t") - c), -F.col("t"), -F.col("i")))),
}
REDUCERS["n"] = REDUCERS["count"]


def register_reducer(name: str, build: Callable[[Column | None], Column]) -> None:
    """Adds a reducer: a builder of an aggregate over (t, x, i), given the span's centre; the last of a name counts."""
    REDUCERS[name] = build


def python_reducer(f: Callable) -> Callable[[Column | None], Column]:
    """A reducer from a Python function of a pandas Series of the values there; it gets a group at once, so use it on buckets."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        x = x.dropna()
        return float(f(x)) if len(x) else None

    return lambda centre: run(F.col("x"))


def reducer(name: str, centre: Column | None = None) -> Column:
    """Aggregate by name; ``middle`` needs the span's centre."""
    if name not in REDUCERS:
        raise ValueError(f"no reducer {name}")
    if name == "middle" and centre is None:
        raise ValueError("middle needs the centre of the span")
    return REDUCERS[name](centre)


def reduce(df: DataFrame, names: list[str], span: tuple[float, float] | None = None, strict: bool = False, rows_per_task: int = model.ROWS_PER_TASK) -> DataFrame:
    """One row per series with a column per reducer.

    ``strict`` makes min and max NULL if a series begins with a missing value. The median of series of more than
    ``rows_per_task`` points comes from :func:`large_median`, so that no task holds a series' values.
    """
    centre = None if span is None else F.lit((span[0] + span[1]) / 2)
    columns = []
    apart = "median" in names and longest(df) > rows_per_task
    for n in names:
        c = reducer(n, centre)
        if strict and n in ("min", "max"):
            c = F.when(F.min_by(F.col("x").isNotNull(), F.struct("t", "i")), c)
        columns.append(F.count("*").alias("median") if apart and n == "median" else c.alias(n))
    out = df.groupBy("name").agg(*columns)
    return out.drop("median").join(large_median(df), "name", "left").select("name", *names) if apart else out


def longest(df: DataFrame, keys: tuple[str, ...] = ("name",)) -> int:
    """Points of the longest series."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranked(df: DataFrame, rank: Column, x: str = "x", accuracy: int = 10_000, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``keys`` and ``x``: of each series the value at ``rank`` (from 0, of ``n``, the number of values) among its sorted values.

    Exact for series of any length: an approximate summary brackets the middle, values below the bracket are only counted,
    and the distinct values inside, about 4 / ``accuracy`` of a series, are ranked. For ranks around the middle.
    """
    keys = list(keys)
    d = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("v__"))
    low, high = max(0.0, 0.5 - 2 / accuracy), min(1.0, 0.5 + 2 / accuracy)
    bracket = d.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v__", [low, high], accuracy).alias("p"))
    bracket = bracket.select(*keys, rank.cast("long").alias("want"), F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    b = d.join(model.broadcast_if_small(bracket), keys).where(F.col("v__") <= F.col("hi"))
    counts = b.groupBy(*keys, "want", F.when(F.col("v__") >= F.col("lo"), F.col("v__")).alias("v__")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys).orderBy(F.asc_nulls_first("v__")).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.withColumn("upto", F.sum("c").over(w)).where(F.col("upto") > F.col("want"))
    return upto.groupBy(*keys).agg(F.min("v__").alias(x))


def large_median(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """``(name, median)``: the exact upper median of series of any length that have a value."""
    return ranked(df, F.floor(F.col("n") / 2), "x", accuracy).withColumnRenamed("x", "median")


def steps(df: DataFrame, slice_seconds: int | None = 86_400) -> DataFrame:
    """``(name, d)``: the time from each point to the next.

    With ``slice_seconds`` no task holds a series: windows reach over one slice of a series, and the first point of a slice
    follows the last one of the slice before, of which there is one row each.
    """
    if slice_seconds is None:
        return df.select("name", (F.col("t") - F.lag("t").over(W.partitionBy("name").orderBy("t", "i"))).alias("d")).where("d is not null")
    p = df.select("name", "i", "t", F.floor(F.col("t") / slice_seconds).alias("k"))
    inner = p.select("name", (F.col("t") - F.lag("t").over(W.partitionBy("name", "k").orderBy("t", "i"))).alias("d"))
    ends = p.groupBy("name", "k").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    across = ends.select("name", (F.col("a") - F.lag("b").over(W.partitionBy("name").orderBy("k"))).alias("d"))
    return inner.union(across).where("d is not null")


def sampling_interval(df: DataFrame, rows_per_task: int = model.ROWS_PER_TASK, slice_seconds: int = 86_400) -> DataFrame:
    """``(name, dt)``: lower median of the steps between successive points; NULL for fewer than two.

    Series of more than ``rows_per_task`` points are cut into slices of time and their steps ranked by :func:`ranked`.
    """
    if longest(df) <= rows_per_task:
        w = W.partitionBy("name").orderBy("t", "i")
        return df.withColumn("d", F.col("t") - F.lag("t").over(w)).groupBy("name").agg(F.expr("percentile_disc(0.5) within group (order by d)").alias("dt"))
    found = ranked(steps(df, slice_seconds), F.floor((F.col("n") - 1) / 2), "d").withColumnRenamed("d", "dt")
    return df.select("name").distinct().join(found, "name", "left")
