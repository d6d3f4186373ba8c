"""Fillers of missing values along each series; all windows are partitioned by series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILLERS = ("none", "value", "prev", "next", "closest", "line")


def fill(df: DataFrame, how: str, value: float | None = None, by: str = "name", t: str = "t", x: str = "x", slice_seconds: int | None = 86_400) -> DataFrame:
    """``x`` with NULLs filled.

    ``prev``/``next`` take the neighbour before/after (the edge stays NULL); ``closest`` the one nearer in time, the next of
    two equally near, at the edges the only one; ``line`` interpolates between the two and leaves the edges NULL;
    ``value`` puts a constant. Two neighbours at one time give NULL for ``closest`` and ``line``.

    With ``slice_seconds`` windows reach over one slice of a series, and the known points next to a slice come from one row
    for each slice; None takes a series at once, for grids of a bounded number of steps.
    """
    if how not in FILLERS:
        raise ValueError(f"no filler {how}")
    if how == "none":
        return df
    if how == "value":
        return df.withColumn(x, F.coalesce(x, F.lit(value)))
    point = F.when(F.col(x).isNotNull(), F.struct(F.col(t).alias("t"), F.col(x).alias("x")))
    keys = [by]
    if slice_seconds is not None:
        keys = [by, "k__"]
        df = df.withColumn("k__", F.floor(F.col(t) / slice_seconds))
        ends = df.groupBy(*keys).agg(F.max(point).alias("b__"), F.min(point).alias("a__"))
        slices = W.partitionBy(by).orderBy("k__")
        before = F.last("b__", ignorenulls=True).over(slices.rowsBetween(W.unboundedPreceding, -1))
        after = F.first("a__", ignorenulls=True).over(slices.rowsBetween(1, W.unboundedFollowing))
        df = df.join(ends.select(*keys, before.alias("before__"), after.alias("after__")), keys, "left")
    back = W.partitionBy(*keys).orderBy(t).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = W.partitionBy(*keys).orderBy(t).rowsBetween(W.currentRow, W.unboundedFollowing)
    if how in ("prev", "closest", "line"):
        last = F.last(point, ignorenulls=True).over(back)
        df = df.withColumn("p__", last if slice_seconds is None else F.coalesce(last, "before__"))
    if how in ("next", "closest", "line"):
        first = F.first(point, ignorenulls=True).over(ahead)
        df = df.withColumn("n__", first if slice_seconds is None else F.coalesce(first, "after__"))
    return df.withColumn(x, F.coalesce(x, _between(how, F.col(t)))).drop("p__", "n__", "k__", "before__", "after__")


def _between(how: str, t: Column) -> Column:
    p, n = F.col("p__") if how != "next" else None, F.col("n__") if how != "prev" else None
    if how == "prev":
        return p["x"]
    if how == "next":
        return n["x"]
    apart = n["t"] > p["t"]
    if how == "line":
        return F.when(apart, (t - p["t"]) / (n["t"] - p["t"]) * (n["x"] - p["x"]) + p["x"])
    nearer = F.when(apart, F.when(F.abs(p["t"] - t) < F.abs(n["t"] - t), p["x"]).otherwise(n["x"]))
    return F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).otherwise(nearer)
