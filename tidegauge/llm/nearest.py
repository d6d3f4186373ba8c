"""Records of two tables paired with the nearest in time of the same entity, within a tolerance.

Each (entity, time shard) of the right side gets a learned index: a piecewise-linear model of position over time with a
proven largest error. A query's position is predicted, and a binary search inside the error bound finds the exact
neighbours. Readings within the tolerance of a shard's edge belong to the next shard too. Before, a bitmap of bounded size
keeps readings that are near no query from being shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import model

#: Words of the bitmap that stand in one row, and the logarithm of their number.
_ROW_WORDS, _ROW_SHIFT = 64, 6


class LearnedIndex:
    """Position of int64 keys (ascending, unique) by line segments whose error is at most ``max_error`` positions."""

    def __init__(self, keys: np.ndarray, max_error: int = 32):
        self.keys, self.max_error = keys, max_error
        n = len(keys)
        self.origin = int(keys[0]) if n else 0
        x, y = (keys - self.origin).astype(np.float64), np.arange(n, dtype=np.float64)
        knots = np.unique(np.array([0, max(n - 1, 0)]))
        while n > 2:
            error = np.abs(np.interp(x, x[knots], y[knots]) - y)
            starts = knots[:-1]
            worst = np.maximum.reduceat(error, starts)
            failing = np.flatnonzero(worst > max_error)
            if not len(failing):
                break
            segment = np.searchsorted(knots, np.arange(n), side="right") - 1
            peaks = np.flatnonzero(error == worst[np.minimum(segment, len(starts) - 1)])
            first = peaks[np.unique(segment[peaks], return_index=True)[1]]
            knots = np.unique(np.r_[knots, first[np.isin(segment[first], failing)]])
        self.x, self.y = x[knots] if n else x, y[knots] if n else y

    @property
    def segments(self) -> int:
        return max(0, len(self.x) - 1)

    def lower_bound(self, queries: np.ndarray) -> np.ndarray:
        """Index of the first key not below each query, exact."""
        n = len(self.keys)
        if n == 0:
            return np.zeros(len(queries), dtype=np.int64)
        guess = np.interp((queries - self.origin).astype(np.float64), self.x, self.y)
        reach = self.max_error + 2
        low = np.clip(np.floor(guess).astype(np.int64) - reach, 0, n)
        high = np.clip(np.ceil(guess).astype(np.int64) + reach, 0, n)
        for _ in range(int(2 * reach + 2).bit_length() + 1):
            middle = (low + high) >> 1
            open_ = low < high
            below = open_ & (self.keys[np.minimum(middle, n - 1)] < queries)
            low = np.where(below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        return low

    def nearest(self, queries: np.ndarray) -> np.ndarray:
        """Index of the nearest key; of two equally near ones the earlier."""
        after = np.minimum(self.lower_bound(queries), len(self.keys) - 1)
        before = np.maximum(after - 1, 0)
        return np.where(np.abs(queries - self.keys[before]) <= np.abs(self.keys[after] - queries), before, after)


def _matcher(tolerance_us: int, max_error: int, left_schema: pa.Schema, right_names: list[str], names: list[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        query = left["q__"].to_numpy()
        chosen = np.full(n, -1, dtype=np.int64)
        delta = np.zeros(n, dtype=np.int64)
        if n and right.num_rows:
            right = right.sort_by([("t__", "ascending"), ("rank__", "ascending")])
            t = right["t__"].to_numpy()
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])  # of equal times the smallest id
            index = LearnedIndex(t[first], max_error)
            at = index.nearest(query)
            delta = index.keys[at] - query
            chosen = np.where(np.abs(delta) <= tolerance_us, first[at], -1)
        miss = chosen < 0
        take = pa.array(chosen, mask=miss)
        columns = [left[c] for c in left_schema.names]
        columns += [right[c].take(take) if right.num_rows else pa.nulls(n, right.schema.field(c).type) for c in right_names]
        columns.append(pa.array(delta, mask=miss))
        return pa.table(columns, names=names)

    return run


def _near_some(right: DataFrame, left: DataFrame, tolerance_us: int, words: int) -> DataFrame:
    """The right rows that may be within the tolerance of a left row: all that are, and others by chance.

    Time is cut into spans of twice the tolerance. A left row marks the spans that its tolerance touches.
    """
    span = max(2 * tolerance_us, 1_000_000)
    hashed = lambda at: F.xxhash64("k__", at)
    word_of, bit_of = (lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(words))), (lambda h: F.pmod(h, F.lit(64)).cast("int"))
    row_of, place_of = (lambda w: F.shiftright(w, _ROW_SHIFT)), (lambda w: w.bitwiseAND(F.lit(_ROW_WORDS - 1)).cast("int"))
    touched = F.explode(F.array_distinct(F.array(*(model.floor_div(F.col("q__") + d, span) for d in (-tolerance_us, tolerance_us)))))
    marks = left.select("k__", touched.alias("at__")).select(hashed("at__").alias("h__"))
    marks = marks.select(word_of(F.col("h__")).alias("word__"), F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(F.col("h__"))).alias("bits__"))
    marks = marks.groupBy("word__").agg(F.bit_or("bits__").alias("bits__"))
    marks = marks.groupBy(row_of(F.col("word__")).alias("row__")).agg(F.map_from_entries(F.collect_list(F.struct(place_of(F.col("word__")).alias("k"), "bits__"))).alias("m__"))
    marks = marks.select("row__", F.transform(F.sequence(F.lit(0), F.lit(_ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m__", i), F.lit(0).cast("long"))).alias("bits__"))
    r = right.withColumn("h__", hashed(model.floor_div(F.col("t__"), span))).withColumn("word__", word_of(F.col("h__")))
    r = r.withColumn("row__", row_of(F.col("word__"))).join(F.broadcast(marks), "row__")
    r = r.where(F.getbit(F.get("bits__", place_of(F.col("word__"))), bit_of(F.col("h__"))) == 1)
    return r.drop("h__", "word__", "row__", "bits__")


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    left_on: tuple[str, str],
    right_on: tuple[str, str],
    right_id: str,
    tolerance_us: int,
    shard_seconds: int = 43_200,
    max_error: int = 32,
    filter_words: int = 2**19,
) -> DataFrame:
    """Every left row with the columns of the nearest right row of the same entity and ``delta_us`` (right minus left;
    ``delta_us_right`` if a column is so called).

    ``left_on`` and ``right_on`` name (entity, timestamp without zone). The distance is at most ``tolerance_us``, its
    ends included; of two equally near rows the earlier counts, of equal times the smallest ``right_id``. A left row
    without partner, or with a NULL entity or time, comes back once with NULLs; right rows with a NULL entity, time or
    id take no part; repeated left rows stay repeated. Right columns whose names the left has get the suffix ``_right``.

    Right rows that no left row can be near to don't travel: a bitmap over the left rows' (entity, span of time) keys, hashed
    to ``filter_words`` words of 64 bits, which bounds its broadcast whatever the number of left rows, lets through all
    rows near some left row and, as the bitmap fills up, more and more others.

    Groups are (entity, time shard): a hot entity spreads over its shards, and a shard holds the rows of
    ``shard_seconds`` that are near a left row at most. ``shard_seconds`` should be far above the tolerance.
    """
    model.utc(left.sparkSession)
    width = shard_seconds * 1_000_000
    left_names, right_names = left.columns, right.columns
    right = right.toDF(*right_names)  # columns of its own, as both sides may come from one table
    out_right = [f"{c}_right" if c in left_names else c for c in right_names]
    delta = "delta_us_right" if "delta_us" in [*left_names, *out_right] else "delta_us"
    q, t = model.micros(left_on[1]), model.micros(right_on[1])
    keyed = left.withColumns({"k__": F.col(left_on[0]), "q__": q}).withColumn("shard__", model.floor_div(F.col("q__"), width))
    whole = F.col("k__").isNotNull() & F.col("q__").isNotNull()
    r = right.where(F.col(right_on[0]).isNotNull() & F.col(right_on[1]).isNotNull() & F.col(right_id).isNotNull())
    r = r.withColumns({"k__": F.col(right_on[0]), "t__": t, "rank__": F.col(right_id)})
    r = _near_some(r, keyed.where(whole), tolerance_us, filter_words)
    shards = [model.floor_div(F.col("t__") + d, width) for d in (-tolerance_us, 0, tolerance_us)]
    r = r.withColumn("shard__", F.explode(F.array_distinct(F.array(*shards))))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema]
    fields += [f"`{n}` {f.dataType.simpleString()}" for n, f in zip(out_right, right.schema)]
    schema = ", ".join([*fields, f"{delta} long"])
    run = _matcher(tolerance_us, max_error, pa.schema([(c, pa.null()) for c in left_names]), right_names, [*left_names, *out_right, delta])
    pairs = keyed.where(whole).groupBy("k__", "shard__").cogroup(r.groupBy("k__", "shard__")).applyInArrow(run, schema)
    rest = keyed.where(~whole).select(*left_names, *(F.lit(None).cast(f.dataType).alias(n) for n, f in zip(out_right, right.schema)), F.lit(None).cast("long").alias(delta))
    return pairs.unionByName(rest)


def endpoint_names(entries: DataFrame, endpoints: DataFrame, setup: str) -> DataFrame:
    """``(spelling, endpoint)``: the ways to write an endpoint, lower case with ``_``, without the setup.

    An endpoint's own name goes before a sensor's name; a sensor bound to several endpoints stands for the one most of
    its entries are bound to. ``entries`` come from :func:`tidegauge.operators.validity.bound_entries`.
    """
    own = endpoints.select("endpoint_name").union(entries.select("endpoint_name")).where("endpoint_name is not null").distinct()
    own = own.select(spelling(F.col("endpoint_name"), setup).alias("spelling"), F.col("endpoint_name").alias("endpoint"), F.lit(2**40).alias("votes"))
    named = entries.where("sensor_name is not null").groupBy(spelling(F.col("sensor_name"), setup).alias("spelling"), F.col("endpoint_name").alias("endpoint"))
    both = own.union(named.agg(F.count("*").alias("votes")))
    return both.groupBy("spelling").agg(F.max_by("endpoint", F.struct("votes", "endpoint")).alias("endpoint"))


def spelling(name, setup: str):
    """Normal form of an endpoint or dotted sensor name: no blanks around, lower case, ``_`` for ``.``, no setup."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\.", "_")
    return F.regexp_replace(bare, rf"_{setup.lower()}$", "")
