"""Percentiles per group with a proven rank error, from mergeable summaries.

A summary holds sorted buffers of ``k`` values, each standing for ``w`` values, and up to ``k - 1`` single values. When
``fan_in`` buffers of one weight are there they collapse: of their merged values every ``fan_in``-th is kept, starting
in the middle, and stands for ``fan_in * w``. Such a collapse moves any rank by at most half the new weight, and the
sum of these halves, kept with the summary, bounds the whole error whatever the order of merges.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import model

SUMMARY = "n long, error long, least double, most double, weights array<long>, buffers array<double>, rest array<double>"


@dataclass
class Summary:
    """Deterministic quantile summary. ``error`` is the largest possible difference of any rank, in values."""

    k: int = 512
    fan_in: int = 16
    n: int = 0
    error: int = 0
    least: float = np.inf
    most: float = -np.inf
    levels: dict[int, list[np.ndarray]] = field(default_factory=dict)
    rest: np.ndarray = field(default_factory=lambda: np.empty(0))
    collapses: int = 0

    def add(self, values: np.ndarray) -> Summary:
        """Adds single values (no NaN)."""
        if len(values):
            self.n += len(values)
            self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
            self._singles(values)
            self._collapse()
        return self

    def _singles(self, values: np.ndarray) -> None:
        pool = np.concatenate([self.rest, values])
        full = len(pool) // self.k * self.k
        if full:
            self.levels.setdefault(1, []).extend(np.sort(pool[:full].reshape(-1, self.k), axis=1))
        self.rest = pool[full:]

    def merge(self, other: Summary) -> Summary:
        self.n, self.error = self.n + other.n, self.error + other.error
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        for w, buffers in other.levels.items():
            self.levels.setdefault(w, []).extend(buffers)
        self._singles(other.rest)
        self._collapse()
        return self

    def _collapse(self) -> None:
        w = min(self.levels, default=1)
        while w <= max(self.levels, default=0):
            buffers = self.levels.get(w, [])
            while len(buffers) >= self.fan_in:
                group, buffers = buffers[: self.fan_in], buffers[self.fan_in :]
                merged = np.sort(np.concatenate(group), kind="stable")
                half = self.fan_in // 2
                start = half - (self.fan_in % 2 == 0 and self.collapses % 2)  # even: below and above the middle in turn
                self.levels.setdefault(w * self.fan_in, []).append(merged[start :: self.fan_in])
                self.error += w * self.fan_in // 2
                self.collapses += 1
            self.levels[w] = buffers
            w *= self.fan_in
        self.levels = {w: b for w, b in self.levels.items() if b}

    def quantiles(self, qs: list[float]) -> tuple[list[float | None], float | None]:
        """The value of rank ceil(q n) for each q, and the bound on its rank error as a share of n."""
        if not self.n:
            return [None] * len(qs), None
        parts = [(np.concatenate(b), w) for w, b in self.levels.items()] + [(self.rest, 1)]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w, dtype=np.int64) for v, w in parts])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        rank = np.maximum(1, np.ceil(np.array(qs) * self.n - 1e-9)).astype(np.int64)
        found = values[order][np.minimum(np.searchsorted(upto, rank), len(values) - 1)]
        bound = (self.error + max(w for _, w in parts) - 1) / self.n
        return [float(x) for x in found], bound

    def row(self) -> dict:
        weights = [w for w in sorted(self.levels) for _ in self.levels[w]]
        flat = [b for w in sorted(self.levels) for b in self.levels[w]]
        return {
            "n": self.n, "error": self.error, "least": self.least if self.n else None, "most": self.most if self.n else None,
            "weights": weights, "buffers": np.concatenate(flat) if flat else np.empty(0), "rest": self.rest,
        }

    @classmethod
    def of(cls, row: dict, k: int, fan_in: int) -> Summary:
        s = cls(k, fan_in, row["n"], row["error"])
        s.least, s.most = (np.inf if row["least"] is None else row["least"]), (-np.inf if row["most"] is None else row["most"])
        for w, b in zip(row["weights"], np.asarray(row["buffers"], dtype=np.float64).reshape(-1, k)):
            s.levels.setdefault(int(w), []).append(b)
        s.rest = np.asarray(row["rest"], dtype=np.float64)
        return s


_ARROW = pa.schema([("n", pa.int64()), ("error", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), ("weights", pa.list_(pa.int64())), ("buffers", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64()))])


def _table(keys: list[tuple[str, pa.DataType, object]], s: Summary) -> pa.Table:
    row = s.row()
    arrays = [pa.array([v], type=t) for _, t, v in keys]
    arrays += [pa.array([row[f.name]], type=f.type) for f in _ARROW]
    return pa.table(arrays, names=[k for k, _, _ in keys] + _ARROW.names)


def _rows(table: pa.Table) -> list[dict]:
    out = []
    for i in range(table.num_rows):
        r = {c: table[c][i].as_py() for c in ("n", "error", "least", "most")}
        r |= {c: table[c][i].values.to_numpy(zero_copy_only=False) for c in ("weights", "buffers", "rest")}
        out.append(r)
    return out


def summarise(
    readings: DataFrame, group: str, timestamp: str, value: str, identity: str, k: int = 512, fan_in: int = 16, slice_seconds: int = 43_200, rows_per_group: int = 200_000
) -> DataFrame:
    """``(group, day, <summary>)``: one mergeable summary per group and UTC day (days since 1970).

    Values that are NULL or NaN, and rows with a NULL group or time, don't count; rows of the same ``identity`` in the
    same group and time slice count once, those without identity all count.

    A first stage summarises slices of a day, so that a hot group spreads and only summaries meet. Slices of more than
    ``rows_per_group`` rows, found by counting, are salted by a hash of the identity: repeats still meet, and no task gets
    more than about ``rows_per_group`` values. The salts' summaries merge 32 at a time.
    """
    model.utc(readings.sparkSession)
    us = model.micros(timestamp)
    r = readings.where(model.has_value(value) & F.col(group).isNotNull() & F.col(timestamp).isNotNull())
    r = r.select(F.col(group).cast("string").alias("g__"), model.floor_div(us, slice_seconds * 1_000_000).alias("s__"), F.col(identity).alias("i__"), F.col(value).cast("double").alias("v__"))
    hot = r.groupBy("g__", "s__").agg(F.ceil(F.count("*") / rows_per_group).alias("salts__")).where("salts__ > 1")
    hot = model.local_if_small(hot)  # at most one row per rows_per_group readings
    most = hot.agg(F.max("salts__")).first()[0] or 1
    if most > 1:
        r = r.join(model.broadcast_if_small(hot), ["g__", "s__"], "left")
        spot = F.when(F.col("i__").isNotNull(), F.xxhash64("i__")).otherwise(F.monotonically_increasing_id())
        salt = F.pmod(spot, F.coalesce("salts__", F.lit(1)))
        r = r.select("g__", "s__", salt.alias("salt__"), "i__", "v__")
    else:
        r = r.withColumn("salt__", F.lit(0).cast("long"))

    def first(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["i__"]
        v = table["v__"].to_numpy()
        if ids.null_count == len(ids):
            kept = v
        else:
            known = ids.is_valid().to_numpy()
            at = np.unique(ids.filter(ids.is_valid()).to_numpy(), return_index=True)[1]
            kept = np.concatenate([v[known][np.sort(at)], v[~known]])
        g, part, salt = (x.as_py() for x in key)
        day = part * slice_seconds // 86_400
        return _table([("g", pa.string(), g), ("day", pa.int64(), day), ("part", pa.int64(), part), ("salt", pa.int64(), salt)], Summary(k, fan_in).add(kept))

    parts = r.groupBy("g__", "s__", "salt__").applyInArrow(first, f"g string, day long, part long, salt long, {SUMMARY}")
    while most > 32:
        parts = parts.withColumnRenamed("salt", "low").withColumn("salt", model.floor_div(F.col("low"), 32))
        parts, most = _merged(parts, ["g", "day", "part", "salt"], ["low"], k, fan_in), math.ceil(most / 32)
    days = _merged(parts, ["g", "day"], ["part", "salt"], k, fan_in)
    return days.withColumnRenamed("g", group)


def _merged(parts: DataFrame, keys: list[str], order: list[str], k: int, fan_in: int) -> DataFrame:
    types = {"string": pa.string(), "bigint": pa.int64()}
    kinds = dict(parts.dtypes)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        s = Summary(k, fan_in)
        for row in _rows(table.sort_by([(c, "ascending") for c in order])):
            s.merge(Summary.of(row, k, fan_in))
        return _table([(c, types[kinds[c]], v.as_py()) for c, v in zip(keys, key)], s)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), SUMMARY])
    return parts.groupBy(*keys).applyInArrow(run, schema)


def over_days(days: DataFrame, group: str, k: int = 512, fan_in: int = 16, days_at_once: int = 32) -> DataFrame:
    """``(group, <summary>)`` over all days, from the days' summaries alone; merged in blocks of days first."""
    model.utc(days.sparkSession)
    parts = days.select(F.col(group).alias("g"), model.floor_div(F.col("day"), days_at_once).alias("block"), "day", *[f.split()[0] for f in SUMMARY.split(", ")])
    blocks = _merged(parts, ["g", "block"], ["day"], k, fan_in)
    return _merged(blocks, ["g"], ["block"], k, fan_in).withColumnRenamed("g", group)


def percentiles(summaries: DataFrame, keys: list[str], qs: list[float], k: int = 512, fan_in: int = 16) -> DataFrame:
    """``keys``, ``n``, ``least``, ``most``, one column ``p<100 q>`` per percentile and ``rank_error``.

    Each value's true rank differs from ceil(q n) by at most ``rank_error * n``; ``least`` and ``most`` are exact.
    """
    model.utc(summaries.sparkSession)
    names = [f"p{100 * q:g}".replace(".", "_") for q in qs]
    kinds = dict(summaries.dtypes)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            found = [Summary.of(row, k, fan_in).quantiles(qs) for row in _rows(t)]
            columns = [t[c] for c in (*keys, "n", "least", "most")]
            columns += [pa.array([f[0][i] for f in found], type=pa.float64()) for i in range(len(qs))]
            columns.append(pa.array([f[1] for f in found], type=pa.float64()))
            yield from pa.table(columns, names=[*keys, "n", "least", "most", *names, "rank_error"]).to_batches()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "n long, least double, most double", *(f"{n} double" for n in names), "rank_error double"])
    return summaries.mapInArrow(run, schema)
