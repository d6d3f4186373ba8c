"""Implausible readings: spikes, stuck values and physically impossible ones, per source.

Each source runs through robust exponentially weighted control charts in time shards with margins: a suspected value is
clipped before it updates the mean and the scale, and a counter of suspects in a row tells an excursion from a lasting
step. Run-length counters find stuck values, also across shards. Physical limits come from the quantity.

The charts of all shards of a task, cut into blocks with a lead, advance in lockstep: one numpy step per value of a block
moves every chart at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model

# Values that instruments send instead of a reading (overload, underload, no sensor).
ERROR_CODES = (9.91e37, -9.91e37, 9.9e37, -9.9e37, -9999.0, -999.9)
_FIELDS = pa.schema([
    ("kind", pa.string()), ("endpoint_name", pa.string()), ("shard", pa.int64()), ("run", pa.int32()), ("reading_ids", pa.list_(pa.int64())), ("reason", pa.string()),
    ("run_n", pa.int64()), ("runs", pa.int64()), ("first_us", pa.int64()), ("last_us", pa.int64()), ("value", pa.float64()), ("left_edge", pa.bool_()), ("right_edge", pa.bool_()),
])
_STAGE = "kind string, endpoint_name string, shard long, run int, reading_ids array<long>, reason string, run_n long, runs long, first_us long, last_us long, value double, left_edge boolean, right_edge boolean"


@dataclass(frozen=True)
class Rules:
    """Parameters of the charts, runs and limits."""

    weight: float = 0.25  # of a new value in the mean
    scale_weight: float = 0.06  # of a new deviation in the scale
    clip: float = 3.0  # a deviation counts at most so many scales
    limit: float = 6.0  # scales (of about one standard deviation) beyond which a value is suspected and clipped
    report: float = 9.3  # scales that an excursion has to reach in both charts
    local_limit: float = 8.0  # the exact check: scales of the neighbouring values' scatter
    longest_spike: int = 3  # readings
    warm_up: int = 24  # values that start a chart
    chart_block: int = 512  # values that a chart judges
    chart_lead: int = 160  # values that it runs through before, by which it has forgotten its start
    least_run: int = 10  # readings
    run_factor: float = 3.0  # times the length of run that nine out of ten of a source's runs don't exceed
    shard_seconds: int = 21_600
    margin_seconds: int = 2_700
    error_codes: tuple[float, ...] = ERROR_CODES
    overload: float = 1e30  # magnitude that no quantity reaches
    #: Lowest possible value by quantity, in common units; a hair below counts as rounding.
    lowest: tuple[tuple[str, float], ...] = (("temperature", -273.15), ("pressure", 0.0))


def _medians(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first ``n`` values of each row; infinite where there are none."""
    x = np.sort(np.where(np.arange(x.shape[1]) < n[:, None], x, np.inf), axis=1)
    rows = np.arange(len(x))
    return (x[rows, np.maximum(n - 1, 0) // 2] + x[rows, np.minimum(n // 2, x.shape[1] - 1)]) / 2


def _lockstep(y: np.ndarray, count: np.ndarray, length: np.ndarray, floor: np.ndarray, r: Rules) -> np.ndarray:
    """Deviation of each value from its chart's mean, in scales. Column k of ``y`` is a chart of ``length[k]`` values, the longest first."""
    z_all = np.zeros(y.shape)
    if not y.size:
        return z_all
    head = y[: r.warm_up].T
    n = np.minimum(length, r.warm_up)
    m = _medians(head, n)
    steps = _medians(np.abs(np.diff(head, axis=1)), n - 1) if head.shape[1] > 1 else np.full(len(n), np.inf)
    s = np.where(n > 1, 1.4826 * np.minimum(_medians(np.abs(head - m[:, None]), n), steps), 0.0)
    s = np.maximum(s, floor)
    suspects = np.zeros(len(n), dtype=np.int64)
    held = np.full((len(n), r.longest_spike + 1), np.inf)
    kept = np.zeros(len(n), dtype=np.int64)
    busy = False
    active = np.searchsorted(-length, -np.arange(len(y)), side="left")  # charts longer than t
    for t in range(len(y)):
        k = active[t]
        v = y[t, :k]
        m, s = m[:k], np.maximum(s[:k], floor[:k])
        d = v - m
        e = np.abs(d)
        z = e / s
        z_all[t, :k] = z
        ok = z <= r.limit
        e = np.minimum(e, r.clip * s)
        m = m + np.where(ok, r.weight * np.copysign(e, d), 0.0)
        s = s + np.where(ok, r.scale_weight, r.scale_weight * 0.25) * (1.2533 * e - s)
        if busy:  # a plain value ends a row of suspects
            suspects[:k][ok] = 0
            kept[:k][ok] = 0
        out = np.flatnonzero(~ok)
        busy = busy or len(out) > 0
        if len(out):  # clipped: the mean stays, the scale took a capped deviation
            held[out, kept[out]] = v[out]
            kept[out] += 1
            suspects[out] += count[t, out]
            new = out[suspects[out] > r.longest_spike]
            if len(new):  # the course has not resumed: a new level
                levels = np.sort(np.where(np.arange(held.shape[1]) < kept[new, None], held[new], np.inf), axis=1)
                m[new] = levels[np.arange(len(new)), kept[new] // 2]
                suspects[new] = kept[new] = 0
    return z_all


def charts(values: np.ndarray, counts: np.ndarray, starts: np.ndarray, rules: Rules) -> np.ndarray:
    """For each value the smaller of its deviations in the forward and the backward chart, in scales.

    ``values[starts[g] : starts[g + 1]]`` are successive distinct levels of series g, each held for ``counts`` readings. A
    lasting step leaves only one of the charts on either side of it, a spike leaves both. Series of fewer than five levels
    have no chart.
    """
    size = np.diff(starts)
    floor = np.full(len(size), 1e-300)
    for g in np.flatnonzero(size >= 5):
        own = values[starts[g] : starts[g + 1]]
        floor[g] = max(float(np.median(np.abs(np.diff(own)))) * 0.05, float(np.median(np.abs(own))) * 1e-12, 1e-300)
    blocks = np.where(size >= 5, -(-size // rules.chart_block), 0)
    g = np.repeat(np.arange(len(size)), blocks)
    k = np.arange(len(g)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    a = starts[g] + k * rules.chart_block
    b = np.minimum(a + rules.chart_block, starts[g + 1])
    lead, tail = np.maximum(a - rules.chart_lead, starts[g]), np.minimum(b + rules.chart_lead, starts[g + 1])
    begin, step = np.r_[lead, tail - 1], np.repeat([1, -1], len(g))
    length, skip = np.r_[b - lead, tail - a], np.r_[a - lead, tail - b]
    order = np.argsort(-length, kind="stable")
    begin, step, length, skip, limits = begin[order], step[order], length[order], skip[order], floor[np.r_[g, g]][order]
    t = np.arange(length[0] if len(length) else 0)[:, None]
    inside = t < length
    at = np.where(inside, begin + step * t, 0)
    z = _lockstep(values[at] if at.size else np.zeros(at.shape), counts[at] if at.size else at, length, limits, rules)
    least = np.full(len(values), np.inf)
    own = inside & (t >= skip)
    for way in (1, -1):
        mine = own & (step == way)
        least[at[mine]] = np.minimum(least[at[mine]], z[mine])
    return np.where(np.isfinite(least), least, 0.0)


def _local_scatter(values: np.ndarray, suspect: np.ndarray, at: int, first: int, end: int, reach: int = 12) -> tuple[float, float, float]:
    """Of the nearest values before and after ``at`` that aren't suspected: level before, level after, scatter."""
    low, high = max(first, at - 3 * reach), min(end, at + 3 * reach + 1)
    before = low + np.flatnonzero(~suspect[low:at])[-reach:]
    after = at + 1 + np.flatnonzero(~suspect[at + 1 : high])[:reach]
    levels = [float(np.median(values[p])) if len(p) else np.nan for p in (before[-3:], after[:3])]
    parts = [values[p] for p in (before, after) if len(p) >= 2]
    d = np.abs(np.concatenate([np.diff(p) for p in parts])) if parts else np.array([])
    # mean of the absolute steps: sqrt(pi)/2 of it is the scatter of independent normal values
    return levels[0], levels[1], float(d.mean()) * 0.8862 if len(d) else 0.0


def find_spikes(values: np.ndarray, counts: np.ndarray, starts: np.ndarray, rules: Rules) -> np.ndarray:
    """True for each level that belongs to a spike of at most ``longest_spike`` readings; arguments as of :func:`charts`."""
    out = np.zeros(len(values), dtype=bool)
    if not len(values):
        return out
    z = charts(values, counts, starts, rules)
    suspect = z > rules.limit
    opens = np.zeros(len(values), dtype=bool)
    opens[starts[:-1][np.diff(starts) > 0]] = True
    rows = np.flatnonzero(np.r_[True, suspect[1:] != suspect[:-1]] | opens)  # stretches of equal suspicion within a series
    ends = np.r_[rows[1:], len(values)]
    wanted = suspect[rows] & (np.add.reduceat(counts, rows) <= rules.longest_spike) & (np.maximum.reduceat(z, rows) >= rules.report)
    series = np.searchsorted(starts, rows, side="right") - 1
    for j in np.flatnonzero(wanted):
        for k in range(rows[j], ends[j]):
            low, high, scatter = _local_scatter(values, suspect, k, starts[series[j]], starts[series[j] + 1])
            known = [x for x in (low, high) if np.isfinite(x)]
            if known and min(abs(values[k] - x) for x in known) > rules.local_limit * max(scatter, 1e-300):
                # between two levels lies a step, not a spike
                out[k] = len(known) < 2 or not (min(known) < values[k] < max(known))
    return out


def _lists(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct keys, which come sorted, and the ids of each as lists."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return keys[first], pa.ListArray.from_arrays(pa.array(np.r_[first, len(keys)], type=pa.int32()), pa.array(ids, type=pa.int64()))


def _rows(n: int, **columns: object) -> pa.RecordBatch:
    full = {f.name: columns.get(f.name) for f in _FIELDS}
    arrays = [pa.nulls(n, f.type) if full[f.name] is None else pa.array([full[f.name]] * n, type=f.type) if isinstance(full[f.name], str) else pa.array(full[f.name], type=f.type) for f in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, schema=_FIELDS)


def _findings(t: pa.Table, rules: Rules) -> Iterator[pa.RecordBatch]:
    """Findings of whole shards: hits, histograms of inner runs, and the runs that touch a shard's edge or are long."""
    names = t["endpoint_name"].combine_chunks().dictionary_encode()
    ep, shard, us, ids, v, flags = (names.indices.to_numpy(), *(t[c].to_numpy() for c in ("shard", "us", "reading_id", "v", "flags")))
    order = np.lexsort((ids, us, shard, ep))
    ep, shard, us, ids, v, flags = (x[order] for x in (ep, shard, us, ids, v, flags))
    gid = np.cumsum(np.r_[True, (ep[1:] != ep[:-1]) | (shard[1:] != shard[:-1])]) - 1
    # each reading once in its shard, the first of its deliveries
    by_id = np.lexsort((np.arange(len(ids)), ids, gid))
    once = np.sort(by_id[np.r_[True, (gid[by_id][1:] != gid[by_id][:-1]) | (ids[by_id][1:] != ids[by_id][:-1])]])
    ep, shard, us, ids, v, flags, gid = (x[once] for x in (ep, shard, us, ids, v, flags, gid))
    opens = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    name_of = lambda g: names.dictionary.take(pa.array(ep[opens[g]]))
    bad, core = (flags & 1).astype(bool), (flags & 2).astype(bool)

    def hits(chosen: np.ndarray, reason: str) -> Iterator[pa.RecordBatch]:
        g, lists = _lists(ids[chosen], gid[chosen])
        if len(g):
            yield _rows(len(g), kind="hit", endpoint_name=name_of(g), shard=shard[opens[g]], reading_ids=lists, reason=reason)

    yield from hits(bad & core, "impossible")
    x, xg = v[~bad], gid[~bad]
    if len(x):
        first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (xg[1:] != xg[:-1])])
        counts = np.diff(np.r_[first, len(x)])
        starts = np.searchsorted(xg[first], np.arange(gid[-1] + 2))
        flagged = np.zeros(len(v), dtype=bool)
        flagged[~bad] = np.repeat(find_spikes(x[first], counts, starts, rules), counts)
        yield from hits(flagged & core, "spike")
    cv, cu, ci, cg = v[core], us[core], ids[core], gid[core]
    if not len(cv):
        return
    first = np.flatnonzero(np.r_[True, (cv[1:] != cv[:-1]) | (cg[1:] != cg[:-1])])
    counts = np.diff(np.r_[first, len(cv)])
    g = cg[first]
    left, right = np.r_[True, g[1:] != g[:-1]], np.r_[g[1:] != g[:-1], True]
    inner = ~(left | right)
    kinds, many = np.unique(ep[opens[g[inner]]].astype(np.int64) << 40 | counts[inner], return_counts=True)
    if kinds.size:
        yield _rows(len(many), kind="runs", endpoint_name=names.dictionary.take(pa.array(kinds >> 40)), run_n=kinds & (2**40 - 1), runs=many)
    told = np.flatnonzero(~inner | (counts >= rules.least_run))
    number = np.arange(len(first)) - np.searchsorted(g, g)  # of the run in its shard
    belongs = np.repeat(np.arange(len(first)), counts)
    listed = np.isin(belongs, told)
    _, lists = _lists(ci[listed], belongs[listed])
    yield _rows(
        len(told), kind="run", endpoint_name=name_of(g[told]), shard=shard[opens[g[told]]], run=number[told], reading_ids=lists, run_n=counts[told],
        first_us=cu[first[told]], last_us=cu[first[told] + counts[told] - 1], value=cv[first[told]], left_edge=left[told], right_edge=right[told])


def _stage(rules: Rules, block: int):
    """Over rows sorted by ``g``: findings of about ``block`` rows at a time, shards whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if b.num_rows and count >= block:
                g = b["g"].to_numpy()
                cut = int(np.searchsorted(g != held[-1]["g"][-1].as_py(), True)) if g[0] == held[-1]["g"][-1].as_py() else 0
                if cut < b.num_rows:
                    held.append(b.slice(0, cut))
                    yield from _findings(pa.Table.from_batches(held), rules)
                    held, count, b = [], 0, b.slice(cut)
            if b.num_rows:
                held.append(b)
                count += b.num_rows
        if held:
            yield from _findings(pa.Table.from_batches(held), rules)

    return run


def impossible(raw: str = "value_raw", common: str = "value_common", quantity: str = "quantity", rules: Rules = Rules()):
    """Condition: an error or overload code, or below the quantity's lowest value (absolute zero, no absolute pressure)."""
    low = F.lit(False)
    for q, least in rules.lowest:
        low = low | ((F.col(quantity) == q) & (F.col(common) < least - 1e-9 * max(1.0, abs(least)) if least else F.col(common) < 0))
    return F.coalesce(F.col(raw).isin([float(c) for c in rules.error_codes]) | (F.abs(raw) >= rules.overload) | low, F.lit(False))


def flag_implausible(
    readings: DataFrame, rules: Rules = Rules(), partitions: int | None = None, block: int = model.ROWS_PER_TASK, rows_per_shard: int = model.ROWS_PER_TASK, sizes: DataFrame | None = None
) -> DataFrame:
    """``(reading_id, endpoint_name, reason)`` of the implausible readings; a reading may have several reasons.

    ``readings`` has reading_id, endpoint_name, timestamp, value_raw, value_common and quantity, as
    :func:`tidegauge.operators.units.to_common_units` gives them; values without a known unit compare as they are.
    Reasons: ``impossible`` (an error code, overload, below absolute zero, negative absolute pressure), ``spike`` (leaves
    the course of the neighbouring values from both sides and resumes it after at most ``longest_spike`` readings), and
    ``stuck`` (a run of at least ``least_run`` equal values that is ``run_factor`` times longer than nine of ten runs of
    its source, all its readings). Sources whose usual run has ``least_run`` readings or more hold values by nature and have neither
    spikes nor stuck values. NULL and NaN values and NULL ids, endpoints and times take no part; a reading
    delivered more than once counts once; equal timestamps are ordered by id.

    Shards are (endpoint, ``shard_seconds``) with ``margin_seconds`` of the neighbours on either side for the charts. Both are
    halved for an endpoint until none of its shards has more than about ``rows_per_shard`` readings, which are counted in
    ``sizes`` (with endpoint_name and timestamp; else in ``readings``). Shards are hashed to ``partitions`` (else one per
    200,000 readings, for which the input is counted), and a task works on about ``block`` readings at once, whole shards.
    The shards' findings are checkpointed. Runs that touch a shard's edge are joined to the next shard's by their lengths
    and values alone, two rows a shard; the readings' ids are looked up afterwards, for the stuck runs only.
    """
    spark = readings.sparkSession
    model.utc(spark)
    us = model.micros("timestamp")
    width, margin = rules.shard_seconds * 1_000_000, rules.margin_seconds * 1_000_000
    value = F.coalesce("value_common", "value_raw")
    r = readings.where(model.has_value("value_raw")).where("reading_id is not null and endpoint_name is not null and timestamp is not null")
    r = r.select("endpoint_name", F.col("reading_id").cast("long").alias("reading_id"), us.alias("us"), value.alias("v"), impossible(rules=rules).alias("bad"))
    counted = r if sizes is None else sizes.where("endpoint_name is not null and timestamp is not null").select("endpoint_name", us.alias("us"))
    dense = counted.groupBy("endpoint_name", model.floor_div(F.col("us"), width)).agg(F.count("*").alias("n")).groupBy("endpoint_name").agg(F.max("n").alias("n"))
    dense = model.local_if_small(dense.where(F.col("n") > rows_per_shard).select("endpoint_name", F.ceil(F.log2(F.col("n") / rows_per_shard)).cast("int").alias("halvings")))
    if not dense.isEmpty():
        r = r.join(model.broadcast_if_small(dense), "endpoint_name", "left")
        halvings = F.coalesce("halvings", F.lit(0))
        width = F.call_function("shiftright", F.lit(width), halvings)
        margin = F.least(F.lit(margin), width)
    own = model.floor_div(F.col("us"), width)
    around = F.array_distinct(F.array(own, model.floor_div(F.col("us") - margin, width), model.floor_div(F.col("us") + margin, width)))
    r = r.select("*", own.alias("own"), F.explode(around).alias("shard"))
    flags = (F.col("bad").cast("int") + 2 * (F.col("own") == F.col("shard")).cast("int")).cast("byte")
    r = r.select(F.xxhash64("endpoint_name", "shard").alias("g"), "endpoint_name", "shard", "us", "reading_id", "v", flags.alias("flags"))
    model.checkpoint_dir(spark)
    # a fixed number of partitions: small ones aren't merged, as the work lies in the rows and not in the bytes
    r = r.repartition(partitions or model.partitions_for(readings, 200_000), "g").sortWithinPartitions("g")
    found = r.mapInArrow(_stage(rules, block), _STAGE).checkpoint()

    run = found.where("kind = 'run'").select("endpoint_name", "shard", "run", "run_n", "first_us", "last_us", "value", "left_edge", "right_edge")
    edge = run.where("left_edge or right_edge")
    w = W.partitionBy("endpoint_name").orderBy("first_us", "last_us")
    chained = F.col("left_edge") & F.lag("right_edge").over(w) & (F.lag("value").over(w) == F.col("value"))
    edge = edge.withColumn("chain", F.when(F.coalesce(chained, F.lit(False)), 0).otherwise(1))
    edge = edge.select("endpoint_name", "shard", "run", "run_n", F.sum("chain").over(w).alias("chain"))
    edge = edge.withColumn("n", F.sum("run_n").over(W.partitionBy("endpoint_name", "chain"))).withColumn("head", F.row_number().over(W.partitionBy("endpoint_name", "chain").orderBy("shard", "run")) == 1)
    usual = found.where("kind = 'runs'").select("endpoint_name", "run_n", "runs").union(edge.where("head").select("endpoint_name", "n", F.lit(1).cast("long")))
    usual = usual.groupBy("endpoint_name", "run_n").agg(F.sum("runs").alias("runs"))
    up = W.partitionBy("endpoint_name").orderBy("run_n")
    usual = usual.withColumn("upto", F.sum("runs").over(up)).withColumn("all", F.sum("runs").over(W.partitionBy("endpoint_name")))
    usual = usual.groupBy("endpoint_name").agg(
        F.min(F.when(F.col("upto") >= 0.5 * F.col("all"), F.col("run_n"))).alias("half"),
        F.min(F.when(F.col("upto") >= 0.9 * F.col("all"), F.col("run_n"))).alias("most"),
    )
    usual = model.local_if_small(usual)
    long = run.where("not (left_edge or right_edge)").select("endpoint_name", "shard", "run", F.col("run_n").alias("n"))
    stuck = long.union(edge.select("endpoint_name", "shard", "run", "n")).where(F.col("n") >= rules.least_run).join(usual, "endpoint_name")
    stuck = stuck.where((F.col("half") < rules.least_run) & (F.col("n") >= rules.run_factor * F.col("most"))).select("endpoint_name", "shard", "run")
    ids = found.where("kind = 'run'").select("endpoint_name", "shard", "run", "reading_ids").join(stuck, ["endpoint_name", "shard", "run"])
    hits = found.where("kind = 'hit'").join(usual, "endpoint_name", "left")
    hits = hits.where((F.col("reason") != "spike") | F.coalesce(F.col("half") < rules.least_run, F.lit(True)))
    out = hits.select("endpoint_name", "reason", F.explode("reading_ids").alias("reading_id"))
    out = out.union(ids.select("endpoint_name", F.lit("stuck"), F.explode("reading_ids")))
    return out.select("reading_id", "endpoint_name", "reason").distinct()
