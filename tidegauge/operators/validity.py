"""Attributes of an entity as they were known at the time of an event.

An *entry* says from when on it is known (``entered_at``) and by a condition on the UTC date
(``valid_if``) when it applies. :func:`current_states` turns the entries of each entity into
availability-ordered versions of the state then current; :func:`as_known_at` gives each event the
version in force by an embedded DuckDB ``ASOF LEFT JOIN`` per hash bucket.
"""

from __future__ import annotations

import datetime as dt
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model
from tidegauge.functions import expr

#: Days on which conditions are evaluated; a date beyond them counts like the first or the last.
FIRST_DAY, LAST_DAY = dt.date(1970, 1, 1), dt.date(2099, 12, 31)
FOREVER = 2**62
STATE_SCHEMA = "endpoint_name string, from_us long, entry_id long, default_calibration string, label string"
_SIMPLE = re.compile(r"^\s*\d{1,8}\s*$")


def endpoint_of(setup: str | None = None) -> Column:
    """Endpoint that an entry is bound to: ``dripline_endpoint``, else the sensor name without the setup, its first
    component replaced by the input name of ``default_calibration`` if there is one, joined by ``_``.

    ``setup`` is the last component to drop; None drops whatever stands last.
    """
    parts = F.split("sensor_name", r"\.")
    if setup is None:
        parts = F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    else:
        parts = F.when(F.lower(F.element_at(parts, -1)) == setup.lower(), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    given = F.trim(F.element_at(F.split("default_calibration", ":"), 1))
    first = F.when(F.col("default_calibration").contains(":") & (given != ""), given).otherwise(F.element_at(parts, 1))
    own = F.array_join(F.concat(F.array(first), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))), "_")
    bound = F.trim("dripline_endpoint")
    return F.when(bound != "", bound).otherwise(own)


def bound_entries(entries: DataFrame, setup: str | None = None) -> DataFrame:
    """Each entry once, with the endpoint it is bound to. Entries without id, endpoint or ``entered_at`` are never known and drop out."""
    e = entries.select(
        "entry_id", endpoint_of(setup).alias("endpoint_name"), model.micros("entered_at").alias("entered_us"),
        "valid_if", "default_calibration", "label", "sensor_name",
    )
    return e.where("entry_id is not null and endpoint_name is not null and entered_us is not null").dropDuplicates(["entry_id"])


def _calendar() -> tuple[list[int], list[int]]:
    n = (LAST_DAY - FIRST_DAY).days + 1
    days = [FIRST_DAY + dt.timedelta(i) for i in range(n)]
    origin = dt.date(1970, 1, 1)
    return [d.year * 10000 + d.month * 100 + d.day for d in days], [(d - origin).days * 86_400_000_000 for d in days]


def _dates_in(node: object) -> set[int] | None:
    """Literals with which ``date`` is compared; None if the condition can change on other days too."""
    if not isinstance(node, tuple):
        return set()
    if node[0] == "bin" and node[1] in ("<", ">", "<=", ">=", "==", "!="):
        sides = node[2:]
        if ("name", "date") in sides:
            other = sides[1] if sides[0] == ("name", "date") else sides[0]
            return {int(other[1]), int(other[1]) + 1} if other[0] == "lit" and isinstance(other[1], (int, float)) else None
        return None if "date" in repr(node) else set()
    if node == ("name", "date"):
        return None
    if node[0] in ("lit", "name"):
        return set()
    found: set[int] = set()
    for x in node[1:]:
        got = _dates_in(x)
        if got is None:
            return None
        found |= got
    return found


def valid_spans(condition: str | None, version: int, calendar: tuple[list[int], list[int]] | None = None) -> list[tuple[int, int]]:
    """Half-open spans (microseconds, UTC days) in which a condition holds."""
    numbers, starts = calendar or _calendar()
    first, last = -FOREVER, FOREVER
    try:
        node = expr.parse(condition) if condition and condition.strip() else None
    except expr.ExpressionError:
        node = None
    if node is None:
        return [(first, last)]
    dates = _dates_in(node)
    cuts = range(len(numbers)) if dates is None else sorted({0, *(min(bisect_left(numbers, d), len(numbers) - 1) for d in dates)})
    out: list[tuple[int, int]] = []
    edges = [*cuts]
    for n, i in enumerate(edges):
        try:
            held = expr._bool(expr.evaluate(node, {"version": version, "date": numbers[i]}), "condition")
        except expr.ExpressionError:
            held = True
        if held:
            begin = first if i == 0 else starts[i]
            end = starts[edges[n + 1]] if n + 1 < len(edges) else last
            if out and out[-1][1] == begin:
                out[-1] = (out[-1][0], end)
            else:
                out.append((begin, end))
    return out


def _states(version: int):
    calendar: list = []

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        if not calendar:
            calendar.append(_calendar())
        rows = group.sort_values(["entered_us", "entry_id"]).itertuples(index=False)
        spans = []
        for rank, r in enumerate(rows):  # a later rank wins: latest entered_at, then largest entry_id
            for begin, end in valid_spans(None if pd.isna(r.valid_if) else r.valid_if, version, calendar[0]):
                if (begin := max(begin, r.entered_us)) < end:
                    spans.append((begin, end, rank, r))
        spans.sort(key=lambda s: s[:3])
        times = sorted({t for s in spans for t in s[:2] if t < FOREVER})
        out, active, at, now = [], [], 0, None
        for t in times:
            while at < len(spans) and spans[at][0] <= t:
                heapq.heappush(active, (-spans[at][2], spans[at][1], at))
                at += 1
            while active and active[0][1] <= t:
                heapq.heappop(active)
            top = spans[active[0][2]][3] if active else None
            if (top.entry_id if top else None) != now:
                now = top.entry_id if top else None
                out.append((key[0], t, now, top.default_calibration if top else None, top.label if top else None))
        frame = pd.DataFrame(out, columns=["endpoint_name", "from_us", "entry_id", "default_calibration", "label"])
        return frame.astype({"entry_id": "Int64"})

    return run


def current_states(entries: DataFrame, version: int = 1) -> DataFrame:
    """Versions ``(endpoint_name, from_us, entry_id, default_calibration, label)`` of each endpoint, in force until the next.

    ``entries`` come from :func:`bound_entries`. A NULL ``entry_id`` marks times at which no entry applies. Of several
    entries in force the one with the latest ``entered_at`` counts, then the one with the largest ``entry_id``.
    One group holds the entries of one endpoint.
    """
    model.utc(entries.sparkSession)
    return entries.groupBy("endpoint_name").applyInPandas(_states(version), STATE_SCHEMA)


_ASOF = """
    select r.* exclude (endpoint__, us__), s.entry_id, s.default_calibration, s.label
    from events r asof left join states s on r.endpoint__ = s.endpoint_name and r.us__ >= s.from_us
"""


def _asof(events: pa.Table, states: pa.Table, con) -> pa.Table:
    con.register("events", events)
    con.register("states", states)
    out = con.sql(_ASOF).to_arrow_table()
    con.unregister("events")
    con.unregister("states")
    return out


def _connection(memory_mb: int = 300):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB"})
    con.execute("set preserve_insertion_order = false")
    return con


def as_known_at(
    events: DataFrame,
    states: DataFrame,
    endpoint: str = "endpoint_name",
    at_us: str = "at_us",
    slice_seconds: int = 21_600,
    rows_per_task: int = model.ROWS_PER_TASK,
    broadcast_rows: int = model.BROADCAST_ROWS,
    buckets: int | None = None,
) -> DataFrame:
    """Every event row with ``entry_id``, ``default_calibration`` and ``label`` of the state in force at ``at_us``.

    Events are hash-partitioned on (endpoint, time slice), so that a hot endpoint spreads over many buckets, and each
    bucket runs one DuckDB ``ASOF LEFT JOIN`` against the states. The states travel to the buckets as a broadcast value
    if they are at most ``broadcast_rows``; otherwise both sides are cogrouped, and a bucket gets the states that begin in
    its slices and the one in force when each slice begins.
    All columns of the events are kept; those of the same name as an attribute get ``_event`` behind it, as often as needed.
    Events with a NULL endpoint or time, or before the first state, get NULLs.
    """
    spark = events.sparkSession
    model.utc(spark)
    for name in ("entry_id", "default_calibration", "label"):
        if (new := name) in events.columns:
            while new in events.columns:
                new += "_event"
            events = events.withColumnRenamed(name, new)
    schema = events.schema
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "entry_id long", "default_calibration string", "label string"])
    keyed = events.withColumns({"endpoint__": F.col(endpoint), "us__": F.col(at_us)})
    n = buckets or model.partitions_for(events, rows_per_task)
    slice_of = F.floor(F.col("us__") / (slice_seconds * 1_000_000))
    names = [*schema.fieldNames(), "entry_id", "default_calibration", "label"]
    rows = model.collected_if_small(states, broadcast_rows)
    if rows is not None:
        fields = pa.schema([("endpoint_name", pa.string()), ("from_us", pa.int64()), ("entry_id", pa.int64()), ("default_calibration", pa.string()), ("label", pa.string())])
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])

        def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            con = _connection()
            table = pa.Table.from_pylist([dict(zip(fields.names, r)) for r in sent.value], schema=fields)
            held, count = [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                yield from _asof(pa.Table.from_batches(held), table, con).select(names).to_batches(max_chunksize=50_000)

            for b in batches:
                held.append(b)
                count += b.num_rows
                if count >= rows_per_task:
                    yield from flush()
                    held, count = [], 0
            if count:
                yield from flush()
            con.close()

        return keyed.repartition(n, "endpoint__", slice_of).mapInArrow(bucket, out_schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        con = _connection()
        out = _asof(left.drop(["bucket__"]), right.drop(["bucket__"]), con).select(names)
        con.close()
        return out

    bucket_of = lambda e, k: F.pmod(F.hash(e, k), F.lit(n))
    left = keyed.withColumn("bucket__", bucket_of("endpoint__", slice_of))
    right = _sliced(states, keyed.select(F.col("endpoint__").alias("endpoint_name"), slice_of.alias("k__")), slice_seconds * 1_000_000)
    right = right.withColumn("bucket__", bucket_of("endpoint_name", F.col("k__"))).drop("k__")
    return left.groupBy("bucket__").cogroup(right.groupBy("bucket__")).applyInArrow(both, out_schema)


def _sliced(states: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """The states with the time slice ``k__`` they begin in, and for each (endpoint, slice) of ``cells`` the state in force when it begins.

    The window that carries states on holds one row per state and slice of an endpoint, no events.
    """
    own = states.withColumn("k__", F.floor(F.col("from_us") / width))
    state = F.struct(*states.columns)
    marks = cells.where("endpoint_name is not null and k__ is not null").distinct()
    marks = marks.select("endpoint_name", (F.col("k__") * width).alias("at__"), "k__", F.lit(None).cast(states.schema).alias("s__"))
    marks = marks.union(states.select("endpoint_name", "from_us", F.lit(None).cast("long"), state))
    w = W.partitionBy("endpoint_name").orderBy("at__").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = marks.withColumn("s__", F.last("s__", ignorenulls=True).over(w)).where("k__ is not null and s__ is not null")
    return carried.select("s__.*", "k__").union(own)


def join_intervals(events: DataFrame, intervals: DataFrame, on: str, at: str, start: str, stop: str, how: str = "inner", slice_seconds: int = 86_400, broadcast_rows: int = model.BROADCAST_ROWS) -> DataFrame:
    """Events with the columns of every interval of the same ``on`` with ``start`` <= ``at`` < ``stop`` (timestamps without zone).

    ``how`` is ``inner`` or ``left``. Interval columns whose names the events have get the suffix ``_interval``. NULL keys,
    times and bounds match nothing. At most ``broadcast_rows`` intervals are broadcast; more of them are cut at slices of
    time, within the events' whole span, and joined by (key, slice), so that neither a hot key nor a key with many
    intervals makes a task compare all with all.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no interval join {how}")
    spark = events.sparkSession
    model.utc(spark)
    names = {c: f"{c}_interval" if c in events.columns else c for c in intervals.columns}
    i = intervals.where(F.col(on).isNotNull() & (F.col(start) < F.col(stop)))
    i = i.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(on).alias("on__"), model.micros(start).alias("a__"), model.micros(stop).alias("b__"))
    e = events.withColumn("at__", model.micros(at))
    inside = (e[on] == F.col("on__")) & (F.col("at__") >= F.col("a__")) & (F.col("at__") < F.col("b__"))
    wanted = [*(F.col(c) for c in events.columns), *(F.col(n) for n in names.values())]
    small = model.broadcast_if_small(i, broadcast_rows)
    if small is not i:
        return e.join(small, inside, how).select(*wanted)
    width = slice_seconds * 1_000_000
    span = e.agg(F.min("at__"), F.max("at__")).first()
    lo, hi = (0, 0) if span[0] is None else (span[0] // width, span[1] // width)
    first, last = F.greatest(model.floor_div(F.col("a__"), width), F.lit(lo)), F.least(model.floor_div(F.col("b__") - 1, width), F.lit(hi))
    i = i.where(first <= last).withColumn("k__", F.explode(F.sequence(first, last)))
    e = e.withColumn("ek__", model.floor_div(F.col("at__"), width))
    return e.join(i, (F.col("ek__") == F.col("k__")) & inside, how).select(*wanted)
