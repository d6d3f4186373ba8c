"""The general data problems on small tables: true cases, dirty rows, empty tables, extra columns."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.operators import regular_grid, spikes, units, validity

ENTRIES = "entry_id long, sensor_number long, sensor_name string, label string, dripline_endpoint string, valid_if string, default_calibration string, entered_at timestamp_ntz"
D = dt.datetime


@pytest.fixture
def unit_def(spark):
    rows = [("mbar", "pressure", "mbar", 1.0, 0.0), ("Pa", "pressure", "mbar", 0.01, 0.0), ("Torr", "pressure", "mbar", 1.333224, 0.0), ("degC", "temperature", "degC", 1.0, 0.0), ("K", "temperature", "degC", 1.0, -273.15), ("degF", "temperature", "degC", 5 / 9, -160 / 9), ("psia", "pressure", "mbar", 68.947573, 0.0)]
    return spark.createDataFrame(rows, "unit string, quantity string, common_unit string, factor double, shift double")


@pytest.fixture
def entries(spark):
    def make(rows):
        return spark.createDataFrame([(r[0], 1, r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows], ENTRIES)

    return make


def brute_state(rows, endpoint, when):
    """Entry in force by the definition."""
    from tidegauge.functions.expr import condition_holds

    number = when.year * 10000 + when.month * 100 + when.day
    known = [r for r in rows if r["endpoint"] == endpoint and r["entered"] is not None and r["entered"] <= when and condition_holds(r["valid_if"], {"version": 1, "date": number})]
    return max(known, key=lambda r: (r["entered"], r["id"]))["id"] if known else None


def test_binding(spark, entries):
    e = entries([
        (1, "K.Pt1.Src.LYRA", None, None, None, "degC:degC+1", D(2021, 1, 1)), (2, "A.B.LYRA", None, "given", None, None, D(2021, 1, 1)),
        (3, "x.y.lyra", None, None, None, None, D(2021, 1, 1)), (4, None, None, None, None, None, D(2021, 1, 1)), (5, "q.LYRA", None, None, None, None, None),
        (2, "A.B.LYRA", None, "given", None, None, D(2021, 1, 1)), (6, "a.b", None, "", None, "plain", D(2021, 1, 1)),
    ])
    got = {r["entry_id"]: r["endpoint_name"] for r in validity.bound_entries(e, "LYRA").collect()}
    assert got == {1: "degC_Pt1_Src", 2: "given", 3: "x_y", 6: "a_b"}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_states_against_brute_force(spark, entries, readings, broadcast_rows):
    rng = random.Random(2)
    forms = [None, "", "date >= {a}", "date<{b}&&date>={a}", "!(date < {a} || date >= {b})", "{a} <= date", "date > {a} && version >= 2", "date >= 2O2101", "date % 2 == 0", "date == {a}", "date != {a}", "version == 1", "date - {a} > 2"]
    rows = []
    for k in range(60):
        a, b = sorted(20210101 + rng.randrange(12) for _ in range(2))
        rows.append({"id": k, "endpoint": rng.choice(["e1", "e2", "e3"]), "entered": D(2020, 12, 30) + dt.timedelta(hours=rng.randrange(300)), "valid_if": None if (f := rng.choice(forms)) is None else f.format(a=a, b=b)})
    rows.append({"id": 100, "endpoint": "e1", "entered": rows[0]["entered"], "valid_if": None})
    e = entries([(r["id"], r["endpoint"] + ".L", "l", r["endpoint"], r["valid_if"], None, r["entered"]) for r in rows] * 2)
    events = [(k, rng.choice(["e1", "e2", "e3", "none", None]), None if rng.random() < 0.02 else rng.randrange(-500_000, 800_000), 1.0) for k in range(400)]
    events += [(1000, "e1", (rows[0]["entered"] - D(2021, 1, 5)).total_seconds(), 1.0)]
    df = readings([(k, e_, None if s is None else float(s), v) for k, e_, s, v in events]).withColumns({"at_us": model.micros("timestamp"), "label": F.lit("own"), "entry_id": F.lit(7)})
    out = validity.as_known_at(df, validity.current_states(validity.bound_entries(e)), broadcast_rows=broadcast_rows, buckets=4)
    assert "label_event" in out.columns and "entry_id_event" in out.columns
    got = {r["reading_id"]: r["entry_id"] for r in out.collect()}
    assert len(got) == len(events)
    for k, name, s, _ in events:
        want = None if name is None or s is None else brute_state(rows, name, D(2021, 1, 5) + dt.timedelta(seconds=s))
        assert got[k] == want, (k, name, s)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_interval_join(spark, readings, broadcast_rows):
    rng = random.Random(9)
    events = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400_000, 777)]), 1.0) for k in range(300)]
    spans = [(rng.choice(["a", "b", "c", None]), a, a + rng.choice([0, -5, 10_000, 300_000]), i) for i, a in enumerate(rng.randrange(-100_000, 400_000) for _ in range(60))] + [("a", None, 5, 100), ("a", 5, None, 101)]
    at = lambda s: None if s is None else D(2021, 1, 5) + dt.timedelta(seconds=s)
    intervals = spark.createDataFrame([(n, at(a), at(b), i) for n, a, b, i in spans], "endpoint_name string, a timestamp_ntz, b timestamp_ntz, reading_id int")
    df = readings([(k, e, None if s is None else float(s), v) for k, e, s, v in events])
    out = validity.join_intervals(df, intervals, "endpoint_name", "timestamp", "a", "b", "left", broadcast_rows=broadcast_rows)
    assert {"endpoint_name_interval", "reading_id_interval"} <= set(out.columns)
    got = sorted((r["reading_id"], r["reading_id_interval"]) for r in out.where("reading_id_interval is not null").collect())
    want = sorted((k, i) for k, e, s, _ in events for n, a, b, i in spans if e is not None and e == n and None not in (s, a, b) and a <= s < b)
    assert got == want
    assert out.select("reading_id").distinct().count() == 300
    assert validity.join_intervals(df.where("false"), intervals, "endpoint_name", "timestamp", "a", "b", broadcast_rows=broadcast_rows).count() == 0


def test_states_of_empty_tables(spark, entries, readings):
    states = validity.current_states(validity.bound_entries(entries([])))
    assert states.count() == 0
    df = readings([(1, "e", 0.0, 1.0)]).withColumn("at_us", model.micros("timestamp"))
    assert validity.as_known_at(df, states).collect()[0]["entry_id"] is None
    assert validity.as_known_at(df.where("false"), states).count() == 0


def test_units(spark, entries, readings, unit_def):
    e = entries([
        (1, "t.x.L", "Line pressure, gauge reads psi absolute", "Gauge_x", None, None, D(2021, 1, 1)), (2, "t.y.L", "see Torr chart for the old gauge", "Temp_y", None, None, D(2021, 1, 1)),
        (3, "mbar.z.L", "Wall (Celsius)", "mbar_z", None, "Pa:Pa/100", D(2021, 1, 1)), (4, "mbar.z.L", None, "mbar_z", "date >= 20210106", "Torr:Torr", D(2021, 1, 2)),
    ])
    rows = [
        (1, "Gauge_x", 0.0, 2.0), (2, "Temp_y", 0.0, 2.0), (3, "mbar_z", 0.0, 100.0), (4, "mbar_z", 90_000.0, 100.0), (5, "degC_a", 0.0, 10.0), (6, "degC_a", 1.0, 300.0, "value in K"),
        (7, "degC_a", 2.0, 50.0, "50 °F"), (8, "degC_a", 3.0, 50.0, "panel shows 51 deg F"), (9, "degC_a", 4.0, 5.0, "valve opened at 5 psi on the feed line"), (10, "degC_a", 5.0, 1.0, "kelvin probe not installed yet"),
        (11, "degC_a", 6.0, 1.0, "this one is kelvin, panel was switched"), (12, "degC_a", 7.0, 1.0, "[ Deg  F ]"), (13, "degC_a", 8.0, None, "unit: K"), (14, "degC_a", 9.0, float("nan")), (15, None, 1.0, 1.0, "Einheit Torr"),
        (16, "mbar_q", None, 1.0), (17, "Load_a", 0.0, 3.0, ""), (18, "degC_a", 0.0, 300.0, "see note on mbar scale in manual"), (19, "degC_a", 0.0, 1.0, "x" * 200_000), (1, "Gauge_x", 0.0, 2.0),
    ]
    df = readings(rows).withColumns({"factor": F.lit("own"), "unit": F.lit("own"), "source_unit": F.lit(1), "alias": F.lit(2), "from_us": F.lit(3)})
    states = validity.current_states(validity.bound_entries(e))
    for bound in (100_000, 0):
        out = units.to_common_units(df, states, unit_def, bound).collect()
        got = {r["reading_id"]: (r["unit"], None if r["value_common"] is None else round(r["value_common"], 3)) for r in out}
        assert got == {
            1: ("psia", 137.895), 2: (None, None), 3: ("Pa", 1.0), 4: ("Torr", 133.322), 5: ("degC", 10.0), 6: ("K", 26.85), 7: ("degF", 10.0), 8: ("degC", 50.0), 9: ("degC", 5.0), 10: ("degC", 1.0),
            11: ("K", -272.15), 12: ("degF", -17.222), 13: ("K", None), 14: ("degC", None), 15: ("Torr", 1.333), 16: ("mbar", 1.0), 17: (None, None), 18: ("degC", 300.0), 19: ("degC", 1.0),
        }
        assert len(out) == len(rows) and out[0]["factor"] == "own" and out[0]["source_unit"] == 1
    assert units.to_common_units(df.where("false"), states, unit_def).count() == 0
    assert units.to_common_units(df, states, unit_def.where("false")).where("unit is not null").count() == 0


def test_grid(spark, readings):
    rows = [(1, "a", 0.0, 1.0), (2, "a", 3.0, 3.0), (2, "a", 3.0, 3.0), (3, "a", 25.0, 5.0), (4, "a", 31.0, None), (5, "a", 120.0, float("nan")), (6, "a", 110.0, 7.0), (7, "a", 86_405.0, 1.0), (8, "none", 1.0, 1.0), (9, None, 1.0, 1.0), (None, "a", 26.0, 7.0), (10, "a", None, 1.0), (11, "b", 5.0, 2.0)]
    periods = spark.createDataFrame([(1, "a", 10), (2, "none", None), (3, "b", 7), (4, "c", 10), (5, "a", 10), (6, None, 10), (7, "z", 0)], "endpoint_id int, endpoint_name string, period_s int")
    df = readings(rows).withColumns({"n": F.lit("x"), "cell": F.lit(1), "day": F.lit(2)})
    start = 1609804800
    s = regular_grid.regular_series(df, periods, max_gap_s=30)
    got = [(r["cell_start"] - start, r["n"], r["value"], r["filled"], r["status"]) for r in s.where("endpoint_name = 'a'").orderBy("cell_start").collect()]
    assert got == [
        (0, 2, 2.0, 2.0, "read"), (10, 0, None, 2.0, "filled"), (20, 2, 6.0, 6.0, "read"), (30, 0, None, 6.0, "filled"), (40, 0, None, 6.0, "filled"), (50, 0, None, 6.0, "filled"),
        (60, 0, None, None, "missing"), (70, 0, None, None, "missing"), (80, 0, None, None, "missing"), (90, 0, None, None, "missing"), (100, 0, None, None, "missing"), (110, 1, 7.0, 7.0, "read"), (86_400, 1, 1.0, 1.0, "read"),
    ]
    assert {r["endpoint_name"] for r in s.collect()} == {"a", "b"}
    assert regular_grid.empty_cells(s).count() == 9
    shuffled = regular_grid.regular_series(df, periods, max_gap_s=30, broadcast_rows=0)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, s.collect()))
    assert regular_grid.regular_series(df.where("false"), periods).count() == 0
    assert regular_grid.regular_series(df, periods.where("false")).count() == 0


def test_spikes(spark, readings):
    rng = np.random.default_rng(5)
    n = 3000
    quiet = rng.normal(20, 0.1, n)
    quiet[1000:] += 5  # a lasting step
    quiet[1500:1600] += np.linspace(0, 8, 100)  # a rise
    quiet[1600:] += 8
    quiet[2000:2300] += rng.normal(0, 0.6, 300)  # a louder hour
    truth = set()
    for at, size, length in ((300, 4.0, 1), (500, -6.0, 3), (2500, 5.0, 2), (2, 5.0, 1), (2997, -5.0, 1)):
        quiet[at : at + length] += size
        truth |= set(range(at, at + length))
    quiet[700:706] += 5.0  # an excursion of six: not a spike
    quiet[1200:1215] = quiet[1200]  # stuck
    truth |= set(range(1200, 1215))
    quiet[2700:2705] = [-300.0, 9.91e37, -9999.0, 9.91e37, 9.91e37]
    truth |= set(range(2700, 2705))
    rows = [(k, "degC_a", 10.0 * k, float(v)) for k, v in enumerate(quiet)]
    held = np.repeat(rng.integers(0, 2, 40), rng.integers(20, 60, 40))[:1000]
    rows += [(10_000 + k, "Status_a", 30.0 * k, float(v)) for k, v in enumerate(held)]
    noise = rng.lognormal(0, 0.5, 2000)
    rows += [(20_000 + k, "Load_a", 13.0 * k, float(v)) for k, v in enumerate(noise)]
    rows += [(30_000 + k, "mbar_a", 10.0 * k, float(v)) for k, v in enumerate(rng.normal(1, 0.01, 500))] + [(31_000, "mbar_a", 2500.5, -1.0)]
    truth.add(31_000)
    rows += [rows[300], rows[1205], (None, "degC_a", 5.0, 1e6), (40_000, None, 5.0, 1e6), (40_001, "degC_a", None, 1e6), (40_002, "degC_a", 5.0, None), (40_003, "degC_a", 6.0, float("nan")), (50_000, "single", 0.0, 1.0)]
    df = readings(rows).withColumns({"value_common": F.col("value_raw"), "quantity": F.when(F.col("endpoint_name").startswith("degC"), "temperature").when(F.col("endpoint_name").startswith("mbar"), "pressure"), "kind": F.lit(1), "v": F.lit(2)})
    for rules in (spikes.Rules(), spikes.Rules(shard_seconds=3600)):
        found = {r["reading_id"] for r in spikes.flag_implausible(df, rules).collect()}
        assert found == truth, (sorted(found - truth), sorted(truth - found))
    # shards of dense sources are halved until they hold so many readings
    for bound, sizes in ((1000, None), (800, df)):
        assert {r["reading_id"] for r in spikes.flag_implausible(df, rows_per_shard=bound, sizes=sizes).collect()} == truth
    assert spikes.flag_implausible(df.where("false")).count() == 0


def test_charts_in_blocks_agree_with_whole_ones():
    """Blocks with a lead give every value the deviation that one chart of the whole series gives it."""
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 3000).cumsum() * 0.05 + rng.normal(0, 0.2, 3000), rng.lognormal(0, 1, 40), [1.0, 2.0], rng.normal(5, 1, 700)])
    v[[500, 900, 901, 2000]] += 9
    counts, starts = rng.integers(1, 3, len(v)), np.array([0, 3000, 3040, 3042, len(v)])
    whole = spikes.charts(v, counts, starts, spikes.Rules(chart_block=100_000))
    parts = spikes.charts(v, counts, starts, spikes.Rules())
    assert np.abs(np.log1p(whole) - np.log1p(parts)).max() < 1e-3
    assert ((whole > 6) == (parts > 6)).all() and not whole[3040:3042].any()


def test_values_held_by_nature_stay_in_their_shards(spark, readings):
    """One source holds a value for all its readings: its ids never leave the shards' rows, and nothing is flagged."""
    rows = [(k, "Setp", 60.0 * k, 4.0) for k in range(3000)] + [(10_000 + k, "b", 60.0 * k, float(k * 37 % 101)) for k in range(3000)]
    df = readings(rows).withColumns({"value_common": F.col("value_raw"), "quantity": F.lit(None).cast("string")})
    most = []
    real = spikes._findings

    def watched(t, rules):
        for b in real(t, rules):
            most.extend(len(x) for x in b["reading_ids"].to_pylist() if x is not None)
            yield b

    assert spikes.flag_implausible(df, spikes.Rules(shard_seconds=3600, margin_seconds=600)).count() == 0
    import pyarrow as pa

    us = np.arange(3000) * 60_000_000
    t = pa.table({"endpoint_name": ["Setp"] * 3000, "shard": us // 3_600_000_000, "us": us, "reading_id": np.arange(3000), "v": np.full(3000, 4.0), "flags": np.full(3000, 2, dtype=np.int8)})
    list(watched(t, spikes.Rules()))
    assert max(most) == 60 and sum(most) == 3000


def test_stuck_run_over_shards(spark, readings):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, 400)
    v[95:105] = 0.5  # ten readings on both sides of a shard's edge
    df = readings([(k, "a", 36.0 * k, float(x)) for k, x in enumerate(v)]).withColumns({"value_common": F.lit(None).cast("double"), "quantity": F.lit(None).cast("string")})
    found = spikes.flag_implausible(df, spikes.Rules(shard_seconds=3600)).where("reason = 'stuck'")
    assert sorted(r["reading_id"] for r in found.collect()) == list(range(95, 105))


def test_partitions_follow_the_rows(spark):
    df = spark.range(1000)
    assert model.partitions_for(df, 10) == 100 and model.partitions_for(df, 10_000) == 4
    assert model.collected_if_small(df, 5) is None and len(model.collected_if_small(df, 1000)) == 1000
    assert model.broadcast_if_small(df, 5) is df
    assert statistics.mean([r["id"] for r in model.local_if_small(df).collect()]) == 499.5


def test_operators_from_another_folder(elsewhere):
    """Each operator that runs Python on the executors brings the package along."""
    elsewhere("""
from tidegauge.operators import series, spikes, validity
from tidegauge.sources import tables
entries = spark.sql("select 1L entry_id, 'a.L' sensor_name, 'a' dripline_endpoint, string(null) valid_if, 'v: v' default_calibration, 'l' label, timestamp_ntz '2020-01-01' entered_at")
states = validity.current_states(validity.bound_entries(entries))
events = readings.withColumn("at_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
for n in (100_000, 0):
    assert validity.as_known_at(events, states, broadcast_rows=n, buckets=2).where("entry_id = 1").count() == 200
assert spikes.flag_implausible(readings.withColumns({"value_common": F.col("value_raw"), "quantity": F.lit(None).cast("string")})).count() == 0
tables.write_table(readings.drop("timestamp"), "out.ktf")
assert tables.read_table(spark, "out.ktf").count() == 200
s = series.to_series(readings, "endpoint_name", "timestamp", "value_raw")
series.register_reducer("own", series.python_reducer(len))
assert series.reduce(s, ["own"]).first()["own"] == 200
""")
