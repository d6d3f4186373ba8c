import math
import random

import pytest

from tidegauge.operators import fill, resample
from tidegauge.operators import series as S


def long(spark, rows):
    return spark.createDataFrame([(n, i, float(t), x) for i, (n, t, x) in enumerate(rows)], "name string, i long, t double, x double")


def series(spark, pairs, name="a"):
    return long(spark, [(name, t, x) for t, x in pairs])


def reference(pairs, start, stop, step, offset, reduce):
    """Plain version of bucket, reduce."""
    first = stop - math.ceil((stop - start) / step) * step + offset
    out, k = [], 0
    while first + (k + 0.5) * step < stop:
        lo, hi = first + k * step, first + (k + 1) * step
        out.append((first + (k + 0.5) * step, reduce([x for t, x in pairs if lo <= t < hi and x is not None], [(t, x) for t, x in pairs if lo <= t < hi and x is not None], (lo + hi) / 2)))
        k += 1
    return out


REFERENCE = {
    "mean": lambda x, p, c: sum(x) / len(x) if x else None,
    "median": lambda x, p, c: sorted(x)[len(x) // 2] if x else None,
    "std": lambda x, p, c: math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / (len(x) - 1)) if len(x) > 1 else None,
    "first": lambda x, p, c: x[0] if x else None,
    "last": lambda x, p, c: x[-1] if x else None,
    "middle": lambda x, p, c: min(p, key=lambda q: (abs(q[0] - c), -q[0]))[1] if p else None,
    "min": lambda x, p, c: min(x, default=None),
    "max": lambda x, p, c: max(x, default=None),
}


def filled(points, how):
    known = [(t, x) for t, x in points if x is not None]
    out = []
    for t, x in points:
        before, after = [k for k in known if k[0] <= t], [k for k in known if k[0] >= t]
        if x is None:
            p, n = before[-1] if before else None, after[0] if after else None
            if how == "prev":
                x = p and p[1]
            elif how == "next":
                x = n and n[1]
            elif how == "closest":
                x = n and n[1] if p is None else p[1] if n is None else p[1] if t - p[0] < n[0] - t else n[1]
            elif how == "line" and p and n:
                x = (t - p[0]) / (n[0] - p[0]) * (n[1] - p[1]) + p[1]
        out.append((t, x))
    return out


@pytest.mark.parametrize("offset", [0.0, 2.5, -3.0, 11.0])
def test_resample_against_plain_version(spark, offset):
    rng = random.Random(offset)
    pairs = sorted((rng.uniform(1000, 1100), None if rng.random() < 0.25 else round(rng.uniform(-5, 5), 3)) for _ in range(60))
    grid = resample.Grid.by_time(1000, 1100, 7, offset)
    df = series(spark, pairs)
    for name, f in REFERENCE.items():
        got = [(r.t, r.x) for r in resample.resample(df, grid, name).orderBy("k").collect()]
        want = reference(pairs, 1000, 1100, 7, offset, f)
        assert [t for t, _ in got] == pytest.approx([t for t, _ in want])
        for (t, g), (_, w) in zip(got, want):
            assert g == (None if w is None else pytest.approx(w, abs=1e-9)), (name, t)


@pytest.mark.parametrize("how", ["prev", "next", "closest", "line"])
def test_fill_against_plain_version(spark, how):
    rng = random.Random(3)
    points = [(10.0 * k, None if rng.random() < 0.5 else float(k)) for k in range(40)]
    for slice_seconds in (None, 86_400, 50, 7):  # gaps over several slices, and slices of a single point
        out = fill.fill(series(spark, points), how, slice_seconds=slice_seconds)
        got = [(r.t, r.x) for r in out.orderBy("t").collect()]
        assert len(got) == len(points) and set(out.columns) == {"name", "i", "t", "x"}
        for (t, g), (_, w) in zip(got, filled(points, how)):
            assert g == (None if w is None else pytest.approx(w)), (slice_seconds, t)
    assert fill.fill(series(spark, points).where("false"), how).count() == 0


def test_reducers_of_edge_series(spark):
    df = long(spark, [("none", 1, None), ("none", 2, None), ("one", 1, 5.0), ("even", 1, 1.0), ("even", 2, 2.0), ("even", 3, 3.0), ("even", 4, 4.0), ("late", 1, None), ("late", 2, 7.0)])
    r = {x["name"]: x for x in S.reduce(df, ["count", "n", "sum", "mean", "var", "sem", "median", "min", "first", "last", "middle"], (0.0, 5.0)).collect()}
    assert r["none"]["count"] == 0 and r["none"]["sum"] is None and r["none"]["median"] is None and r["none"]["first"] is None
    assert r["one"]["var"] is None and r["one"]["sem"] is None and r["one"]["mean"] == 5.0
    assert r["even"]["median"] == 3.0  # the upper one
    assert r["even"]["middle"] == 3.0  # 2 and 3 are equally near the centre: the later
    strict = {x["name"]: x["min"] for x in S.reduce(df, ["min"], strict=True).collect()}
    assert strict["late"] is None and strict["even"] == 1.0
    medians = {x["name"]: x["median"] for x in S.large_median(df).collect()}
    assert medians == {"one": 5.0, "even": 3.0, "late": 7.0}


def test_large_median_is_exact(spark):
    rng = random.Random(1)
    rows = [(n, k, rng.choice([rng.gauss(0, 1), 0.0, 3.0])) for n in ("a", "b") for k in range(4001)]
    got = {r["name"]: r["median"] for r in S.large_median(long(spark, rows)).collect()}
    for n in ("a", "b"):
        x = sorted(v for m, _, v in rows if m == n)
        assert got[n] == x[len(x) // 2]


@pytest.mark.parametrize("rows_per_task", [1_000, 0])
def test_sampling_interval_is_the_lower_median(spark, rows_per_task):
    df = long(spark, [("a", 0, 1.0), ("a", 1, 1.0), ("a", 5, 1.0), ("b", 0, 1.0)])
    assert {r["name"]: r["dt"] for r in S.sampling_interval(df, rows_per_task).collect()} == {"a": 1.0, "b": None}
    assert S.sampling_interval(df.where("false"), rows_per_task).count() == 0


def test_hot_series_go_through_slices(spark):
    """One series holds most points: steps by slices and medians by brackets equal those of the whole series."""
    rng = random.Random(6)
    rows = [("hot", rng.uniform(0, 100_000), rng.choice([rng.gauss(0, 1), 2.0, None])) for _ in range(6000)]
    rows += [("cold", 50.0 * k, float(k)) for k in range(40)] + [("one", 7.0, 1.0), ("none", 7.0, None)]
    df = long(spark, rows).persist()
    whole, parts = S.sampling_interval(df), S.sampling_interval(df, 100, slice_seconds=600)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)
    assert S.steps(df, 600).count() == S.steps(df, None).count() == 5999 + 39
    grid = resample.Grid.by_time(0, 100_000, 20_000)
    medians = [resample.resample(df, grid, "median", rows_per_task=n) for n in (10**6, 100)]
    assert sorted(map(tuple, medians[0].collect()), key=str) == sorted(map(tuple, medians[1].collect()), key=str)
    names = ["median", "count", "max"]
    a, b = S.reduce(df, names), S.reduce(df, names, rows_per_task=100)
    assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert "percentile_disc" not in b._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_of_a_grid(spark):
    df = series(spark, [(100.0, 1.0), (190.0, 2.0)])
    assert resample.Grid.of_series(df, 30) == resample.Grid.by_time(100, 190, 30)
    assert resample.Grid.of_series(df, 30, 0.0, 250.0) == resample.Grid.by_time(100, 250, 30)
    assert resample.Grid.of_series(df, 30, 130.0, 120.0, 5.0) == resample.Grid.by_time(130, 190, 30, 5.0)
    assert resample.Grid.of_series(df, 30, 10.0, 70.0) == resample.Grid.by_time(10, 70, 30)
    assert resample.Grid.of_series(df.where("false"), 30).n == 0
    spans = {"a": (100.0, 200.0), "b": (50.0, 150.0), "c": (60.0, 300.0)}
    assert resample.align(df, "auto", spans) == resample.Grid.by_time(60, 200, 90.0)
    assert resample.align(df, "max", spans) == resample.Grid.by_time(100, 150, 90.0)


def test_grid_edges():
    with pytest.raises(ValueError):
        resample.Grid.by_time(0, 10, 0)
    assert resample.Grid.by_time(10, 10, 1).n == 0
    g = resample.Grid.by_time(0, 100, 30)  # anchored to the stop
    assert (g.first, g.n) == (-20, 4)
    assert resample.Grid.by_time(704649572, 704651301, 0.3).n == math.ceil((704651301 - 704649572) / 0.3)


def test_frame_and_slices(spark):
    df = long(spark, [("a", t, 10.0 * t) for t in range(100)] + [("b", t, 5.0 * t) for t in range(100)])
    f = resample.frame(df, resample.Grid.by_time(0, 100, 20), ["b", "a", "none"], "mean")
    assert f.columns == ["t", "b", "a", "none"]
    rows = f.orderBy("t").collect()
    assert [(r.t, r.a, r.b, r.none) for r in rows] == [(20.0 * k + 10, 200.0 * k + 95, 100.0 * k + 47.5, None) for k in range(5)]
    assert resample.align(df, "auto").step == 1.0 and resample.align(df, "min").step == 1.0
    assert sorted(r.t for r in S.slice_points(df.where("name = 'a'"), -3, 2).collect()) == [0.0, 1.0]
    assert S.keep(df, lambda x: x > 980).count() == 1
    empty = df.where("false")
    assert resample.resample(empty, resample.Grid.by_time(0, 10, 1), "mean").count() == 0
    assert resample.align(empty, "min").n == 0
    with pytest.raises(ValueError):
        resample.align(long(spark, [("a", 1, 1.0), ("a", 1, 2.0)]), "auto")
    assert resample.numbered_columns(2) == ["Column000", "Column001"]


def test_golden_transcript(spark):
    """Values of the manual's raw series and their 20 s means: 4.9995, 4.9995, 5.0005 need six points each."""
    pairs = [(1646431200 + 1.3 + 10 * k, v) for k, v in enumerate([4.999, 5.0, 4.999, 5.0, 5.001, 5.0])]
    got = [r.x for r in resample.resample(series(spark, pairs), resample.Grid.by_time(1646431200, 1646431260, 20), "mean").orderBy("k").collect()]
    assert got == pytest.approx([4.9995, 4.9995, 5.0005])


def test_own_reducers(spark):
    S.register_reducer("range", lambda centre: __import__("pyspark.sql.functions").sql.functions.expr("max(x) - min(x)"))
    S.register_reducer("py", S.python_reducer(lambda x: x.iloc[0]))
    df = long(spark, [("a", 1, 1.0), ("a", 2, 4.0), ("b", 1, None)])
    assert {r["name"]: r["range"] for r in S.reduce(df, ["range"]).collect()} == {"a": 3.0, "b": None}
    assert {r["name"]: r["py"] for r in S.reduce(df.where("x < 2 or x is null"), ["py"]).collect()} == {"a": 1.0, "b": None}
    with pytest.raises(ValueError):
        S.reducer("nothing")


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidegauge.streaming import windows

    rows = [("a", f"2021-01-05 00:00:{s:02d}", float(s)) for s in range(0, 60, 5)] + [("a", "2021-01-05 00:00:03", None), (None, "2021-01-05 00:00:03", 1.0)]
    df = spark.createDataFrame(rows, "n string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = windows.resample_stream(stream, "n", "ts", "x", 20, 1609804800 + 50, late_s=3600)
    q = out.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["t"] - 1609804800: r["x"] for r in spark.table("w").collect()}
    assert got == {0.0: 2.5, 20.0: 17.5, 40.0: 37.5, 60.0: 52.5}  # buckets end at :50, :30, :10
    with pytest.raises(ValueError):
        windows.resample_stream(stream, "n", "ts", "x", 20, 0, "median")
