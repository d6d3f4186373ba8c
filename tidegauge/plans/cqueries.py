"""Queries of calibrations, expressions, names, validity, renderings and the stream, over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import model, sensors
from tidegauge.functions.columns import compile_expression, macro
from tidegauge.functions.text import Formatter, Scanner
from tidegauge.operators import resample, validity
from tidegauge.operators import series as S
from tidegauge.plans import pqueries
from tidegauge.plans.app import App
from tidegauge.plans.squeries import _FIRST, START, STEP, STOP, series, source
from tidegauge.sources import render
from tidegauge.sources.tables import Source
from tidegauge.streaming import windows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A configuration over the event types: raw channels, and channels derived in one or more steps.
TREE = {
    "sensor_table": {
        "setup": {
            "id": {"name": "Shop", "label": "Shop"},
            "channel": [
                {"id": {"name": "click"}, "x-dripline_endpoint": "click"},
                {"id": {"name": "view"}, "x-dripline_endpoint": "view"},
                {"id": {"name": "linear"}, "default_calibration": "click: 2.5*click - 7"},
                {"id": {"name": "chained"}, "default_calibration": "linear: linear*linear/4 + linear"},
                {"id": {"name": "late"}, "default_calibration": "view: view", "valid_if": "date >= 20240101"},
                {"id": {"name": "never"}, "default_calibration": "view: view", "valid_if": "date < 20240101"},
                {"id": {"name": "resistor"}, "default_calibration": "view: pt100(view)"},
                {"id": {"name": "inverse"}, "default_calibration": "click: 1000/click"},
                {"id": {"name": "falling"}, "default_calibration": "click: 100 - click"},
                {"id": {"name": "lost"}, "default_calibration": "nowhere: nowhere"},
            ],
        }
    }
}


def app(spark: SparkSession, d: str) -> App:
    names = spark.createDataFrame([(n,) for n in ("click", "error", "purchase", "signup", "view")], "endpoint_name string")
    return App(spark, Source(source(spark, d).readings, names), tree=TREE, variables={"date": 20240201})


def _calibrated(name: str, sql: str, origin: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return app(spark, d).read([name], START, STOP).select("name", "i", F.round("x", 6).alias("x"))

    QUERIES[f"calib_{name}"] = f
    ORACLE[f"calib_{name}"] = f"select '{name}' as name, event_id as i, round({sql}, 6) as x from events where event_type = '{origin}' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


_calibrated("linear", "2.5 * value - 7", "click")
_calibrated("chained", "(2.5 * value - 7) * (2.5 * value - 7) / 4 + (2.5 * value - 7)", "click")
_calibrated("late", "value", "view")
_calibrated(
    "resistor",
    "case when value < 8 then -7.1030334872 + value * (15.01325304 + value * (-1.555176 + value * 0.0648))"
    " when value < 40 then 25.9483968 + value * (2.6227712 + value * (-0.0073364 + value * 7.61e-5))"
    " else 31.17504 + value * (2.233872 + value * (0.0023532 + value * -4.61e-6)) end",
    "view",
)


@query("select event_id, xor(user_id << 3, 5 & 255) | 1 as bits, -(~user_id) as inverse, user_id // 7 as whole, user_id % 7 as rest from events where user_id is not null")
def calib_bits(spark, d):
    e = model.table(spark, d, "events").where("user_id is not null")
    v = {"u": (F.col("user_id"), "long")}
    names = {"bits": "u << 3 ^ 5 & 255 | 1", "inverse": "-(~u)", "whole": "u / 7", "rest": "u % 7"}
    # << binds tighter than ^, & tighter than |
    return e.select("event_id", *(compile_expression(t, v).col.alias(n) for n, t in names.items()))


@query(
    "select event_id, round(case when value > 0 then ln(value) end, 6) as log_, round(case when value >= 1 then sqrt(value - 1) end, 6) as root, round(pow(value, 2) / 3, 4) as power,"
    " sign(value - 50) * floor(abs(value - 50) + 0.5) as nearest, sign(value - 50) * floor(abs(value - 50)) as cut, value > 20 and not (value >= 80) as inside,"
    " round(case when value = 0 then 1 else sin(pi() * value) / (pi() * value) end, 6) + 0.0 as wave, round(3.141592 * value, 4) as circle from events where value is not null"
)
def expr_math(spark, d):
    e = model.table(spark, d, "events").where("value is not null")
    v = {"x": (F.col("value"), "double")}
    texts = {"log_": "log(x)", "root": "sqrt(x - 1)", "power": "x**2 / 3", "nearest": "round(x - 50)", "cut": "trunc(x - 50)", "inside": "x > 20 && !(x >= 80)", "wave": "sinc(x)", "circle": "pi*x"}
    digits = {"log_": 6, "root": 6, "power": 4, "wave": 6, "circle": 4}
    cols = {n: compile_expression(t, v).col for n, t in texts.items()}
    return e.select("event_id", *(F.round(c, digits[n]).alias(n) if n in digits else c.alias(n) for n, c in cols.items()))


_ITEMS = "l as (select l_orderkey as k, list(l_quantity order by l_linenumber, l_quantity) as q from lineitem group by 1)"


@query(
    f"with {_ITEMS} select k, round(list_sum(q), 6) as s, round(list_avg(q), 6) as m, list_min(q) as lo, list_max(q) as hi, len(q) as n,"
    " round(sqrt(greatest(list_sum(list_transform(q, lambda x: x * x)) / len(q) - list_avg(q) * list_avg(q), 0)), 5) as dev,"
    " len(list_filter(q, lambda x: x > 25)) as big, q[1] as head, q[len(q)] as tail from l"
)
def list_reduce(spark, d):
    return _lists(spark, d, {"s": "sum(q)", "m": "mean(q)", "lo": "min(q)", "hi": "max(q)", "n": "length(q)", "dev": "deviation(q)", "big": "count(q > 25)", "head": "q[0]", "tail": "q[-1]"}, {"s": 6, "m": 6, "dev": 5})


@query(
    f"with {_ITEMS} select k, array_to_string(list_transform(range(1, len(q)), lambda i: cast(q[i + 1] - q[i] as bigint)), ',') as delta,"
    " array_to_string(list_transform(range(0, len(q) + 1), lambda i: cast(coalesce(list_sum(q[1:i]), 0) as bigint)), ',') as sigma,"
    " array_to_string(list_filter(range(0, len(q)), lambda i: q[i + 1] > 25), ',') as found,"
    " array_to_string(list_transform(range(0, cast(ceil(len(q) / 2.0) as bigint)), lambda i: cast(list_sum(q[i * 2 + 1:i * 2 + 2]) as bigint)), ',') as pairs,"
    " array_to_string(list_transform(q, lambda x: cast(2 * x + 1 as bigint)), ',') as scaled from l"
)
def list_transform(spark, d):
    out = _lists(spark, d, {"delta": "delta(q)", "sigma": "sigma(q)", "found": "find(q > 25)", "pairs": "divide(q, 2)", "scaled": "2*q + 1"}, {})
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",")
    summed = F.transform("pairs", lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x))
    return out.select("k", *(text(F.col(c)).alias(c) for c in ("delta", "sigma", "found")), text(summed).alias("pairs"), text(F.col("scaled")).alias("scaled"))


@query(
    f"with {_ITEMS} select k, len(list_filter(q, lambda x: x in (5, 10, 15))) + len(list_filter(q, lambda x: x = 10)) as common, len(q) + 3 as joined,"
    " cast(len(q) as varchar) || ' items' as said from l"
)
def list_sets(spark, d):
    # {5,10,10,15} has 10 twice: every equal pair counts
    return _lists(spark, d, {"common": "sizeof(q <&> {5.0, 10.0, 10.0, 15.0})", "joined": "sizeof(q <+> [1:1:3])", "said": "length(q) + ' items'"}, {})


def _lists(spark: SparkSession, d: str, texts: dict[str, str], digits: dict[str, int]) -> DataFrame:
    rows = model.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("r"))
    rows = rows.select(F.col("l_orderkey").alias("k"), F.col("r.l_quantity").alias("q"))
    from tidegauge.functions.columns import Compiler, Value

    c = Compiler({"q": Value(F.col("q"), "list", "double")})
    cols = {n: c.compile(t).col for n, t in texts.items()}
    return rows.select("k", *(F.round(x, digits[n]).alias(n) if n in digits else x.alias(n) for n, x in cols.items()))


@query(
    "select c_custkey, right(c_name, 1) as last, left(c_name, length(c_name) - 1) as rest, substr(c_name, 4, 5) as part, substr(c_name, length(c_name) - 3, 2) as back,"
    " instr(c_name, '#') - 1 as mark, instr(c_name, '!') - 1 as none, c_mktsegment || '/' || c_custkey as joined, c_name = c_mktsegment as same from customer"
)
def string_functions(spark, d):
    v = {"s": (F.col("c_name"), "string"), "m": (F.col("c_mktsegment"), "string"), "k": (F.col("c_custkey"), "long")}
    texts = {"last": "chop(s)", "rest": "chopped(s)", "part": "substr(s, 3, 5)", "back": "substr(s, -4, 2)", "mark": "index(s, '#')", "none": "index(s, '!')", "joined": "m + '/' + k", "same": "s == m"}
    return model.table(spark, d, "customer").select("c_custkey", *(compile_expression(t, v).col.alias(n) for n, t in texts.items()))


@query(
    "select c_custkey, lpad(cast(c_custkey as varchar), 9, '0') || ' ' || printf('%.2f', c_acctbal) || ' ' || lower(to_hex(c_custkey)) as line, cast(split_part(c_name, '#', 2) as bigint) as number,"
    " split_part(c_name, '#', 1) as word, length(split_part(c_name, '#', 2)) as left_over from customer"
)
def text_format(spark, d):
    """Formatter and scanner: padded, fixed and hexadecimal numbers; words and numbers back from text."""
    f = Formatter().setfill("0").setw(9).put(F.col("c_custkey"), "long").put(" ").fixed().setprecision(2).put(F.col("c_acctbal"), "double").put(" ").hex().put(F.col("c_custkey"), "long")
    s = Scanner(F.col("c_name"))
    word, left = s.get_line("#"), s.gcount()
    return model.table(spark, d, "customer").select("c_custkey", f.flush().alias("line"), s.get("long").alias("number"), word.alias("word"), left.alias("left_over"))


_K = f"cast(floor((epoch_us(ts) / 1000000 - {_FIRST}) / {STEP}) as bigint)"


@query(f"select event_type as name, {_K} as k, round(max(value) - min(value), 6) as spread, cast(count(*) as double) as size from events where value is not null and event_type is not null and {_K} >= 0 and {_K} < 120 group by 1, 2")
def custom_reducer(spark, d):
    """Reducers of one's own on buckets: one as an aggregate, one in Python."""
    S.register_reducer("spread", lambda centre: F.max("x") - F.min("x"))
    S.register_reducer("size", S.python_reducer(len))
    s, grid = S.dropna(series(spark, d)), resample.Grid.by_time(START, STOP, STEP)
    a, b = (resample.resample(s, grid, r).where("x is not null").select("name", "k", F.col("x").alias(r)) for r in ("spread", "size"))
    return a.join(b, ["name", "k"]).select("name", "k", F.round("spread", 6).alias("spread"), "size")


@query("select event_id, round((value + 1) * (value + 1) / 2 + 3, 6) as y from events where value is not null")
def macro_function(spark, d):
    """A function defined by an expression, and a text evaluated when the plan is made."""
    e = model.table(spark, d, "events").where("value is not null")
    v = compile_expression("half_square(x + 1.0) + evaluate('1 + 2')", {"x": (F.col("value"), "double")}, {"half_square": macro(["a"], "a*a/2.0")})
    return e.select("event_id", F.round(v.col, 6).alias("y"))


@query("select entry_id, sensor_name from (select distinct entry_id, sensor_name from sensor_table) where regexp_matches(sensor_name, '(^|[.])mbar[.](.*[.])?Gas([.]|$)')")
def find_like(spark, d):
    """Names in which the pattern's parts occur in order, with gaps."""
    t = model.table(spark, d, "sensor_table").select("entry_id", "sensor_name").distinct()
    return t.where(sensors.like_column(F.split("sensor_name", r"\."), ["mbar", "Gas"]))


@query(
    "select e.event_id, n.n_nationkey from events e join nation n on e.user_id % 25 = n.n_nationkey and e.ts >= timestamp '2024-01-01' + interval 1 day * n.n_nationkey"
    " and e.ts < timestamp '2024-01-01' + interval 1 day * (n.n_nationkey + 5)"
)
def validity_interval(spark, d):
    """Rows joined to those of the same key whose interval contains their time."""
    return _intervals(spark, d)


@query(ORACLE["validity_interval"])
def validity_interval_large(spark, d):
    """The same with more intervals than may be broadcast: cut at slices of time."""
    return _intervals(spark, d, broadcast_rows=0)


def _intervals(spark: SparkSession, d: str, **more: int) -> DataFrame:
    start, stop = (F.expr(f"timestamp_ntz '2024-01-01' + make_dt_interval({n})") for n in ("n_nationkey", "n_nationkey + 5"))
    n = model.table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("k"), start.alias("start"), stop.alias("stop"))
    e = model.table(spark, d, "events").select("event_id", "ts", F.pmod("user_id", F.lit(25)).cast("long").alias("k"))
    return validity.join_intervals(e, n, "k", "ts", "start", "stop", **more).select("event_id", "n_nationkey")


@query("select name, count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std from (select 'click' as name, value as x from events where event_type = 'click' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' union all select 'linear', 2.5 * value - 7 from events where event_type = 'click' and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31') group by name")
def summary(spark, d):
    s = app(spark, d).summary(["click", "linear"], START, STOP, ["n", "mean", "std"])
    return s.select("name", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("select strftime(ts, '%Y-%m-%dT%H:%M:%S') as \"DateTime\", round(epoch_us(ts) / 1000000, 1) as \"TimeStamp\", value as reading from events where event_type is not null and ts is not null")
def render_csv(spark, d):
    return render.series_csv(series(spark, d), "reading")


@query(
    f"select cast(user_id as varchar) as name, cast({START} as double) as start, cast({STOP - START} as double) as length, string_agg(cast(round(epoch_us(ts) / 1000000 - {START}, 1) as varchar), ',' order by ts, event_id) as t,"
    " string_agg(coalesce(printf('%.5e', value), 'null'), ',' order by ts, event_id) as x from events where user_id is not null group by 1"
)
def render_json(spark, d):
    """Each user's series as JSON, taken apart again: times to a tenth of a second, values to six significant digits."""
    parsed = F.from_json("json", "start double, length double, t array<double>, x array<double>").alias("j")
    j = render.series_json(series(spark, d, "user_id"), START, STOP).select("name", parsed)
    times = F.array_join(F.transform("j.t", lambda t: t.cast("string")), ",")
    values = F.array_join(F.transform("j.x", lambda x: F.coalesce(F.format_string("%.5e", x), F.lit("null"))), ",")
    return j.select("name", "j.start", "j.length", times.alias("t"), values.alias("x"))


@query(f"with {pqueries._ENTRIES} select distinct entry_id, endpoint_name from entries where endpoint_name is not null")
def sensor_rows(spark, d):
    """Each entry of the sensor table with the endpoint it is bound to."""
    return validity.bound_entries(model.table(spark, d, "sensor_table"), pqueries.SETUP).select("entry_id", "endpoint_name")


@query(
    f"with {pqueries._ENTRIES} select endpoint_name, cast(count(distinct reading_id) as bigint) as n, cast(count(distinct entry_id) as bigint) as entries from applying"
    " where entry_id is not null and endpoint_name in (select endpoint_name from entries where default_calibration is not null) group by 1"
)
def known_per_endpoint(spark, d):
    return pqueries.p5_states(spark, d).groupBy("endpoint_name").agg(F.count_distinct("reading_id").alias("n"), F.count_distinct("entry_id").alias("entries"))


@query(f"select event_type as name, {STOP} + (floor((epoch_us(ts) / 1000000 - {STOP}) / 21600) + 0.5) * 21600 as t, round(avg(value), 6) as x from events where value is not null and event_type is not null group by 1, 2")
def stream_resample(spark, d):
    """The events as a stream of files, resampled to the batch grid's buckets; the result is the sink's table."""
    schema = model.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    if os.path.isdir(os.path.join(d, "events.parquet")):
        stream = spark.readStream.schema(schema).parquet(os.path.join(d, "events.parquet"))
    out = windows.resample_stream(stream.where("value is not null"), "event_type", "ts", "value", 21_600, int(STOP), late_s=40 * 86_400)
    path = model.scratch(spark, "stream")
    windows.write_whole(out, f"{path}/table", f"{path}/progress").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/table").select("name", "t", F.round("x", 6).alias("x"))
