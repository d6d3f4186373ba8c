"""Queries of the series operators over ``events``: event_type is the series, ts the time, value the reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.operators import fill, resample
from tidegauge.operators import series as S
from tidegauge.sources.tables import Source

START, STOP = 1704067200.0, 1706659200.0  # 2024-01-01 and 2024-01-31
STEP = 21_600.0
TYPES = ["click", "error", "purchase", "signup", "view"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_S = "s as (select event_type as name, event_id as i, epoch_us(ts) / 1000000 as t, case when isnan(value) then null else value end as x from events where event_type is not null and ts is not null)"
_GAPPY = "g as (select name, i, t, case when i % 7 = 0 then null else x end as x from s)"


def series(spark: SparkSession, d: str, by: str = "event_type") -> DataFrame:
    return S.to_series(model.table(spark, d, "events"), by, "ts", "value", "event_id")


def gappy(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh value is missing, so that gaps occur."""
    return series(spark, d).withColumn("x", F.when(F.col("i") % 7 != 0, F.col("x")))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _register(name: str, f, sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE[name] = sql


def source(spark: SparkSession, d: str) -> Source:
    """The events as a table of readings."""
    e = model.table(spark, d, "events")
    return Source(e.select(F.col("event_type").alias("endpoint_name"), F.col("ts").alias("timestamp"), F.col("value").alias("value_raw"), F.col("event_id").alias("reading_id")))


@query("select event_type as name, event_id as i, epoch_us(ts) / 1000000 as t, value as x from events where event_type in ('click', 'view') and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def range_scan(spark, d):
    """A half-open range of two names, one of them asked for twice; bounds are cut to whole seconds."""
    return source(spark, d).range(["click", "view", "click"], 1704412800.9, 1705017600.5)


@query("select distinct event_type as name from events where event_type is not null")
def list_names(spark, d):
    return source(spark, d).name_table()


_REDUCE_SQL = {
    "count": "count(x)", "sum": "sum(x)", "mean": "avg(x)", "var": "var_samp(x)", "std": "stddev_samp(x)", "sem": "sqrt(var_samp(x) / count(x))",
    "median": "-quantile_disc(-x, 0.5)", "min": "min(x)", "max": "max(x)",
    "first": "arg_min(x, (t, i)) filter (x is not null)", "last": "arg_max(x, (t, i)) filter (x is not null)",
    "middle": f"arg_min(x, (abs(t - {(START + STOP) / 2}), -t, -i)) filter (x is not null)",
}
for _n, _sql in _REDUCE_SQL.items():

    def _reduce(spark, d, n=_n):
        out = S.reduce(gappy(spark, d), [n], (START, STOP))
        return out.select("name", F.col(n).cast("long").alias(n) if n == "count" else F.round(n, 6).alias(n))

    _register(f"reduce_{_n}", _reduce, f"with {_S}, {_GAPPY} select name, {_sql if _n == 'count' else f'round({_sql}, 6)'} as {_n} from g group by name")


@query(f"with {_S}, {_GAPPY} select name, round(-quantile_disc(-x, 0.5), 6) as median from g group by name")
def reduce_median_large(spark, d):
    """The same median without holding a series in one task."""
    return S.large_median(gappy(spark, d)).select("name", F.round("median", 6).alias("median"))


@query(f"with {_S}, {_GAPPY} select name, case when arg_min(x is not null, (t, i)) then round(min(x), 6) end as min from g group by name")
def reduce_min_strict(spark, d):
    return S.reduce(gappy(spark, d), ["min"], strict=True).select("name", F.round("min", 6).alias("min"))


@query("with s as (select cast(user_id as varchar) as name, event_id as i, epoch_us(ts) / 1000000 as t from events where user_id is not null), l as (select name, t - lag(t) over (partition by name order by t, i) as d from s) select name, round(quantile_disc(d, 0.5), 6) as dt from l group by name")
def sampling_interval(spark, d):
    return S.sampling_interval(series(spark, d, "user_id")).select("name", F.round("dt", 6).alias("dt"))


_FIRST = STOP - -(-(STOP - START) // STEP) * STEP
_N = int((STOP - START) // STEP)


def _resample_sql(expression: str, offset: float = 0.0, source: str = "g", where: str = "") -> str:
    first, n = _FIRST + offset, resample.Grid.by_time(START, STOP, STEP, offset).n
    return f"""b as (select name, cast(floor((t - {first}) / {STEP}) as bigint) as k, {expression} as x from {source} {where} group by 1, 2),
      names as (select distinct name from {source}), cells as (select name, unnest(range({n})) as k from names),
      r as (select c.name, c.k, cast({first} + (c.k + 0.5) * {STEP} as double) as t, b.x from cells c left join b using (name, k))"""


for _n, _sql in _REDUCE_SQL.items():
    if _n == "middle":
        _sql = f"arg_min(x, (abs(t - ({_FIRST} + (floor((t - {_FIRST}) / {STEP}) + 0.5) * {STEP})), -t, -i)) filter (x is not null)"

    def _resampled(spark, d, n=_n):
        r = resample.resample(gappy(spark, d), resample.Grid.by_time(START, STOP, STEP), n)
        return r.select("name", "k", F.round("t", 3).alias("t"), F.round("x", 6).alias("x"))

    _register(f"resample_{_n}", _resampled, f"with {_S}, {_GAPPY}, {_resample_sql(_sql)} select name, k, round(t, 3) as t, round(cast(x as double), 6) as x from r")


@query(f"with {_S}, {_GAPPY}, {_resample_sql('avg(x)', 5000.0)} select name, k, round(t, 3) as t, round(x, 6) as x from r")
def resample_offset(spark, d):
    r = resample.resample(gappy(spark, d), resample.Grid.by_time(START, STOP, STEP, 5000.0), "mean")
    return r.select("name", "k", F.round("t", 3).alias("t"), F.round("x", 6).alias("x"))


# Fillers: short buckets over one series per user leave many gaps.
_U = "s as (select cast(user_id as varchar) as name, event_id as i, epoch_us(ts) / 1000000 as t, value as x from events where user_id is not null)"
_NEAR = """n as (select *, last_value(x ignore nulls) over b as px, last_value(case when x is not null then t end ignore nulls) over b as pt,
   first_value(x ignore nulls) over a as nx, first_value(case when x is not null then t end ignore nulls) over a as nt from r
   window b as (partition by name order by t rows between unbounded preceding and current row), a as (partition by name order by t rows between current row and unbounded following))"""
_FILL_SQL = {
    "value": "coalesce(x, -1.0)", "prev": "coalesce(x, px)", "next": "coalesce(x, nx)",
    "closest": "coalesce(x, case when px is null then nx when nx is null then px when abs(pt - t) < abs(nt - t) then px else nx end)",
    "line": "coalesce(x, case when nt > pt then (t - pt) / (nt - pt) * (nx - px) + px end)",
}
for _n, _sql in _FILL_SQL.items():

    def _filled(spark, d, n=_n):
        r = resample.resample(series(spark, d, "user_id"), resample.Grid.by_time(START, STOP, STEP), "mean", n, -1.0)
        return r.select("name", "k", F.round("x", 6).alias("x"))

    _register(f"fill_{_n}", _filled, f"with {_U}, {_resample_sql('avg(x)', 0.0, 's')}, {_NEAR} select name, k, round({_sql}, 6) as x from n")


def _align_sql(step: str, start: str, stop: str) -> str:
    return f"""with {_S}, l as (select name, t, t - lag(t) over (partition by name order by t, i) as d from s),
      p as (select name, quantile_disc(d, 0.5) as dt, min(t) as a, max(t) as b from l group by name),
      q as (select {step} as step, {start} as a, {stop} as b from p), w as (select step, b - ceil((b - a) / step) * step as f, b from q),
      m as (select step, f, cast(greatest(0, ceil((b - f - step / 2) / step)) as bigint) as n from w),
      bk as (select name, cast(floor((t - f) / step) as bigint) as k, avg(x) as x from s, m group by 1, 2)
      select c.name, c.k, round(bk.x, 6) as x from (select name, unnest(range(n)) as k from (select distinct name from s), m) c left join bk using (name, k)"""


for _n, _args in {
    "auto": ("-quantile_disc(-dt, 0.5)", "-quantile_disc(-a, 0.5)", "-quantile_disc(-b, 0.5)"),
    "min": ("min(dt)", "min(a)", "max(b)"),
    "max": ("max(dt)", "max(a)", "min(b)"),
}.items():

    def _aligned(spark, d, n=_n):
        s = series(spark, d)
        return resample.resample(s, resample.align(s, n), "mean").select("name", "k", F.round("x", 6).alias("x"))

    _register(f"align_{_n}", _aligned, _align_sql(*_args))


@query(
    f"with {_S}, {_GAPPY}, {_resample_sql('avg(x)')}, {_NEAR} select round(t, 3) as t, "
    + ", ".join(f"round(max(coalesce(x, px)) filter (name = '{n}'), 6) as \"{n}\"" for n in TYPES)
    + " from n group by n.t"
)
def frame_wide(spark, d):
    """Flagship: aligned wide frame of bucket means, filled forward."""
    f = resample.frame(gappy(spark, d), resample.Grid.by_time(START, STOP, STEP), TYPES, "mean", "prev")
    return f.select(F.round("t", 3).alias("t"), *(F.round(n, 6).alias(n) for n in TYPES))


@query(f"with {_S}, n as (select *, row_number() over (partition by name order by t, i) - 1 as p from s) select name, i, round(x, 6) as x from n where p >= 10 and p < 25")
def slice_points(spark, d):
    return S.slice_points(series(spark, d), 10, 25).select("name", "i", F.round("x", 6).alias("x"))


@query(f"with {_S}, {_GAPPY} select name, i, round(x, 6) as x from g where x > 50")
def filter_values(spark, d):
    return S.keep(gappy(spark, d), lambda x: x > 50).select("name", "i", F.round("x", 6).alias("x"))


@query(f"with {_S}, {_GAPPY} select name, i, round(x, 6) as x from g where x is not null")
def dropna(spark, d):
    return S.dropna(gappy(spark, d)).select("name", "i", F.round("x", 6).alias("x"))


@query(f"with {_S}, {_GAPPY} select name, i, round(x * x + 1, 6) as x from g")
def map_values(spark, d):
    return S.apply(gappy(spark, d), lambda x: x * x + 1).select("name", "i", F.round("x", 6).alias("x"))
