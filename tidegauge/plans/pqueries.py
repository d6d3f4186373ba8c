"""Queries of the general data problems (numbers 2, 3, 5 and 6) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import model
from tidegauge.operators import regular_grid, spikes, units, validity

SETUP = "LYRA"
VERSION = 1


def states(spark: SparkSession, d: str) -> DataFrame:
    return model.local_if_small(validity.current_states(validity.bound_entries(model.table(spark, d, "sensor_table"), SETUP), VERSION))


def common(spark: SparkSession, d: str) -> DataFrame:
    """Readings with a value, in common units."""
    readings = model.table(spark, d, "numeric_data").where(model.has_value("value_raw"))
    return units.to_common_units(readings, states(spark, d), model.table(spark, d, "unit_def"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings recorded in another unit than the common one, with that unit."""
    return common(spark, d).where("unit <> common_unit and reading_id is not null").select("reading_id", "unit").distinct()


def p2_common_values(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with a value, in its quantity's common unit (NULL where the unit is unknown), exactly as computed."""
    return common(spark, d).select("reading_id", "endpoint_name", "quantity", "common_unit", "value_common").distinct()


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_series(model.table(spark, d, "numeric_data"), model.table(spark, d, "endpoint_id_map"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.empty_cells(p3_series(spark, d))


def p3_regular_series(spark: SparkSession, d: str) -> DataFrame:
    """Whole regular series; the day as text, values to nine significant digits (a mean's last bits depend on the order of its values)."""
    return p3_series(spark, d).select(
        "endpoint_name", F.col("day").cast("string").alias("day"), "cell_start", F.col("n").cast("long").alias("n"), "status",
        model.significant("filled", 9).alias("filled"))


def p5_states(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery of a reading with a value with the entry in force at its time, of endpoints with some calibrated entry."""
    entries = validity.bound_entries(model.table(spark, d, "sensor_table"), SETUP)
    calibrated = model.broadcast_if_small(entries.where("default_calibration is not null").select("endpoint_name").distinct())
    readings = model.table(spark, d, "numeric_data").where(model.has_value("value_raw")).where("reading_id is not null and timestamp is not null")
    events = readings.select("endpoint_name", "reading_id", model.micros("timestamp").alias("at_us")).join(calibrated, "endpoint_name", "left_semi")
    buckets = model.partitions_for(model.table(spark, d, "numeric_data"))
    joined = validity.as_known_at(events, validity.current_states(entries, VERSION), buckets=buckets)
    return joined.where("entry_id is not null").select("endpoint_name", "entry_id", "reading_id", "default_calibration")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_states(spark, d).select("entry_id", "reading_id").distinct()


def p6_implausible(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings with the reason."""
    # the table's own count is read from the files' footers
    readings = model.table(spark, d, "numeric_data")
    return spikes.flag_implausible(common(spark, d), partitions=model.partitions_for(readings, 200_000), sizes=readings)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_implausible(spark, d).select("reading_id").distinct()


def p6_impossible(spark: SparkSession, d: str) -> DataFrame:
    """Those of the implausible readings that are physically impossible."""
    return p6_implausible(spark, d).where("reason = 'impossible'").select("reading_id", "endpoint_name")


def p6_stuck(spark: SparkSession, d: str) -> DataFrame:
    """Those of the implausible readings that belong to a stuck run."""
    return p6_implausible(spark, d).where("reason = 'stuck'").select("reading_id", "endpoint_name")


QUERIES = {f.__name__: f for f in (p2_found, p2_common_values, p3_found, p3_regular_series, p5_found, p6_implausible, p6_found, p6_impossible, p6_stuck)}

_ENTRIES = f"""
entries as (
  select distinct entry_id, entered_at, valid_if, default_calibration, label,
    coalesce(nullif(trim(dripline_endpoint), ''), array_to_string(list_concat(
      [case when default_calibration like '%:%' then trim(split_part(default_calibration, ':', 1)) else split_part(sensor_name, '.', 1) end],
      (string_split(regexp_replace(sensor_name, '\\.{SETUP}$', '', 'i'), '.'))[2:]), '_')) as endpoint_name,
    valid_if is null or regexp_matches(valid_if, '[0-9]O[0-9]') as always,
    valid_if like '!%' as negated,
    try_cast(coalesce(nullif(regexp_extract(valid_if, 'date *>= *([0-9]+)', 1), ''), nullif(regexp_extract(valid_if, '([0-9]+) *<= *date', 1), '')) as bigint) as ge,
    try_cast(nullif(regexp_extract(valid_if, 'date *> *([0-9]+)', 1), '') as bigint) as gt,
    try_cast(nullif(regexp_extract(valid_if, 'date *<= *([0-9]+)', 1), '') as bigint) as le,
    try_cast(nullif(regexp_extract(valid_if, 'date *< *([0-9]+)', 1), '') as bigint) as lt,
    coalesce(try_cast(nullif(regexp_extract(valid_if, 'version *>= *([0-9]+)', 1), '') as bigint) <= {VERSION}, true) as version_holds
  from sensor_table where entry_id is not null and entered_at is not null),
days as (select distinct endpoint_name, cast("timestamp" as date) as day, cast(strftime("timestamp", '%Y%m%d') as bigint) as n from numeric_data),
valid as (
  select e.*, d.day from entries e join days d on e.endpoint_name = d.endpoint_name
  where e.always or case when e.negated then not (coalesce(d.n < e.lt, false) or coalesce(d.n >= e.ge, false))
    else coalesce(d.n >= e.ge, true) and coalesce(d.n > e.gt, true) and coalesce(d.n <= e.le, true) and coalesce(d.n < e.lt, true) and e.version_holds end),
read as (select distinct reading_id, endpoint_name, "timestamp" as at, value_raw, memo from numeric_data where value_raw is not null and not isnan(value_raw)),
applying as (
  select r.reading_id, r.endpoint_name, r.at, r.value_raw, r.memo, v.entry_id, v.default_calibration, v.label
  from read r asof left join (select *, greatest(entered_at, cast(day as timestamp)) as since from valid
    qualify row_number() over (partition by endpoint_name, day, greatest(entered_at, cast(day as timestamp)) order by entered_at desc, entry_id desc) = 1) v
  on r.endpoint_name = v.endpoint_name and cast(r.at as date) = v.day and r.at >= v.since)
"""
# The SQL takes units from texts its own way: leads are cut off, spellings are listed here.
_SPELT = """('k', 'K'), ('kelvin', 'K'), ('degc', 'degC'), ('deg c', 'degC'), ('°c', 'degC'), ('celsius', 'degC'), ('degf', 'degF'), ('deg f', 'degF'), ('°f', 'degF'), ('fahrenheit', 'degF'),
  ('degrees fahrenheit', 'degF'), ('psia', 'psia'), ('psi absolute', 'psia'), ('pa', 'Pa'), ('pascal', 'Pa'), ('pascals', 'Pa'), ('torr', 'Torr'), ('mtorr', 'mTorr'), ('millitorr', 'mTorr'), ('mbar', 'mbar'), ('millibar', 'mbar'),
  ('v', 'V'), ('volt', 'V'), ('mv', 'mV'), ('millivolt', 'mV'), ('a', 'A'), ('ampere', 'A'), ('ma', 'mA'), ('milliampere', 'mA'), ('sccm', 'sccm'), ('slm', 'slm')"""
_UNITS = (
    _ENTRIES
    + f""",
aliases as (select distinct * from (values {_SPELT}) as t(alias, unit) where unit in (select unit from unit_def)),
texts as (
  select *, lower(split_part(endpoint_name, '_', 1)) as name_text, lower(trim(split_part(default_calibration, ':', 1))) as input_text,
    case when lower(label) like '%degrees fahrenheit' then 'degf' when lower(label) like '%reads psi absolute' then 'psia' when lower(label) like '%(celsius)' then 'degc' end as label_text,
    case when memo like 'panel shows %' then substr(memo, 13) else memo end as shown
  from applying),
named as (
  select *, lower(trim(case
    when (memo like '(%)' or memo like '[%]') then substr(memo, 2, length(memo) - 2)
    when starts_with(memo, 'unit: ') then substr(memo, 7) when starts_with(memo, 'Einheit ') then substr(memo, 9)
    when starts_with(memo, 'value in ') then substr(memo, 10) when starts_with(memo, 'logged in ') then substr(memo, 11)
    when starts_with(memo, 'reading taken in ') then substr(memo, 18) when starts_with(memo, 'entered by hand as ') then substr(memo, 20)
    when memo like 'this one is %, panel was switched' then substr(memo, 13, length(memo) - 32)
    when abs(try_cast(split_part(shown, ' ', 1) as double) - value_raw) <= 1e-6 * abs(value_raw) then substr(shown, length(split_part(shown, ' ', 1)) + 2) end)) as memo_text
  from texts),
united as (
  select n.*, u.unit, u.quantity, u.common_unit, n.value_raw * u.factor + u.shift as value_common
  from named n left join aliases a1 on a1.alias = memo_text left join aliases a2 on a2.alias = input_text
    left join aliases a3 on a3.alias = label_text left join aliases a4 on a4.alias = name_text
    left join unit_def u on u.unit = coalesce(a1.unit, a2.unit, a3.unit, a4.unit))
"""
)
_GRID = """
read as (
  select distinct reading_id, endpoint_name, epoch_us("timestamp") as us, value_raw from numeric_data where value_raw is not null and not isnan(value_raw)),
cells as (
  select endpoint_name, period_s, us // 86400000000 as day, us // (period_s * 1000000) as cell, count(*) as n, avg(value_raw) as value
  from read join endpoint_id_map using (endpoint_name) where period_s > 0 group by all),
spans as (select endpoint_name, period_s, day, min(cell) as lo, max(cell) as hi from cells group by all),
grid as (select endpoint_name, period_s, day, unnest(range(lo, hi + 1)) as cell from spans),
full_grid as (select g.endpoint_name, g.day, g.cell * g.period_s as cell_start, g.period_s, g.cell, c.n, c.value from grid g left join cells c using (endpoint_name, period_s, day, cell)),
carried as (select *, last_value(case when n is not null then cell end ignore nulls) over w as last_cell, last_value(value ignore nulls) over w as last_value
  from full_grid window w as (partition by endpoint_name, day order by cell))
"""
_CODES = ", ".join(f"{c!r}" for c in spikes.ERROR_CODES)
_RUNS = f"""
timed as (select distinct reading_id, endpoint_name, "at", coalesce(value_common, value_raw) as v from united where reading_id is not null and endpoint_name is not null and "at" is not null),
stepped as (select *, case when v = lag(v) over (partition by endpoint_name order by "at", reading_id) then 0 else 1 end as new from timed),
numbered as (select *, sum(new) over (partition by endpoint_name order by "at", reading_id rows unbounded preceding) as run from stepped),
runs as (select endpoint_name, run, count(*) as n from numbered group by 1, 2),
usual as (select endpoint_name, quantile_disc(n, 0.5) as half, quantile_disc(n, 0.9) as most from runs group by 1)
"""
ORACLE = {
    "p6_impossible": f"""with {_UNITS} select distinct reading_id, endpoint_name from united where reading_id is not null and endpoint_name is not null and "at" is not null
        and (value_raw in ({_CODES}) or abs(value_raw) >= 1e30 or (quantity = 'temperature' and value_common < -273.15 - 1e-9 * 273.15) or (quantity = 'pressure' and value_common < 0))""",
    "p6_stuck": f"""with {_UNITS}, {_RUNS} select reading_id, endpoint_name from numbered join runs using (endpoint_name, run) join usual using (endpoint_name)
        where half < 10 and n >= 10 and n >= 3 * most""",
    "p2_found": f"with {_UNITS} select distinct reading_id, unit from united where unit <> common_unit",
    "p2_common_values": f"with {_UNITS} select distinct reading_id, endpoint_name, quantity, common_unit, value_common from united",
    "p3_found": f"with {_GRID} select endpoint_name, cell_start from full_grid where n is null",
    "p3_regular_series": f"""with {_GRID} select endpoint_name, cast(date '1970-01-01' + cast(day as integer) as varchar) as day, cell_start, coalesce(n, 0) as n,
        case when n is not null then 'read' when (cell - last_cell) * period_s <= 60 then 'filled' else 'missing' end as status,
        cast(printf('%.8e', case when (cell - last_cell) * period_s <= 60 then last_value end) as double) as filled from carried""",
    "p5_found": f"""with {_ENTRIES} select distinct entry_id, reading_id from applying where entry_id is not null
        and endpoint_name in (select endpoint_name from entries where default_calibration is not null)""",
}
