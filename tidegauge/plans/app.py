"""The surface: find sensors by partial name and read their calibrated series."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import sensors
from tidegauge.operators import resample, series
from tidegauge.sources import trees
from tidegauge.sources.tables import Source


CONFIG_VARIABLE = "TIDEGAUGE_CONFIG_PATH"


class App:
    """Sensors of a configuration bound to the names of a data source."""

    def __init__(
        self,
        spark: SparkSession,
        source: Source | None = None,
        config: str | None = None,
        tree: dict | None = None,
        variables: dict[str, int] | None = None,
        base: list[str] | None = None,
        delimiters: str | None = None,
        name_space: str = "dripline_endpoint",
    ):
        """``config`` is a tree file or a directory whose ``.ktf`` files are all read, in order of their names; without it and
        without ``tree``, the directory that the environment's ``TIDEGAUGE_CONFIG_PATH`` names, if any."""
        self.spark, self.source, self.name_space = spark, source, name_space
        self.table = sensors.SensorTable()
        loaded = [tree] if tree is not None else [trees.load_tree(str(p)) for p in _config_files(config or os.environ.get(CONFIG_VARIABLE))]
        options: dict = {}
        for t in loaded:
            self.table.load_tree(t, {**sensors.default_variables(), **(variables or {})})
            options |= t.get("options") or {}
        self.delimiters = delimiters or str(options.get("input_delimiter") or options.get("delimiter_input") or sensors.DELIMITERS)
        self.output_delimiter = str(options.get("output_delimiter") or options.get("delimiter_output") or ".")
        if source is not None:
            self.table.load_names(source.names(), base, name_space, self.delimiters)

    # ---- names

    def find_like(self, *names: str) -> list[sensors.Sensor]:
        """Sensors like any of the names, once each, by number; without names, all."""
        numbers = {n for name in names or ("",) for n in self.table.find_like(sensors.split_name(name, self.delimiters))}
        return [self.table[n] for n in sorted(numbers)]

    def sensors(self) -> DataFrame:
        """The sensor table as a DataFrame."""
        return self.spark.createDataFrame(self.table.to_rows(), sensors.SENSOR_SCHEMA)

    def resolve(self, names: Iterable[str]) -> list[tuple[str, int]]:
        """(column name, sensor number): the user's spelling for one match, full names for several, number 0 for none."""
        out: list[tuple[str, int]] = []
        for name in names:
            found = self.table.find_like(sensors.split_name(name, self.delimiters))
            if len(found) == 1:
                out.append((name, found[0]))
            elif not found:
                out.append((name, 0))
            else:
                out += [(sensors.join_name(self.table[n].name, self.output_delimiter), n) for n in found]
        return out

    # ---- data

    def read(self, names: Iterable[str], start: float, stop: float, strict: bool = False, strict_probe: bool = True) -> DataFrame:
        """Long series ``(name, i, t, x)`` of the sensors, calibrated, start <= t < stop.

        Derived sensors are computed from their root's readings by one expression; sensors with one root share its scan.
        A sensor without data, without endpoint or without usable calibration has no point or only missing values; a missing,
        ambiguous or circular calibration input is a warning, and an error only with ``strict``.
        """
        wanted = self._wanted(names, strict, strict_probe)
        raw = self.source.range([e for _, e, _ in wanted], start, stop)
        if not wanted:
            return raw
        # one pass over the scan: each reading gives the points of all columns that derive from its endpoint
        points = [F.when(F.col("name") == e, F.struct(F.lit(c).alias("name"), sensors.calibrate(F.col("x"), steps, strict).alias("x"))) for c, e, steps in wanted]
        spread = raw.withColumn("p", F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())))
        return spread.select(F.col("p.name").alias("name"), "i", "t", F.col("p.x").alias("x"))

    def _wanted(self, names: Iterable[str], strict: bool, strict_probe: bool) -> list[tuple[str, str, list[sensors.Calibration]]]:
        """(column, endpoint, calibrations from it) of the names that can be read."""
        if self.source is None:
            raise ValueError("no data source")
        endpoints = self.table.endpoints(self.name_space)
        wanted = []
        for column, number in self.resolve(names):
            if number:
                try:
                    root, steps = sensors.chain_of(number, self.table, strict_probe)
                except LookupError as e:
                    if strict:
                        raise
                    warnings.warn(f"{column} has no values: {e}", stacklevel=3)
                    continue
                if root in endpoints:
                    wanted.append((column, endpoints[root], steps))
        return wanted

    def extremes(self, names: Iterable[str], grid: resample.Grid, start: float, stop: float, reducer: str) -> DataFrame | None:
        """Reduced buckets ``(name, k, x)`` for ``min`` and ``max`` with the readings reduced before they are calibrated.

        That is exact where every chain rises or falls everywhere, which is checked on linear calibrations; None elsewhere.
        The readings are reduced once for each endpoint, however many sensors derive from it.
        """
        wanted = self._wanted(names, False, True) if reducer in ("min", "max") else []
        signs = [sensors.slope(steps) for _, _, steps in wanted]
        if not wanted or None in signs:
            return None
        raw = resample.into_buckets(self.source.range([e for _, e, _ in wanted], start, stop), grid)
        both = raw.groupBy("name", "k").agg(F.min("x").alias("min"), F.max("x").alias("max"))
        other = {"min": "max", "max": "min"}
        points = [
            F.when(F.col("name") == e, F.struct(F.lit(c).alias("name"), sensors.calibrate(F.col(reducer if s > 0 else other[reducer]), steps).alias("x")))
            for (c, e, steps), s in zip(wanted, signs)
        ]
        spread = both.withColumn("p", F.explode(F.filter(F.array(*points), lambda p: p.isNotNull())))
        return spread.select(F.col("p.name").alias("name"), "k", F.col("p.x").alias("x"))

    def summary(self, names: Iterable[str], start: float, stop: float, reducers: list[str]) -> DataFrame:
        """One row per sensor with the reducers' values."""
        return series.reduce(self.read(names, start, stop), reducers, (start, stop))

    def frame(self, names: Iterable[str], start: float, stop: float, step: float | None = None, reducer: str = "last", filler: str = "none", value: float | None = None) -> DataFrame:
        """Aligned wide frame; without a step, that of the upper median of the sampling intervals."""
        names = list(names)
        columns = list(dict.fromkeys(c for c, _ in self.resolve(names)))
        if step is None:
            long = self.read(names, start, stop)
            grid = resample.align(long, "auto", {c: (start, stop) for c in columns})
        else:
            grid = resample.Grid.by_time(start, stop, step)
            if (early := self.extremes(names, grid, start, stop, reducer)) is not None:
                every = self.spark.createDataFrame([(c,) for c in columns], "name string")
                return resample.widen(resample.on_grid(early, grid, every, filler, value), columns)
            long = self.read(names, start, stop)
        return resample.frame(long, grid, columns, reducer, filler, value)


def _config_files(config: str | None) -> list[Path]:
    if not config:
        return []
    p = Path(config)
    return sorted(p.glob("*.ktf")) if p.is_dir() else [p]


def union(frames: Iterable[DataFrame]) -> DataFrame:
    """Bundles of series side by side in one long table."""
    return reduce(DataFrame.unionByName, frames)
