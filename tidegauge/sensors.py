"""The sensor table: hierarchical names, partial matching, conditional entries, binding to endpoints. Driver-side, small."""

from __future__ import annotations

import datetime as dt
import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import expr as X

# Node kinds in the order in which they are visited, and those that make a sensor.
NODE_KINDS = ("experiment", "setup", "teststand", "system", "section", "subsection", "division", "segment", "crate", "module", "device", "card", "board", "channel", "endpoint", "metric")
LEAF_KINDS = ("channel", "endpoint", "metric")
FIRST_NUMBER = 0x10000000
DELIMITERS = "./:;-_"


def split_name(text: str, delimiters: str = DELIMITERS) -> list[str]:
    """Parts of a name: it is split only at the first of ``delimiters`` (in their order) that occurs in it."""
    for c in delimiters:
        if c in text:
            return [p for p in text.split(c) if p]
    return [text] if text else []


def join_name(parts: Iterable[str], delimiter: str = ".") -> str:
    return delimiter.join(p for p in parts if p)


def is_like(name: list[str], pattern: list[str]) -> bool:
    """The pattern's parts occur in the name in their order, with gaps allowed; an empty pattern matches."""
    rest = iter(name)
    return all(any(p == n for n in rest) for p in pattern)


def like_column(name: Column, pattern: list[str]) -> Column:
    """:func:`is_like` for a column of name arrays."""
    if not pattern:
        return F.lit(True)
    wanted = F.array(*(F.lit(p) for p in pattern))
    return F.aggregate(name, F.lit(0), lambda k, n: k + F.when(F.coalesce(F.get(wanted, k), F.lit("")) == n, 1).otherwise(0)) == len(pattern)


@dataclass
class Sensor:
    number: int
    name: list[str]
    label: list[str] = field(default_factory=list)
    calibration: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.number > 0

    def to_dict(self, fields: Iterable[str] = ("number", "name", "label", "calibration", "options"), delimiter: str = ".") -> dict:
        all_ = {"number": self.number, "name": join_name(self.name, delimiter), "label": ", ".join(self.label), "calibration": self.calibration, "options": dict(self.options)}
        return {f: all_[f] for f in fields}


def default_variables(today: dt.date | None = None) -> dict[str, int]:
    """``version`` 1 and today's UTC date as YYYYMMDD."""
    d = today or dt.datetime.now(dt.timezone.utc).date()
    return {"version": 1, "date": d.year * 10000 + d.month * 100 + d.day}


class SensorTable:
    """Sensors by number and by name."""

    def __init__(self) -> None:
        self.sensors: dict[int, Sensor] = {}
        self.by_name: dict[tuple[str, ...], int] = {}
        self._next = FIRST_NUMBER

    def new_number(self) -> int:
        self._next += 1
        return self._next - 1

    def add(self, s: Sensor) -> Sensor:
        self.sensors[s.number] = s
        self.by_name[tuple(s.name)] = s.number
        return s

    def __getitem__(self, key: int | list[str] | tuple[str, ...]) -> Sensor:
        """A sensor by number or exact name; an empty one (number 0) if there is none."""
        number = key if isinstance(key, int) else self.by_name.get(tuple(key), 0)
        return self.sensors.get(number, Sensor(0, []))

    def find_like(self, pattern: list[str]) -> list[int]:
        """Numbers of the sensors whose names match, ascending."""
        return [n for n, s in sorted(self.sensors.items()) if is_like(s.name, pattern)]

    def find_one_like(self, pattern: list[str]) -> Sensor:
        """The only match; an error if there is none or more than one."""
        found = self.find_like(pattern)
        if len(found) != 1:
            raise LookupError(f"{'no' if not found else 'more than one'} sensor is like {join_name(pattern)}")
        return self.sensors[found[0]]

    # ---- construction

    def load_tree(self, tree: dict, variables: dict[str, int] | None = None) -> SensorTable:
        """Adds the sensors of a configuration: a tree as :func:`tidegauge.sources.trees.load_tree` gives it."""
        self._layer(tree.get("sensor_table", tree), [], [], {}, variables or default_variables())
        return self

    def _layer(self, node: dict, name: list[str], label: list[str], options: dict[str, str], variables: dict) -> None:
        for kind in NODE_KINDS:
            for child in _as_nodes(node.get(kind)):
                condition = child.get("valid_if")
                if condition not in (None, ""):
                    try:
                        if not X._bool(X.evaluate(str(condition), variables), "valid_if"):
                            continue
                    except X.ExpressionError as e:
                        warnings.warn(f"valid_if can't be evaluated, kept: {e}", stacklevel=2)
                ident = child.get("id") if isinstance(child.get("id"), dict) else {}
                own, shown = str(ident.get("name", "")), str(ident.get("label", ident.get("name", "")))
                size = int(child.get("array_length", -1))
                for j in range(max(1, size)):
                    opts = {**options, **{k[2:]: str(v) for k, v in child.items() if k[:2] in ("x-", "x_") and len(k) > 2}}
                    names, labels = [indexed(own, size, j), *name], [indexed(shown, size, j), *label]
                    if kind in LEAF_KINDS:
                        calibration = str(child.get("default_calibration", "") or "")
                        self.add(Sensor(self.new_number(), names, labels, calibration, opts))
                    else:
                        self._layer(child, names, labels, opts, variables)

    def load_names(self, names: Iterable[str], base: list[str] | None = None, name_space: str = "dripline_endpoint", delimiters: str = DELIMITERS) -> SensorTable:
        """Binds data names to sensors: by explicit option, else to the only partial match, else to a new sensor.

        A name that is like several sensors is left out with a warning.
        """
        base = base or []
        bound = {s.options[name_space] for s in self.sensors.values() if s.options.get(name_space)}
        for n in names:
            if n in bound:
                continue
            chain = [*split_name(n, delimiters), *base]
            found = self.find_like(chain)
            if len(found) > 1:
                warnings.warn(f"{n} is like several sensors", stacklevel=2)
                continue
            s = self.sensors[found[0]] if found else Sensor(self.new_number(), chain, list(chain))
            s.options[name_space] = n
            self.add(s)
        return self

    def endpoints(self, name_space: str = "dripline_endpoint") -> dict[int, str]:
        """Endpoint of each bound sensor."""
        return {n: s.options[name_space] for n, s in self.sensors.items() if s.options.get(name_space)}

    def to_rows(self) -> list[tuple]:
        """Rows ``(number, name, label, calibration, options)`` for a DataFrame."""
        return [(s.number, s.name, s.label, s.calibration, s.options) for _, s in sorted(self.sensors.items())]


SENSOR_SCHEMA = "number int, name array<string>, label array<string>, calibration string, options map<string,string>"


def _as_nodes(x: object) -> list[dict]:
    return [n for n in (x if isinstance(x, list) else [x]) if isinstance(n, dict)]


def indexed(name: str, size: int, j: int) -> str:
    """Name of an array's element: its index, padded to the digits that the largest needs, follows."""
    if size < 0:
        return name
    return f"{name}{str(j).rjust(len(str(max(size, 1) - 1)), '0')}"


@dataclass(frozen=True)
class Calibration:
    """How a sensor derives from its input: identity, an expression of ``x``, or unusable (every value is missing)."""

    sensor: int
    input: int
    identity: bool
    node: tuple | None


def read_calibration(s: Sensor, table: SensorTable, strict_probe: bool = True) -> Calibration | None:
    """The calibration ``INPUT: expression`` of a sensor; None if it has none.

    The input's name overlays the sensor's own from the leaf on and is then looked up as a partial name, else as an exact
    one. A missing or ambiguous input is a :class:`LookupError`. An expression that can't be parsed, or (``strict_probe``)
    can't be evaluated at 0, makes every value missing.
    """
    text = s.calibration.strip()
    if not text:
        return None
    variable, _, body = (p.strip() for p in text.partition(":"))
    parts = split_name(variable, "./-_")
    chain = parts if len(s.name) < len(parts) else [*parts, *s.name[len(parts):]]
    found = table.find_like(chain)
    if len(found) > 1:
        raise LookupError(f"ambiguous calibration input: {variable}")
    number = found[0] if found else table[parts].number
    if not number:
        raise LookupError(f"no calibration input: {variable}")
    if body in ("", variable):
        return Calibration(s.number, number, True, None)
    try:
        plain = re.sub(rf"(?<![A-Za-z0-9_.]){re.escape(variable)}(?![A-Za-z0-9_])", "x", body) if not variable.isidentifier() else body
        node = X.substitute(X.parse(plain), variable, ("name", "x"))
        if strict_probe:
            X.evaluate(node, {"x": 0.0})
    except X.ExpressionError as e:
        warnings.warn(f"bad calibration {text!r}: {e}", stacklevel=2)
        node = None
    return Calibration(s.number, number, False, node)


def chain_of(number: int, table: SensorTable, strict_probe: bool = True) -> tuple[int, list[Calibration]]:
    """Root sensor and the calibrations from it to the sensor, in the order of application. A cycle is an error."""
    steps, seen = [], set()
    while True:
        if number in seen:
            raise LookupError(f"calibration cycle at {join_name(table[number].name)}")
        seen.add(number)
        s = table[number]
        c = None if s.options.get("dripline_endpoint") and not s.calibration else read_calibration(s, table, strict_probe)
        if c is None or c.input == number:
            return number, steps[::-1]
        steps.append(c)
        number = c.input


def calibrate(x: Column, steps: list[Calibration], strict: bool = False, functions: dict | None = None) -> Column:
    """The chain applied to a column, as one nested expression."""
    from tidegauge.functions.columns import Compiler, Value

    for c in steps:
        if c.identity:
            continue
        if c.node is None:
            return F.lit(None).cast("double")
        compiler = Compiler({"x": Value(x, "double")}, functions, strict)
        x = compiler.double(compiler.compile(c.node), "calibration")
    return x


def linear(node: object) -> tuple[float, float] | None:
    """(slope, value at 0) of an expression that is linear in ``x``, else None."""
    if not _mentions(node):
        try:
            v = X.evaluate(node)
        except X.ExpressionError:
            return None
        return (0.0, float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
    if node == ("name", "x"):
        return 1.0, 0.0
    if node[0] == "un" and node[1] in ("+", "-"):
        inner = linear(node[2])
        return inner and ((inner[0], inner[1]) if node[1] == "+" else (-inner[0], -inner[1]))
    if node[0] != "bin" or node[1] not in ("+", "-", "*", "/"):
        return None
    a, b = linear(node[2]), linear(node[3])
    if a is None or b is None:
        return None
    if node[1] in ("+", "-"):
        sign = 1 if node[1] == "+" else -1
        return a[0] + sign * b[0], a[1] + sign * b[1]
    if node[1] == "*" and (a[0] == 0 or b[0] == 0) and not (_mentions(node[2]) and _mentions(node[3])):
        return (a[0] * b[1], a[1] * b[1]) if _mentions(node[2]) else (a[1] * b[0], a[1] * b[1])
    if node[1] == "/" and not _mentions(node[3]) and b[1] != 0:
        return a[0] / b[1], a[1] / b[1]
    return None


def _mentions(node: object, name: str = "x") -> bool:
    return isinstance(node, tuple) and (node == ("name", name) or any(_mentions(n, name) for n in node))


def slope(steps: list[Calibration]) -> int | None:
    """1 or -1 if a chain rises or falls everywhere with its input, each step being linear and mentioning it once; else None."""
    sign = 1
    for c in steps:
        if c.identity:
            continue
        form = None if c.node is None or repr(c.node).count("('name', 'x')") != 1 else linear(c.node)
        if form is None or form[0] == 0:
            return None
        sign = sign if form[0] > 0 else -sign
    return sign
