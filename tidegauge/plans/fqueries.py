"""Queries of the remaining families: sources and formats, trees, mathematics, casts, names and sensors, frames, command line."""

from __future__ import annotations

import contextlib
import dataclasses
import io
import plistlib
import sys
import warnings
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import cli, model, sensors
from tidegauge.functions.columns import Compiler, Value, compile_expression
from tidegauge.functions.text import split_by
from tidegauge.operators import resample
from tidegauge.operators import series as S
from tidegauge.plans.app import App
from tidegauge.plans.cqueries import app
from tidegauge.plans.squeries import _FIRST, START, STEP, STOP, TYPES, gappy, series, source
from tidegauge.sources import render, tables, trees
from tidegauge.sources.tables import Source

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_SPAN = "ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- sources


@query(
    " union all ".join(f"select '{n}' as name, event_id as i, value as x from events where event_type = '{n}' and {_SPAN}" for n in ("click", "view", "click"))
    + f" union all select 'linear', event_id, 2.5 * value - 7 from events where event_type = 'click' and {_SPAN}"
)
def endpoint_fanout(spark, d):
    """A sensor asked for twice comes twice, one without endpoint not at all, a derived one with its root's scan."""
    return app(spark, d).read(["click", "view", "click", "unbound", "linear"], START, STOP).select("name", "i", "x")


@query(f"select 'view' as name, event_id as i, epoch_us(ts) / 1000000 as t, value as x from events where event_type = 'view' and {_SPAN}")
def source_single(spark, d):
    """One sensor alone."""
    return app(spark, d).read(["view"], START, STOP).select("name", "i", "t", "x")


@query("select distinct endpoint_name as name from endpoint_id_map where endpoint_name is not null")
def source_dictionary(spark, d):
    """Names come from the dictionary where there is one, those without readings included."""
    return Source.directory(spark, d).name_table()


@query(
    " union all ".join(
        f"select '{t}' as table_name, column_name, column_name = '{c}' as names from (describe {t})"
        for t, c in (("numeric_data", "endpoint_name"), ("endpoint_id_map", "endpoint_name"), ("spot_check", "endpoint_name"), ("sensor_table", "sensor_name"), ("nation", ""))
    )
)
def source_schema(spark, d):
    """Tables of a directory, their columns, and which of them names the source of a reading."""
    return tables.probe(spark, d).where(F.col("table_name").isin("numeric_data", "endpoint_id_map", "spot_check", "sensor_table", "nation"))


@query("select 'a' as name, cast(0 as bigint) as i, cast(0 as double) as t, cast(0 as double) as x where false")
def source_empty(spark, d):
    return Source.empty(spark).range(["a"], START, STOP)


@query(f"select event_type as name, event_id as i, epoch_us(ts) / 1000000 as t, value as x from events where event_type in ('view', 'error') and {_SPAN}")
def source_csv(spark, d):
    """The events written as CSV and read as a source of readings."""
    path = model.scratch(spark, "csv")
    source(spark, d).readings.write.options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return Source.csv(spark, path, "endpoint_name string, timestamp timestamp_ntz, value_raw double, reading_id long").range(["view", "error"], START, STOP)


_SUPPLIERS = "select s_suppkey as id, s_name as name, s_acctbal as balance, s_nationkey % 5 = 0 as marked, case when s_nationkey % 3 > 0 then s_nationkey end as nation from supplier"


def _table(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    s = model.table(spark, d, "supplier")
    s = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), (F.col("s_nationkey") % 5 == 0).alias("marked"), F.expr("case when s_nationkey % 3 > 0 then s_nationkey end").alias("nation"))
    path = model.scratch(spark, "table")
    tables.write_table(s, path, suffix, {"Creator": "suppliers"} if suffix == ".ktf" else None)
    r = tables.read_table(spark, path, suffix=suffix)
    return r.select(F.col("id").cast("long").alias("id"), "name", "balance", (F.lower("marked") == "true").alias("marked"), F.col("nation").cast("int").alias("nation"))


@query(_SUPPLIERS)
def table_ktf(spark, d):
    """A table written as text tables with header trees and read again."""
    return _table(spark, d, ".ktf")


@query(_SUPPLIERS)
def table_csv(spark, d):
    return _table(spark, d, ".csv")


@query(
    "select * from (values ('typed', 0, '1', '2.5', 'a b'), ('typed', 0, '2', null, 'c'), ('typed', 1, '3', '40.0', 'd e'), ('leaves', 0, '1', '2', '3.5'), ('leaves', 1, '4', '5', '6.0'),"
    " ('plain', 0, '1.0', 'x', null), ('plain', 0, '2.0', null, 'z')) as t(source, segment, a, b, c)"
)
def table_embedded(spark, d):
    """Tables from texts: declared types, quotes, escapes, all three line ends, a leaf descriptor, a line of names."""
    texts = {
        "typed": ("# Fields: a b c\n# FieldTypes: int float string\n\n1 2.5 'a b'\r\n2 \"\" c\r\r3 4e1 d\\ e\n", ".ktf"),
        "leaves": ("n[2]/I:x/D\n1 2 3.5\n\n4 5 6\n", ".ktf"), "plain": ("a,b,c\n1,x,\n2,,\"z\"\n", ".csv"),
    }
    out = []
    for name, (text, suffix) in texts.items():
        t = tables.TextTable(text, suffix)
        out += [(name, s, *(None if v is None else str(v) for v in r)) for r, s in zip(t.rows, t.segments)]
    return spark.createDataFrame(out, "source string, segment int, a string, b string, c string")


# ---- trees

_TREES = {
    ".json": '{a: one two, "b": [1, 2.5, nan], c: {d: 0x10, e: true}, /* note */ a: "x\\u0041"}',
    ".ini": "[s]\nk = 1 ; note\np.q = \"a;b\"\n[s]\nk = 2.5\n",
    ".ktf": "# a: first\n#  : second\n# b:\n#   c: {k: v}\n#   l: [1, x]\n# e:\n# m:\n#   - 3\n#   - y\n1 2 3\n",
    ".xpvp": "a/b: 1; a/c[1]: x y\na@unit: mm; t: \"q\"",
}
_LEAVES = [
    (".json", "a[0]", "one two"), (".json", "a[1]", "xA"), (".json", "b[0]", "1"), (".json", "b[1]", "2.5"), (".json", "b[2]", "nan"), (".json", "c/d", "16"), (".json", "c/e", "true"),
    (".ini", "s[0]/k", "1"), (".ini", "s[0]/p/q", "a;b"), (".ini", "s[1]/k", "2.5"),
    (".ktf", "a", "first|second"), (".ktf", "b/c/k", "v"), (".ktf", "b/l[0]", "1"), (".ktf", "b/l[1]", "x"), (".ktf", "e", ""), (".ktf", "m[0]", "3"), (".ktf", "m[1]", "y"),
    (".xpvp", "a/b", "1"), (".xpvp", "a/c[0]", ""), (".xpvp", "a/c[1]", "x y"), (".xpvp", "a@unit", "mm"), (".xpvp", "t", "q"),
]


def _values(rows: list[tuple], names: str) -> str:
    word = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else f"cast({v!r} as double)" if isinstance(v, float) else "'" + str(v).replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(word(v) for v in r) + ")" for r in rows) + f") as t({names})"


def _leaf(v: object) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v).replace("\n", "|")


@query(_values(_LEAVES, "format, path, leaf"))
def tree_formats(spark, d):
    """Leaves of the same kinds of trees in each readable format."""
    rows = [(suffix, path, _leaf(v)) for suffix, text in _TREES.items() for path, v in trees.walk(trees.READERS[suffix](text))]
    return spark.createDataFrame(rows, "format string, path string, leaf string")


_PLAIN = {"a": 1, "b": {"c": "x y", "l": [1, 2]}, "t": True, "f": 2.5}
_PLAIN_LEAVES = [("a", "1"), ("b/c", "x y"), ("b/l[0]", "1"), ("b/l[1]", "2"), ("t", "true"), ("f", "2.5")]


@query(_values([(k, p, v) for k in (".json", ".ktf", ".ini", ".xpvp", ".plist", ".xml") for p, v in _PLAIN_LEAVES], "format, path, leaf"))
def tree_writers(spark, d):
    """A tree written in each format and read again, plist and XML by the standard library."""

    def of_xml(e: ElementTree.Element) -> object:
        out: trees.Tree = trees.Tree()
        for child in e:
            trees.put(out, child.tag, of_xml(child) if len(child) else trees.infer(child.text or ""))
        return out

    rows = []
    for suffix in (".json", ".ktf", ".ini", ".xpvp", ".plist", ".xml"):
        text = trees.WRITERS[suffix](_PLAIN)
        if suffix == ".plist":
            back = plistlib.loads(text.encode())
        elif suffix == ".xml":
            back = of_xml(ElementTree.fromstring(text.encode()))
        else:
            back = trees.READERS[suffix](text.replace(";\n", "\n") if suffix == ".ini" else text)
        rows += [(suffix, path, _leaf(v)) for path, v in trees.walk(back)]
    return spark.createDataFrame(rows, "format string, path string, leaf string")


@query(_values([(0, "a: 1"), (1, "b:"), (2, "  c: x y"), (3, "  l:"), (4, "    - 1"), (5, "    - 2"), (6, "t: true"), (7, "f: 2.5")], "no, line"))
def tree_yaml(spark, d):
    return spark.createDataFrame([(i, x) for i, x in enumerate(trees.to_yaml(_PLAIN).splitlines())], "no int, line string")


@dataclasses.dataclass
class _Channel:
    name: str
    gain: float = 1.0


@query(
    _values(
        [("append", "2,3"), ("link", "4"), ("unlink", "1"), ("left", "3"), ("merge", "[1, 5]"), ("path", "y"), ("up", "1"), ("default", "7"), ("visited", ",a,a[0],a[1],z"), ("decoded", "c 1.0"), ("clear", "0")],
        "operation, result",
    )
)
def tree_operations(spark, d):
    """Append, link, unlink, import, paths with defaults, visits with pruning, decoding, clear."""
    t = trees.parse_ktf("# a: 1\n# b:\n#   c: x\n")
    node = trees.append(t, "b/d")
    node["e"] = 2
    trees.append(t, "b/d")["e"] = 3
    rows = [("append", ",".join(str(x["e"]) for x in t["b"]["d"]))]
    trees.link(t, "other", node)
    node["e"] = 4
    rows += [("link", str(t["other"]["e"])), ("unlink", str(trees.unlink(t["b"], node))), ("left", ",".join(str(x["e"]) for x in t["b"]["d"]))]
    trees.merge(t, {"a": 5, "z": {"y": "y"}})
    rows += [("merge", str(t["a"])), ("path", trees.get_path(t, "z/y")), ("up", str(trees.get_path(t, "z/../a[0]"))), ("default", str(trees.get_path(t, "q/r", 7)))]
    del t["b"], t["other"]
    seen: list[str] = []
    trees.visit(t, lambda p, n: seen.append(p) or p != "z")
    rows += [("visited", ",".join(seen)), ("decoded", "{0.name} {0.gain}".format(trees.decode({"name": "c", "more": 1}, _Channel)))]
    trees.clear(t)
    rows.append(("clear", str(len(t))))
    return spark.createDataFrame(rows, "operation string, result string")


# ---- expressions


def _events(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "events").where("value is not null and not isnan(value)")


_MATH = {
    "sin": ("sin(x)", "sin(value)"), "cos": ("cos(x)", "cos(value)"), "tan": ("tan(x/500)", "tan(value / 500)"), "asin": ("asin(x/100)", "case when value / 100 <= 1 then asin(value / 100) end"),
    "acos": ("acos(x/100)", "case when value / 100 <= 1 then acos(value / 100) end"), "atan": ("atan(x)", "atan(value)"), "atan2": ("atan2(x, x - 50)", "atan2(value, value - 50)"), "exp": ("exp(x/100)", "exp(value / 100)"),
    "log10": ("log10(x - 1)", "case when value > 1 then log10(value - 1) end"), "abs": ("abs(x - 50)", "abs(value - 50)"), "arg": ("arg(x - 50)", "case when value < 50 then pi() else 0.0 end"),
    "real": ("real(x)", "value"), "imag": ("imag(x)", "0.0"), "ceil": ("ceil(x - 50)", "ceil(value - 50) + 0.0"), "floor": ("floor(x - 50)", "floor(value - 50)"), "whole": ("abs(n - 7)", "abs(event_id - 7)"),
}


@query("select event_id, " + ", ".join(f"round(cast({sql} as double), 6) as {n}" for n, (_, sql) in _MATH.items()) + " from events where value is not null and not isnan(value)")
def math_functions(spark, d):
    """The scalar functions; arguments outside a function's domain give NULL."""
    v = {"x": (F.col("value"), "double"), "n": (F.col("event_id"), "long")}
    return _events(spark, d).select("event_id", *(F.round(compile_expression(t, v).col.cast("double"), 6).alias(n) for n, (t, _) in _MATH.items()))


_A, _B = "(value / 100)", "0.5"
_COMPLEX = {
    "size": ("abs(x + 0.5i)", f"sqrt({_A} * {_A} + {_B} * {_B})"), "phase": ("arg(x + 0.5i)", f"atan2({_B}, {_A})"),
    "product": ("real((x + 0.5i) * (1 - 2i))", f"{_A} + 2 * {_B}"), "quotient": ("imag((x + 0.5i) / (1 - 2i))", f"({_B} + 2 * {_A}) / 5"),
    "sine": ("real(sin(x + 0.5i))", f"sin({_A}) * cosh({_B})"), "cosine": ("imag(cos(x + 0.5i))", f"-sin({_A}) * sinh({_B})"), "power_e": ("real(exp(x + 0.5i))", f"exp({_A}) * cos({_B})"),
    "square": ("imag((x + 0.5i)**2)", f"2 * {_A} * {_B}"), "negative": ("imag(-(x + 0.5i))", "cast(-0.5 as double)"), "pair": ("abs(complex(x, 2*x))", f"sqrt(5.0) * {_A}"),
}


@query("select event_id, " + ", ".join(f"round({sql}, 6) as {n}" for n, (_, sql) in _COMPLEX.items()) + " from events where value is not null and not isnan(value)")
def complex_functions(spark, d):
    v = {"x": (F.col("value") / 100, "double")}
    return _events(spark, d).select("event_id", *(F.round(compile_expression(t, v).col, 6).alias(n) for n, (t, _) in _COMPLEX.items()))


_CASTS = {
    "factorial": ("(k % 12)!", "cast(factorial(cast(c_custkey % 12 as integer)) as bigint)"), "picked": ("{'a'=>k, 'b'=>2*k}{'b'}", "2 * c_custkey"), "keys": ("keys({'a'=>k, 'b'=>1})", "'a,b'"),
    "subset": ("sizeof {'a'=>k, 'b'=>1}{{'a','c'}}", "cast(1 as bigint)"), "kind": ("typeof (k / 2.0)", "'double'"), "kinds": ("typeof {k, 1}", "'list'"), "whole": ("(int)(k / 4.0)", "cast(trunc(c_custkey / 4.0) as bigint)"),
    "text": ("(string)k", "cast(c_custkey as varchar)"), "number": ("(double)k", "cast(c_custkey as double)"), "truth": ("(bool)(k % 2)", "c_custkey % 2 <> 0"), "cast_list": ("(int){k / 2.0, 1.9}", "cast(trunc(c_custkey / 2.0) as bigint) || ',1'"),
    "zeros": ("zeros(k % 4)", "array_to_string(list_transform(range(c_custkey % 4), lambda i: 0), ',')"), "ones": ("ones(2) * k", "c_custkey || ',' || c_custkey"), "shifted": ("k >> 2", "c_custkey >> 2"),
    "chomped": ("chomp(s)", "cast(c_custkey % 3 as bigint)"), "rest": ("chomped(s)", "c_name"), "size": ("sizeof s", "length(c_name) + c_custkey % 3"), "picked_item": ("{k, k+1, k+2}[-1]", "c_custkey + 2"), "gathered": ("{k, k+1, k+2}[{2, 0}]", "(c_custkey + 2) || ',' || c_custkey"),
    "letter": ("s[0]", "'C'"), "span": ("[k:2:k+5]", "c_custkey || ',' || (c_custkey + 2) || ',' || (c_custkey + 4)"), "open_span": ("[k, k+3]", "c_custkey || ',' || (c_custkey + 1) || ',' || (c_custkey + 2)"),
    "both": ("k > 3 && k < 9 || !(k != 20)", "c_custkey > 3 and c_custkey < 9 or c_custkey = 20"), "sign": ("-(+k)", "-c_custkey"), "mean_of": ("average({k, k + 2.0})", "cast(c_custkey + 1 as double)"), "most_of": ("max({1.0, k})", "cast(greatest(1, c_custkey) as double)"),
}


@query("select c_custkey, " + ", ".join(f"{sql} as {n}" for n, (_, sql) in _CASTS.items()) + " from customer")
def casts_keys(spark, d):
    """Casts, keys, types, factorials, indices, ranges, list and string functions; lists are joined for comparison."""
    c = Compiler({"k": Value(F.col("c_custkey"), "long"), "s": Value(F.concat("c_name", F.expr("repeat('\\n', cast(c_custkey % 3 as int))")), "string")})
    out = []
    for n, (t, _) in _CASTS.items():
        v = c.compile(t)
        out.append((F.array_join(F.transform(v.col, lambda x: x.cast("string")), ",") if v.type == "list" else v.col).alias(n))
    return model.table(spark, d, "customer").select("c_custkey", *out)


@query("select count(*) as n, true as inside, true as again, true as spread from events")
def random_numbers(spark, d):
    """Random numbers lie in [0, 1), come again with the seed, and differ from each other."""
    one, two = Compiler({}), Compiler({})
    one.compile("srand(7)"), two.compile("srand(7)")
    r = model.table(spark, d, "events").select(one.compile("rand()").col.alias("a"), two.compile("rand()").col.alias("b"))
    inside = F.min((F.col("a") >= 0) & (F.col("a") < 1))
    return r.agg(F.count("*").alias("n"), inside.alias("inside"), F.min(F.col("a") == F.col("b")).alias("again"), (F.count_distinct("a") > F.count("*") * 0.9).alias("spread"))


@query("select event_id, round(2 * value + 3, 6) as y from events where value is not null and not isnan(value)")
def native_function(spark, d):
    """A function object of one's own; of two by one name the last counts."""
    twice = lambda v: Value(v.col * 2, "double")
    functions = {**{"sin": lambda v: v}, **{"sin": twice}}
    v = compile_expression("sin(x) + 3", {"x": (F.col("value"), "double")}, functions)
    return _events(spark, d).select("event_id", F.round(v.col, 6).alias("y"))


@query("select c_custkey, split_part(c_name, '#', 1) as a, split_part(c_name, '#', 2) as b, 'z' as c, cast(3 as bigint) as n from customer")
def text_split(spark, d):
    """A text split with defaults for what is missing."""
    p = split_by(F.col("c_name"), "#", ["x", "y", "z"])
    return model.table(spark, d, "customer").select("c_custkey", p[0].alias("a"), p[1].alias("b"), p[2].alias("c"), F.size(p).cast("long").alias("n"))


# ---- names and sensors

_RACK = {
    "options": {"output_delimiter": "/"},
    "sensor_table": {
        "setup": {
            "id": {"name": "LAB", "label": "Laboratory"}, "x-site": "north",
            "crate": {
                "id": {"name": "Rack", "label": "Crate"}, "array_length": 12, "x_site": "south",
                "channel": [{"id": {"name": "V", "label": "Voltage"}}, {"id": {"name": "A"}, "default_calibration": "V: V/10", "x-unit": "A"}],
            },
            "section": [
                {"id": {"name": "Old"}, "valid_if": "date < 20200101", "channel": {"id": {"name": "V"}}},
                {"id": {"name": "New"}, "valid_if": "date >= 20200101 && version == 1", "channel": {"id": {"name": "V"}}},
                {"id": {"name": "Odd"}, "valid_if": "date >= 2O20", "endpoint": {"id": {"name": "V"}}, "metric": {"id": {"name": "M"}}},
            ],
        }
    },
}


def _rack(spark: SparkSession, names: list[str] | None = None, base: list[str] | None = None) -> App:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        s = None if names is None else Source(Source.empty(spark).readings, spark.createDataFrame([(n,) for n in names], "endpoint_name string"))
        return App(spark, s, tree=_RACK, variables={"date": 20210105}, base=base)


@query(
    """with r as (
      select 3 + 2 * j as o, 'V.Rack' || lpad(cast(j as varchar), 2, '0') || '.LAB' as name, 'Voltage, Crate' || lpad(cast(j as varchar), 2, '0') || ', Laboratory' as label, '' as calibration, 'site=south' as options from range(12) t(j)
      union all select 4 + 2 * j, 'A.Rack' || lpad(cast(j as varchar), 2, '0') || '.LAB', 'A, Crate' || lpad(cast(j as varchar), 2, '0') || ', Laboratory', 'V: V/10', 'site=south,unit=A' from range(12) t(j)
      union all select 0, 'V.New.LAB', 'V, New, Laboratory', '', 'site=north' union all select 1, 'V.Odd.LAB', 'V, Odd, Laboratory', '', 'site=north' union all select 2, 'M.Odd.LAB', 'M, Odd, Laboratory', '', 'site=north')
    select cast(268435456 + o as integer) as number, name, label, calibration, options from r"""
)
def sensor_table_rows(spark, d):
    """The sensor table of a configuration with an array, inherited options, conditions and a broken one."""
    s = _rack(spark).sensors()
    options = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda o: F.concat_ws("=", o["key"], o["value"])), ",")
    return s.select("number", F.array_join("name", ".").alias("name"), F.array_join("label", ", ").alias("label"), "calibration", options.alias("options"))


@query(
    "select cast(268435456 + 3 + 2 * j as integer) as number, 'V/Rack' || lpad(cast(j as varchar), 2, '0') || '/LAB' as name, 'Voltage, Crate' || lpad(cast(j as varchar), 2, '0') || ', Laboratory' as label, '{\"site\":\"south\"}' as options from range(12) t(j)"
)
def sensor_json(spark, d):
    """Sensors like a name, as JSON of chosen fields, taken apart again."""
    a = _rack(spark)
    found = [s.number for s in a.find_like("V") if s.name[1].startswith("Rack")]
    j = a.sensors().where(F.col("number").isin(found)).select(render.sensor_json(["number", "name", "label", "options"], a.output_delimiter).alias("j"))
    j = j.select(F.from_json("j", "number int, name string, label string, options map<string,string>").alias("j"))
    return j.select("j.number", "j.name", "j.label", F.to_json("j.options").alias("options"))


@query(
    _values(
        [("split", "a,b-c"), ("split_low", "a,b"), ("join", "a.c"), ("like", "true"), ("unlike", "false"), ("exact", "V.New.LAB"), ("absent", "false"), ("one", "M.Odd.LAB"), ("none", "no sensor is like q"), ("many", "more than one sensor is like V"),
         ("union", "V.New.LAB,V.Odd.LAB,M.Odd.LAB"), ("resolved", "M=268435458,nothing=0,New.V=0"), ("all", "27")],
        "operation, result",
    )
)
def sensor_names(spark, d):
    """Splitting, joining, matching and looking up names."""
    a = _rack(spark)
    t = a.table
    join = lambda s: ".".join(s)

    def only(name: str) -> str:
        try:
            return join(t.find_one_like([name]).name)
        except LookupError as e:
            return str(e)

    rows = [
        ("split", ",".join(sensors.split_name("a.b-c"))), ("split_low", ",".join(sensors.split_name("a_b"))), ("join", sensors.join_name(["a", "", "c"])),
        ("like", str(sensors.is_like(["a", "b", "c"], ["a", "c"])).lower()), ("unlike", str(sensors.is_like(["a", "b"], ["b", "a"])).lower()),
        ("exact", join(t[["V", "New", "LAB"]].name)), ("absent", str(bool(t[["V", "Old", "LAB"]])).lower()), ("one", only("M")), ("none", only("q")), ("many", only("V")),
        ("union", ",".join(join(s.name) for s in a.find_like("Odd", "V.New", "M"))), ("resolved", ",".join(f"{n}={k}" for n, k in a.resolve(["M", "nothing", "New.V"]))), ("all", str(len(a.find_like()))),
    ]
    return spark.createDataFrame(rows, "operation string, result string")


@query(_values([("V_New", "V.New.LAB"), ("M", "M.Odd.LAB"), ("fresh_one", "fresh.one.LAB"), ("V_Rack03", "V.Rack03.LAB")], "endpoint, sensor"))
def sensor_binding(spark, d):
    """Data names bound to sensors: the only one like them, else a new one; a name like several is left out."""
    a = _rack(spark, ["V_New", "M", "fresh_one", "V_Rack03", "V"], ["LAB"])
    return spark.createDataFrame([(e, ".".join(a.table[n].name)) for n, e in a.table.endpoints().items()], "endpoint string, sensor string")


@query(f"select n as name, event_id as i, case when n = 'open' then round(1000 / value, 6) end as x from events, (values ('probed'), ('open')) as t(n) where event_type = 'click' and {_SPAN}")
def calib_probe(spark, d):
    """A calibration that can't be evaluated at 0 gives no value, unless the probe is lifted; a lost input leaves only its own series empty."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        a, b = (app(spark, d).read(["inverse", "lost"], START, STOP, strict_probe=p) for p in (True, False))
    return a.withColumn("name", F.lit("probed")).union(b.withColumn("name", F.lit("open"))).select("name", "i", F.round("x", 6).alias("x"))


# ---- series and frames


@query("select event_type as name, event_id as i, round(2 * value, 6) as x from events where event_type is not null and value > 10 and event_id % 7 <> 0")
def series_transform(spark, d):
    """Whole-series functions one after another; keeping missing values and cloning change nothing."""
    s = gappy(spark, d)
    return s.transform(S.keepna).transform(S.dropna).transform(lambda x: S.keep(x, lambda v: v > 10)).transform(S.apply, lambda v: 2 * v).select("name", "i", F.round("x", 6).alias("x"))


_OWN = f"""s as (select event_type as name, event_id as i, epoch_us(ts) / 1000000 as t, value as x from events where event_type is not null),
  m as (select {{a}} as a, {{b}} as b from s), w as (select b - ceil((b - a) / {STEP}) * {STEP} as f, b from m), n as (select f, cast(ceil((b - f - {STEP / 2}) / {STEP}) as bigint) as n from w),
  k as (select name, cast(floor((t - f) / {STEP}) as bigint) as k, max(x) as x from s, n group by 1, 2)
  select c.name, c.k, round(c.t, 3) as t, k.x from (select name, unnest(range(n)) as k, f + (unnest(range(n)) + 0.5) * {STEP} as t from (select distinct name from s), n) c left join k using (name, k)"""


@query("with " + _OWN.format(a="min(t)", b="max(t)"))
def resample_own_span(spark, d):
    """Buckets over the span of the points themselves."""
    s = series(spark, d)
    return resample.resample(s, resample.Grid.of_series(s, STEP), "max").select("name", "k", F.round("t", 3).alias("t"), "x")


@query("with " + _OWN.format(a=START + 86_400, b="max(t)"))
def resample_bounds(spark, d):
    """Buckets from a given start to the last point."""
    s = series(spark, d)
    return resample.resample(s, resample.Grid.of_series(s, STEP, START + 86_400, 0.0), "max").select("name", "k", F.round("t", 3).alias("t"), "x")


def _frame(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    return resample.frame(gappy(spark, d), resample.Grid.by_time(START, STOP, STEP), TYPES, "max", columns=columns)


_WIDE = f"""g as (select event_type as name, {_FIRST} + (floor((epoch_us(ts) / 1000000 - {_FIRST}) / {STEP}) + 0.5) * {STEP} as t, case when event_id % 7 <> 0 then value end as x from events where event_type is not null),
  f as (select cast({_FIRST} + (k + 0.5) * {STEP} as double) as t from range(120) r(k)),
  w as (select f.t, {", ".join(f"max(x) filter (name = '{n}') as {n}" for n in TYPES)} from f left join g using (t) group by f.t)"""
_WHEN = "strftime(make_timestamp(cast(t as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S')"


@query(f"with {_WIDE} select t, " + ", ".join(f'{n} as "Column{i:03d}"' for i, n in enumerate(TYPES)) + " from w")
def frame_list(spark, d):
    """A frame of series without names: its columns are numbered."""
    return _frame(spark, d, resample.numbered_columns(len(TYPES)))


@query(f"with {_WIDE} select '{','.join(['t', *TYPES])}' as columns, true as has_click, false as has_none, count(*) as rows, (select view from w order by t limit 1 offset 3) as fourth, round(sum(click), 6) as total from w")
def frame_views(spark, d):
    """Column names, a row by its number and a column of a frame."""
    f = _frame(spark, d)
    fourth = F.try_element_at(F.array_sort(F.collect_list(F.struct("t", "view"))), F.lit(4))["view"]  # the frame has 120 rows
    whole = f.agg(F.count("*").alias("rows"), F.round(F.sum("click"), 6).alias("total"), fourth.alias("fourth"))
    return whole.select(F.lit(",".join(f.columns)).alias("columns"), F.lit("click" in f.columns).alias("has_click"), F.lit("none" in f.columns).alias("has_none"), "rows", "fourth", "total")


@query(f"with {_WIDE} select {_WHEN} as \"DateTime\", round(t, 1) as \"TimeStamp\", {', '.join(TYPES)} from w")
def render_frame(spark, d):
    """A frame with its two time columns, as written to CSV."""
    return render.frame_csv(_frame(spark, d))


@query(
    f"with b as (select {_FIRST} + (floor((epoch_us(ts) / 1000000 - {_FIRST}) / {STEP}) + 0.5) * {STEP} as t, min(value) as lo, max(value) as hi from events where event_type = 'click' and {_SPAN} group by 1)"
    f" select t, round(hi, 6) as click, round(2.5 * hi - 7, 6) as linear, round(100 - lo, 6) as falling from (select cast({_FIRST} + (k + 0.5) * {STEP} as double) as t from range(120) r(k)) left join b using (t)"
)
def frame_extremes(spark, d):
    """Largest values in buckets, reduced before the linear calibrations."""
    f = app(spark, d).frame(["click", "linear", "falling"], START, STOP, STEP, "max")
    return f.select("t", *(F.round(n, 6).alias(n) for n in ("click", "linear", "falling")))


_SHOWN = {"csv": "coalesce(printf('%.6g', {0}), 'nan')", "json": "coalesce(printf('%.6g', {0}), 'null')"}


@query(
    f"with {_WIDE} select 'csv' as format, cast(row_number() over (order by t) as integer) as no, {_WHEN} || ',' || cast(cast(t as bigint) as varchar) || ',' || " + " || ',' || ".join(_SHOWN["csv"].format(n) for n in TYPES) + " as line from w"
    f" union all select 'csv', 0, 'DateTime,TimeStamp,{','.join(TYPES)}'"
    f" union all select 'json', cast(row_number() over (order by t) as integer), {_WHEN} || ',' || cast(cast(t as bigint) as varchar) || ',' || " + " || ',' || ".join(_SHOWN["json"].format(n) for n in TYPES) + " from w"
    f" union all select 'json', 0, 'DateTime,TimeStamp,{','.join(TYPES)}'"
)
def render_frame_text(spark, d):
    """A small frame as lines of CSV and as JSON, numbers to six significant digits."""
    f = _frame(spark, d)
    rows = [("csv", i, x) for i, x in enumerate(render.frame_lines(f))]
    j = trees.parse_json(render.frame_json(f))
    shown = [j["columns"], *([r[0], str(int(r[1])), *("null" if x is None else f"{x:.6g}" for x in r[2:])] for r in j["table"])]
    rows += [("json", i, ",".join(x)) for i, x in enumerate(shown)]
    return spark.createDataFrame(rows, "format string, no int, line string")


# ---- command line


def _command(spark: SparkSession, *arguments: str, text: str = "") -> list[str]:
    out, before = io.StringIO(), sys.stdin
    sys.stdin = io.StringIO(text)
    try:
        with warnings.catch_warnings(), contextlib.redirect_stderr(io.StringIO()):
            warnings.simplefilter("ignore")
            cli.main([*arguments], spark, out)
    finally:
        sys.stdin = before
    return out.getvalue().splitlines()


_CONFIG = """# sensor_table:
#   setup:
#     id: { name: LYRA }
#     channel:
#       id: { name: trap, label: Cold trap }
#       x-dripline_endpoint: degC_Pt0_Trap_Cryo
#     channel:
#       id: { name: warm }
#       default_calibration: trap: trap + 100
"""
_WEEK = ("--from", "2021-01-01T00:00:00", "--to", "2021-01-21T00:00:00")
_TRAP = "endpoint_name = 'degC_Pt0_Trap_Cryo' and \"timestamp\" >= timestamp '2021-01-01' and \"timestamp\" < timestamp '2021-01-21'"


@query(_values([(0, '{"number": 268435456, "name": "trap.LYRA", "label": "Cold trap, LYRA"}'), (1, '{"number": 268435457, "name": "warm.LYRA", "label": "warm, LYRA"}')], "no, line"))
def cli_list(spark, d):
    lines = _command(spark, "list", "trap", "warm", "--config", "./-.ktf", text=_CONFIG)
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "no int, line string")


@query(
    f"with r as (select case when isnan(value_raw) then null else value_raw end as x from numeric_data where {_TRAP}), s as (select 'trap' as name, x from r union all select 'warm', x + 100 from r)"
    " select name, count(x) as n, printf('%.8e', min(x)) as least, printf('%.8e', max(x)) as most from s group by 1"
)
def cli_summary(spark, d):
    """``get --summary`` of a sensor and one derived from it, read from its lines."""
    lines = _command(spark, "get", "trap", "warm", "--config", "./-.ktf", "--data", f"{d}/numeric_data.parquet", "--names", f"{d}/endpoint_id_map.parquet", "--summary", "n,min,max", *_WEEK, text=_CONFIG)
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(F.from_json("line", "name string, n long, min double, max double").alias("j"))
    return rows.select("j.name", "j.n", F.format_string("%.8e", "j.min").alias("least"), F.format_string("%.8e", "j.max").alias("most"))


@query(
    f"with r as (select floor((epoch_us(\"timestamp\") / 1000000 - 1609459200) / 86400) as k, max(case when isnan(value_raw) then null else value_raw end) as x from numeric_data where {_TRAP} group by 1)"
    " select 'DateTime,TimeStamp,trap,warm' as line union all select strftime(make_timestamp(cast(1609459200 + (k + 0.5) * 86400 as bigint) * 1000000), '%Y-%m-%dT%H:%M:%S') || ',' || cast(1609459200 + cast((k + 0.5) * 86400 as bigint) as varchar) || ','"
    " || coalesce(printf('%.6g', x), 'nan') || ',' || coalesce(printf('%.6g', x + 100), 'nan') from range(20) t(k) left join r using (k)"
)
def cli_get(spark, d):
    """``get`` of an aligned frame of days, line by line."""
    lines = _command(spark, "get", "trap", "warm", "--config", "./-.ktf", "--data", f"{d}/numeric_data.parquet", "--names", f"{d}/endpoint_id_map.parquet", "--interval", "86400", "--reducer", "max", *_WEEK, text=_CONFIG)
    return spark.createDataFrame([(x,) for x in lines], "line string")


_DUMPED = [
    ("ktf", '# a: 1\n# b:\n#   c: "x"\n'.replace('"', "")), ("json", '{\n  "a": 1,\n  "b": {\n    "c": "x"\n  }\n}'), ("yaml", "a: 1\nb:\n  c: x"), ("ini", "a = 1;\nb.c = x;"), ("xpvp", "a: 1\nb/c: x"),
    ("xml", '<?xml version="1.0" encoding="UTF-8"?>\n<tree>\n  <a>1</a>\n  <b>\n    <c>x</c>\n  </b>\n</tree>'), ("c", 'static const char text[] =\n    "# a: 1\\n"\n    "# b:\\n"\n    "#   c: x\\n";'),
]


@query(_values([(f, i, line) for f, text in _DUMPED for i, line in enumerate(text.rstrip("\n").split("\n"))], "format, no, line"))
def cli_dump(spark, d):
    """A tree file in other formats, and as text to be compiled into a program."""
    rows = [(f, i, x) for f, _ in _DUMPED for i, x in enumerate(_command(spark, "dump", "./-.ktf", "--to", f, text="# a: 1\n# b:\n#   c: x\n"))]
    return spark.createDataFrame(rows, "format string, no int, line string")


@query(_values([("last minute", 40.0, 100.0), ("length", 1609804800.0, 1609804805.0), ("digits", 5.0, 9.0), ("now", 940.0, 1000.0), ("both", 1609804800.0, 1609891200.0)], "name, start, stop"))
def cli_times(spark, d):
    """Spans from the time options."""
    given = {
        "last minute": ["--to-ts", "100"], "length": ["--from", "2021-01-05T00:00:00", "--length", "5"], "digits": ["--from", "5", "--to", "9"], "now": [],
        "both": ["--from", "2021-01-05T00:00:00", "--to", "2021-01-06T00:00:00Z"],
    }
    return spark.createDataFrame([(n, *cli.time_range(cli.parser().parse_args(["get", "x", *a]), now=1000.0)) for n, a in given.items()], "name string, start double, stop double")


@query(_values([("wrong arity", True), ("unknown name", True), ("word", True), ("bad step", True), ("no filler", True), ("no reducer", True), ("no column", True)], "what, raises"))
def errors(spark, d):
    """What has to be an error is one."""

    def fails(f) -> bool:
        try:
            f()
        except (ValueError, LookupError):
            return True
        return False

    s = series(spark, d)
    tried = {
        "wrong arity": lambda: compile_expression("sin(1, 2)", {}), "unknown name": lambda: compile_expression("q + 1", {}), "word": lambda: compile_expression("'a' * 2", {}),
        "bad step": lambda: resample.Grid.by_time(0, 1, 0), "no filler": lambda: resample.resample(s, resample.Grid.by_time(0, 1, 1), "mean", "nothing"), "no reducer": lambda: S.reducer("nothing"),
        "no column": lambda: tables.name_column(spark.range(1)),
    }
    return spark.createDataFrame([(n, fails(f)) for n, f in tried.items()], "what string, raises boolean")

