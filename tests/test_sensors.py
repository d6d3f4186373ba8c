import io
import json
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tidegauge import cli, sensors
from tidegauge.operators import resample
from tidegauge.plans.app import App
from tidegauge.sources import render, tables, trees

CONFIG = """
# options:
#   output_delimiter: .
# sensor_table:
#   setup:
#     id: { name: LAB, label: Laboratory }
#     section:
#       id: { name: Gas, label: Gas handling }
#       module:
#         id: { name: RTD, label: Thermometer }
#         array_length: 10
#         x-crate: 7
#         channel:
#           id: { name: ohm, label: Resistance }
#         channel:
#           id: { name: K, label: Temperature }
#           default_calibration: ohm:pt100(ohm)
#         channel:
#           id: { name: degC, label: Temperature in Celsius }
#           default_calibration: K:K-273.15
#       module:
#         id: { name: Flow, label: Flow meter }
#         valid_if: date >= 20210101 && version >= 1
#         channel:
#           id: { name: sccm, label: Flow }
#           x-dripline_endpoint: flow_1
#         channel:
#           id: { name: sq, label: Square }
#           default_calibration: sccm: sccm*sccm
#     section:
#       id: { name: Old, label: Gone }
#       valid_if: date < 20200101
#       channel: { id: { name: V } }
#     section:
#       id: { name: Odd, label: Kept in spite of a broken condition }
#       valid_if: date >= 2O21
#       channel: { id: { name: V } }
"""


@pytest.fixture
def table():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return sensors.SensorTable().load_tree(trees.parse_ktf(CONFIG), {"version": 1, "date": 20210105})


def test_table(table):
    assert len(table.sensors) == 33
    assert min(table.sensors) == sensors.FIRST_NUMBER
    s = table[["ohm", "RTD3", "Gas", "LAB"]]
    assert s.options == {"crate": "7"} and s.label[1] == "Thermometer3"
    assert not table[["V", "Old", "LAB"]] and table[["V", "Odd", "LAB"]]
    assert len(table.find_like(["K"])) == 10 and len(table.find_like([])) == 33
    assert table.find_one_like(["K", "RTD0"]).name == ["K", "RTD0", "Gas", "LAB"]
    with pytest.raises(LookupError):
        table.find_one_like(["K"])


def test_names():
    assert sensors.split_name("a.b-c") == ["a", "b-c"] and sensors.split_name("a_b") == ["a", "b"] and sensors.split_name("") == []
    assert sensors.indexed("x", 100, 3) == "x03" and sensors.indexed("x", 10, 3) == "x3" and sensors.indexed("x", 1, 0) == "x0" and sensors.indexed("x", 101, 3) == "x003" and sensors.indexed("x", -1, 0) == "x"
    assert sensors.is_like(["a", "b", "c"], ["a", "c"]) and not sensors.is_like(["a", "b"], ["b", "a"])


def test_like_column(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["c", "a"],), ([],), (["a", None, "c"],)], "n array<string>")
    assert [r[0] for r in df.select(sensors.like_column(F.col("n"), ["a", "c"])).collect()] == [True, False, False, True]


def test_calibrations(table):
    degree = table[["degC", "RTD1", "Gas", "LAB"]]
    root, steps = sensors.chain_of(degree.number, table)
    assert table[root].name == ["ohm", "RTD1", "Gas", "LAB"] and [s.identity for s in steps] == [False, False]
    loop = sensors.SensorTable()
    loop.add(sensors.Sensor(1, ["a", "s"], calibration="b: b"))
    loop.add(sensors.Sensor(2, ["b", "s"], calibration="a: a"))
    with pytest.raises(LookupError):
        sensors.chain_of(1, loop)
    bad = sensors.SensorTable()
    bad.add(sensors.Sensor(1, ["v", "s"]))
    bad.add(sensors.Sensor(2, ["w", "s"], calibration="v: 1/v"))
    bad.add(sensors.Sensor(3, ["z", "s"], calibration="q: q"))
    with pytest.warns(UserWarning):
        assert sensors.chain_of(2, bad)[1][0].node is None  # can't be evaluated at 0
    assert sensors.chain_of(2, bad, strict_probe=False)[1][0].node is not None
    with pytest.raises(LookupError):
        sensors.chain_of(3, bad)


def test_binding(table):
    with pytest.warns(UserWarning):
        table.load_names(["flow_1", "ohm_RTD4", "K_Gas", "new_thing"], ["LAB"])
    ends = {v: sensors.join_name(table[k].name) for k, v in table.endpoints().items()}
    assert ends == {"flow_1": "sccm.Flow.Gas.LAB", "ohm_RTD4": "ohm.RTD4.Gas.LAB", "new_thing": "new.thing.LAB"}


@pytest.fixture
def data(spark, tmp_path, readings):
    rows = [(k, n, float(k), v) for k in range(60) for n, v in (("flow_1", float(k)), ("ohm_RTD2", 20.0))]
    path = str(tmp_path / "numeric_data.parquet")
    readings(rows + [(99, "flow_1", 5.5, float("nan"))]).coalesce(1).write.parquet(path)
    config = tmp_path / "conf"
    config.mkdir()
    (config / "a.ktf").write_text(CONFIG)
    return path, str(config)


START = 1609804800.0


@pytest.mark.filterwarnings("ignore")
def test_app(spark, data):
    app = App(spark, tables.Source.parquet(spark, data[0]), data[1], variables={"date": 20210105}, base=["LAB"])
    long = app.read(["sccm.Flow", "sq.Flow", "degC.RTD2", "nothing.like.it"], START, START + 30)
    got = {r["name"]: r["n"] for r in long.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert got == {"sccm.Flow": 31, "sq.Flow": 31, "degC.RTD2": 30}
    top = long.groupBy("name").agg(F.max("x").alias("m")).collect()
    assert {r["name"]: r["m"] for r in top}["sq.Flow"] == 29.0**2
    frame = app.frame(["sccm.Flow", "degC"], START, START + 30, 10, "mean")
    assert frame.columns[:2] == ["t", "sccm.Flow"] and len(frame.columns) == 12
    assert [r[1] for r in frame.orderBy("t").collect()] == [4.5, 14.5, 24.5]
    assert app.frame(["sccm.Flow"], START, START + 30).count() == 30
    assert app.sensors().count() == len(app.table.sensors)
    assert app.read(["nothing"], START, START + 5).count() == 0
    assert json.loads(app.sensors().select(render.sensor_json(["number", "name"])).first()[0])["number"] == sensors.FIRST_NUMBER


@pytest.mark.filterwarnings("ignore")
def test_command_line(spark, data):
    def run(*args):
        out = io.StringIO()
        assert cli.main([*args], spark, out) == 0
        return out.getvalue().splitlines()

    common = ["--config", data[1], "--data", data[0], "--basename", "LAB", "--date", "20210105"]
    span = ["--from", "2021-01-05T00:00:00", "--length", "30"]
    assert json.loads(run("list", "sccm", *common)[0])["name"] == "sccm.Flow.Gas.LAB"
    lines = run("get", "sccm.Flow", "sq.Flow", "--interval", "10", "--reducer", "mean", *common, *span)
    assert lines[0] == "DateTime,TimeStamp,sccm.Flow,sq.Flow" and lines[1] == "2021-01-05T00:00:05,1609804805,4.5,28.5"
    assert json.loads(run("get", "sccm.Flow", "--summary", *common, *span)[0]) == {"name": "sccm.Flow", "n": 30, "mean": 14.5, "std": pytest.approx(8.8034)}
    assert len(run("get", "sccm.Flow", "--series", *common, *span)) == 32
    assert json.loads(run("get", "sccm.Flow", "--series", "--json", *common, *span)[0])["sccm.Flow"]["t"][:2] == [0.0, 1.0]
    assert json.loads("".join(run("get", "sccm.Flow", "--json", "--interval", "10", *common, *span)))["columns"][2] == "sccm.Flow"


def test_time_range():
    a = cli.parser().parse_args(["get", "x", "--to-ts", "100"])
    assert cli.time_range(a) == (40.0, 100.0)
    a = cli.parser().parse_args(["get", "x", "--from", "2021-01-05T00:00:00", "--length", "5"])
    assert cli.time_range(a) == (START, START + 5)


def test_empty_source(spark):
    app = App(spark, tables.Source.empty(spark), tree={"sensor_table": {"channel": {"id": {"name": "a"}}}})
    assert app.read(["a"], 0, 10).count() == 0 and app.source.names() == []


@pytest.mark.parametrize("text, suffix", [("a: [1, 2]\nb: x", ".xpvp"), ('{"a": {"b": [1, 2.5, "x y", null, true]}}', ".json"), ("[s]\nk = 1", ".ini")])
def test_trees_round_trip(tmp_path, text, suffix):
    p = tmp_path / f"t{suffix}"
    p.write_text(text)
    t = trees.load_tree(str(p))
    for kind in (".json", ".ktf", ".yaml", ".xml", ".plist", ".ini", ".xpvp"):
        trees.save_tree(t, str(tmp_path / f"out{kind}"))
        assert (tmp_path / f"out{kind}").read_text()
    assert trees.load_tree(str(tmp_path / "out.json")) == t
    assert trees.load_tree(str(tmp_path / "out.ktf")) == t


def test_tree_parsers():
    t = trees.parse_json("{a: one two, 'b': [1 2, nan], c: 0x10, /* note */ c: 2,}")
    assert t["a"] == "one two" and t["b"][0] == "1 2" and t["c"] == [16, 2]
    with pytest.raises(trees.TreeError):
        trees.parse_json("{a: 1")
    with pytest.raises(trees.TreeError):
        trees.load_tree("x.foo")
    t = trees.parse_ktf("# a: first\n#  : second\n# l:\n#   - 1\n#   - x\n# e:\n# m: {k: v}\n1 2 3\n")
    assert t == {"a": "first\nsecond", "l": [1, "x"], "e": None, "m": {"k": "v"}}
    assert trees.get_path(t, "m/k") == "v" and trees.get_path(t, "l[1]") == "x" and trees.get_path(t, "q/r", 5) == 5
    assert dict(trees.walk({"a": {"@b": 1, "c": [2, 3]}})) == {"a@b": 1, "a/c[0]": 2, "a/c[1]": 3}


def test_text_tables(spark, tmp_path):
    text = "# Fields: id x name\n# FieldTypes: int float string\n\n1 2.5 'a b'\r\n2 \"\" c\r\n\r\n3 4e1 d\\ e\n"
    t = tables.TextTable(text)
    assert t.rows == [[1, 2.5, "a b"], [2, None, "c"], [3, 40.0, "d e"]] and t.segments == [0, 0, 1]
    df = t.dataframe(spark)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "name": "string", "segment": "int"}
    again = tables.TextTable(tables.to_text(df.drop("segment").orderBy("id")))
    assert again.rows == t.rows
    c = tables.TextTable("a,b\n1,x\n2,\n", ".csv")
    assert c.columns == ["a", "b"] and c.rows == [[1.0, "x"], [2.0, None]]
    assert tables.leaf_descriptor("n[2]/I:x:y/D") == [("n0", "int"), ("n1", "int"), ("x", "float"), ("y", "double")]
    assert tables.TextTable("").rows == []
    assert tables.TextTable("1 2\n3 4\n").columns == ["Column000", "Column001"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_text_tables_in_blocks(spark, tmp_path, end):
    """A file cut into many blocks gives the rows, types and segments of the whole text."""
    rng = random.Random(4)
    lines = ["# Fields: id x", "# FieldTypes: long", "# note: none", ""]
    for k in range(400):
        lines += [f"{k} {rng.uniform(-1, 1):.3f} 'a {k}' {rng.choice(['7', '', 'z'])}".rstrip()] + [""] * rng.choice([0, 0, 0, 1, 3]) + ["# aside"] * rng.choice([0, 0, 1])
    for name, text in (("a.ktf", end.join(lines) + end), ("b.ktf", end.join(lines)), ("c.csv", end.join(["a,b", *(f"{k},{k / 4}" for k in range(100)), "", "7,"])), ("d.ktf", "n[2]/I:x/D\n1 2 3.5\n\n4 5 6\n"), ("e.ktf", ""), ("f.ktf", "# Fields: a b\n")):
        p = tmp_path / name
        p.write_bytes(text.encode())
        whole = tables.TextTable(text, p.suffix)
        for size in ("64b", "1000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = tables.read_table(spark, str(p))
            assert df.columns == [*whole.columns, "segment"] and [f.dataType for f in df.schema][:-1] == whole.types, name
            got = sorted((tuple(r) for r in df.collect()), key=str)
            assert got == sorted((tuple([*r, s]) for r, s in zip(whole.rows, whole.segments)), key=str), (name, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("suffix", [".ktf", ".csv"])
def test_written_tables_come_back(spark, tmp_path, suffix):
    rows = [(k, k / 7, f"a \"{k}\" \\ #" if k % 3 else "plain", None if k % 5 else k) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, x double, s string, n long")
    tables.write_table(df.repartition(3), str(tmp_path / f"out{suffix}"), suffix)
    back = tables.read_table(spark, str(tmp_path / f"out{suffix}"))
    got = sorted((int(r["id"]), r["x"], r["s"], None if r["n"] is None else int(r["n"])) for r in back.collect())
    assert got == [(k, pytest.approx(x, rel=1e-8), s, n) for k, x, s, n in rows]


def test_database(spark, tmp_path):
    """Readings in an embedded database, read by several queries at once."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(k, "a" if k % 3 else "b", k / 2) for k in range(200)]
    df = spark.createDataFrame(rows, "reading_id long, endpoint_name string, value_raw double")
    df = df.withColumn("timestamp", F.expr("timestamp_ntz '2021-01-05 00:00:00' + make_dt_interval(0, 0, 0, reading_id)"))
    df.write.format("jdbc").options(url=url, dbtable="readings", createTableColumnTypes="endpoint_name varchar(40)").save()
    for more in ({}, {"partitions": 4}, {"partitions": 3, "span": ("2021-01-05 00:00:50", "2021-01-05 00:01:40")}):
        s = tables.Source.jdbc(spark, url, "readings", **more)
        assert s.readings.rdd.getNumPartitions() == more.get("partitions", 1)
        assert s.names() == ["a", "b"]
        got = s.range(["a"], START + 10, START + 110)
        assert sorted(r["x"] for r in got.collect()) == [v for k, n, v in rows if n == "a" and 10 <= k < 110]
    assert tables.Source.jdbc(spark, url, "(select * from readings where 1 = 0) e", partitions=4).readings.count() == 0


def test_schema_probe(spark, tmp_path, readings):
    readings([(1, "a", 0.0, 1.0)]).write.parquet(str(tmp_path / "numeric_data.parquet"))
    spark.createDataFrame([(1, "a"), (2, "b")], "endpoint_id int, endpoint_name string").write.parquet(str(tmp_path / "endpoint_id_map.parquet"))
    found = {(r["table_name"], r["column_name"]) for r in tables.probe(spark, str(tmp_path)).where("names").collect()}
    assert found == {("numeric_data", "endpoint_name"), ("endpoint_id_map", "endpoint_name")}
    assert tables.Source.directory(spark, str(tmp_path)).names() == ["a", "b"]
    with pytest.raises(ValueError):
        tables.Source.directory(spark, str(tmp_path), "nothing")
    with pytest.raises(ValueError):
        tables.Source.directory(spark, str(tmp_path)).names(1)


def test_extremes_before_calibration(spark, data):
    """Buckets reduced before linear calibrations, rising and falling, equal those reduced after them, to the last bit."""
    texts = {"up": "flow: 0.1*flow + 1/3.0", "down": "flow: (7 - flow*3)/-2.0*-1 - 0.7", "twice": "down: -down/3", "same": "flow"}
    tree = {"sensor_table": {"setup": {"id": {"name": "L"}, "channel": [{"id": {"name": "flow"}, "x-dripline_endpoint": "flow_1"}, *({"id": {"name": n}, "default_calibration": t} for n, t in texts.items())]}}}
    app = App(spark, tables.Source.parquet(spark, data[0]), tree=tree)
    grid = resample.Grid.by_time(START, START + 60, 7)
    for reducer in ("min", "max"):
        early = app.extremes([*texts, "flow", "nothing"], grid, START, START + 60, reducer)
        late = resample.into_buckets(app.read([*texts, "flow"], START, START + 60), grid).groupBy("name", "k").agg(resample.S.reducer(reducer).alias("x"))
        assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect())) != []
        frame = app.frame([*texts], START, START + 60, 7, reducer)
        assert frame.columns == ["t", *texts] and frame.count() == 9
    assert app.extremes(["up"], grid, START, START + 60, "mean") is None
    for text, want in (("2*x", 1), ("3 - x/2", -1), ("x*x", None), ("x + x", None), ("1/2*x", None), ("7", None), ("x/0", None), ("sin(x)", None), ("-(x - 1)*-4", 1), ("x % 2", None), ("2**2*x", 1), ("1/x", None)):
        c = sensors.Calibration(1, 2, False, sensors.X.parse(text))
        assert sensors.slope([c]) == want, text


def test_bad_sensors_stay_empty(spark, data):
    tree = {"sensor_table": {"setup": {"id": {"name": "L"}, "channel": [
        {"id": {"name": "flow"}, "x-dripline_endpoint": "flow_1"}, {"id": {"name": "lost"}, "default_calibration": "nowhere: nowhere"}, {"id": {"name": "loop"}, "default_calibration": "pool: pool"},
        {"id": {"name": "pool"}, "default_calibration": "loop: loop"}]}}}
    app = App(spark, tables.Source.parquet(spark, data[0]), tree=tree)
    with pytest.warns(UserWarning, match="no values"):
        got = app.read(["flow", "lost", "loop"], START, START + 10)
    assert {r["name"] for r in got.collect()} == {"flow"}
    with pytest.raises(LookupError):
        app.read(["flow", "lost"], START, START + 10, strict=True)


@pytest.mark.filterwarnings("ignore")
def test_configuration_by_environment(spark, data, monkeypatch):
    monkeypatch.setenv("TIDEGAUGE_CONFIG_PATH", data[1])
    assert len(App(spark, variables={"date": 20210105}).table.sensors) == 33
    monkeypatch.delenv("TIDEGAUGE_CONFIG_PATH")
    assert not App(spark).table.sensors


def test_tree_operations():
    t = trees.parse_ktf("# a: 1\n# b:\n#   c: x\n")
    node = trees.append(t, "b/d")
    node["e"] = 2
    trees.append(t, "b/d")["e"] = 3
    assert t["b"]["d"] == [{"e": 2}, {"e": 3}]
    trees.link(t, "other", node)
    node["e"] = 4
    assert t["other"]["e"] == t["b"]["d"][0]["e"] == 4
    assert trees.unlink(t["b"], node) == 1 and t["b"]["d"] == [{"e": 3}] and t["other"] is node
    trees.merge(t, {"a": 5, "z": {"y": 1}})
    assert t["a"] == [1, 5] and t["z"] == {"y": 1}
    trees.clear(t)
    assert t == {}
    assert trees.to_c('say "x"\n\\', "t") == 'static const char t[] =\n    "say \\"x\\"\\n"\n    "\\\\\\n";\n'


def test_visit_and_decode(tmp_path):
    from dataclasses import dataclass, field

    seen = []
    trees.visit({"a": {"b": 1, "c": 2}, "d": [3]}, lambda p, n: seen.append(p) or p != "a")
    assert seen == ["", "a", "d", "d[0]"]

    @dataclass
    class Channel:
        name: str
        gain: float = 1.0

    @dataclass
    class Board:
        id: int
        channel: list[Channel] = field(default_factory=list)

    # the classes are local: their hints are resolved by hand
    Board.__annotations__ = {"id": int, "channel": list[Channel]}
    assert trees.decode({"id": 3, "channel": {"name": "a", "other": 1}}, Board) == Board(3, [Channel("a")])
    p = tmp_path / "t.ktf"
    p.write_text("# a: 1\n# b:\n#   c: x\n")
    out = io.StringIO()
    assert cli.main(["dump", str(p), "--to", "json"], out=out) == 0 and json.loads(out.getvalue()) == {"a": 1, "b": {"c": "x"}}


def test_dump_table(spark, tmp_path):
    p = tmp_path / "t.ktf"
    p.write_text("# Fields: a b\n1 x\n2 y\n")
    out = io.StringIO()
    assert cli.main(["dump", str(p), "--to", "csv"], spark, out) == 0 and out.getvalue() == "a,b\n1,x\n2,y\n"
