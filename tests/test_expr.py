import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.columns import compile_expression
from tidegauge.functions.expr import ExpressionError, condition_holds, evaluate


@pytest.mark.parametrize(
    "text, value",
    [
        ("-1**2", -1.0), ("2**3**2", 512.0), ("7/2", 3), ("-7/2", -3), ("7/2.0", 3.5), ("7 % 4", 3), ("-7 % 4", -3), ("1|2^3&1", 3),
        ("{1,2,3}*2", [2, 4, 6]), ("{1,2}+{3,4}", [4, 6]), ("[0,5]", [0, 1, 2, 3, 4]), ("[0:5]", [0, 1, 2, 3, 4, 5]), ("[0:2:5]", [0, 2, 4]), ("[3,0]", [3, 2, 1]),
        ("{1,2,2}<&>{2,2}", [2, 2, 2, 2]), ("{1}<+>{2,3}", [1, 2, 3]), ("5!", 120), ("0!", 1), ("!(3>2)", False), ("'a'+1", "a1"), ("{1,2,3}[-1]", 3),
        ("{a}[1]", None), ("round(-2.5)", -3.0), ("trunc(-2.7)", -2.0), ("ceil(2.1)", 3.0), ("(int)3.7", 3), ("0x10 + 0b11", 19), ("sizeof {1,2}", 2), ("~5", -6), ("1 << 4 >> 2", 4),
        ("pi", 3.141592), ("abs(-3)", 3), ("atan2(1, 1)", math.pi / 4), ("sinc(0)", 1.0), ("'abc'[1]", "b"), ("{'a'=>1,'b'=>2}{'b'}", 2), ("typeof 1.5", "double"), ("true && !false", True),
    ],
)
def test_values(text, value):
    if value is None:
        with pytest.raises(ExpressionError):
            evaluate(text)
    else:
        assert evaluate(text) == value


@pytest.mark.parametrize("text", ["", "1 +", "2020O218", "1/0", "log(0)", "sqrt(-1)", "asin(2)", "1.5 % 2", "true + 1", "nothing", "f(1)", "{1,2}+{1}", "[0:0:5]", "(1", "1 2"])
def test_errors(text):
    with pytest.raises(ExpressionError):
        evaluate(text)


@pytest.mark.parametrize(
    "text, holds",
    [(None, True), ("", True), ("date >= 20210101", True), ("date>20210110", False), ("!(date < 20210101 || date >= 20210110)", True), ("date >= 2020O218", True), ("date >= 20210101 && version >= 2", False), ("unknown > 3", True), ("20210104 <= date", True), ("(date >= 20210101", True)],
)
def test_conditions(text, holds):
    assert condition_holds(text, {"version": 1, "date": 20210105}) is holds


_TEXTS = st.recursive(
    st.sampled_from(["x", "y", "2", "3", "1.5", "7"]),
    lambda e: st.one_of(
        st.tuples(e, st.sampled_from(["+", "-", "*", "/"]), e).map(lambda t: f"({t[0]} {t[1]} {t[2]})"),
        e.map(lambda t: f"(-{t})"),
        e.map(lambda t: f"abs({t})"),
        e.map(lambda t: f"sin({t})"),
        st.tuples(e, e).map(lambda t: f"(double)({t[0]} > {t[1]}) "),
    ),
    max_leaves=6,
)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(_TEXTS, min_size=1, max_size=8))
def test_columns_agree_with_the_evaluator(spark, texts):
    rows = [(1.0, 3), (-2.5, 0), (0.0, 7)]
    df = spark.createDataFrame(rows, "x double, y long")
    v = {"x": (F.col("x"), "double"), "y": (F.col("y"), "long")}
    got = df.select(*(compile_expression(t, v).col.cast("double").alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for r, (x, y) in zip(got, rows):
        for i, t in enumerate(texts):
            try:
                want = float(evaluate(t, {"x": x, "y": y}))
            except ExpressionError:
                want = None
            if want is None:
                assert r[i] is None or math.isnan(r[i]), t
            else:
                assert r[i] == pytest.approx(want, rel=1e-9, abs=1e-9), t


def test_strict_columns_raise(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    v = {"x": (F.col("x"), "double")}
    assert df.select(compile_expression("log(x)", v).col).first()[0] is None
    with pytest.raises(Exception, match="not positive"):
        df.select(compile_expression("log(x)", v, strict=True).col).collect()


def test_list_and_string_columns(spark):
    df = spark.createDataFrame([([1.0, 4.0, 2.0], "abc\n\n")], "a array<double>, s string")
    from tidegauge.functions.columns import Compiler, Value

    c = Compiler({"a": Value(F.col("a"), "list", "double"), "s": Value(F.col("s"), "string")})
    want = {
        "delta(a)": [3.0, -2.0], "sigma(a)": [0.0, 1.0, 5.0, 7.0], "find(a > 1)": [1, 2], "divide(a, 2)": [[1.0, 4.0], [2.0]], "a[{2,0}]": [2.0, 1.0], "zeros(2)": [0, 0], "ones(1)": [1],
        "chomp(s)": 2, "chomped(s)": "abc", "index(s, 'c')": 2, "substr(s, -2)": "\n\n", "substr(s, 0, -2)": "abc", "rms(a)": math.sqrt(7 - (7 / 3) ** 2), "a[5]": None, "keys({'k'=>1})": ["k"],
        "abs(complex(3.0, 4.0))": 5.0, "arg(-2.0)": math.pi, "real(complex(1.0,2.0) * complex(0.0,1.0))": -2.0, "[0.0:0.5:1.0]": [0.0, 0.5, 1.0], "[0,3]": [0, 1, 2],
    }
    got = df.select(*(c.compile(t).col.alias(f"c{i}") for i, t in enumerate(want))).first()
    for i, (t, w) in enumerate(want.items()):
        assert got[i] == (pytest.approx(w) if isinstance(w, float) else w), t


COMPLEX = ["2i * 2i", "abs(3 + 4i)", "real((1 + 2i)**2)", "imag((1+2i)**(0.5-1i))", "arg(-(1i))", "real(exp(1i))", "imag(sin(1+1i))", "real(cos(1i)) + 1", "real((3+1i)/(1-2i))", "(1i == 1i) && (1i != 2i)", "abs(0i**2)", "abs(2**1i)"]


def test_complex_numbers(spark):
    for text, row in zip(COMPLEX, spark.range(1).select(*(compile_expression(t, {}).col.alias(f"c{i}") for i, t in enumerate(COMPLEX))).first()):
        want = evaluate(text)
        if isinstance(want, complex):
            assert (row["re"], row["im"]) == pytest.approx((want.real, want.imag)), text
        else:
            assert row == pytest.approx(want, abs=1e-12), text
    assert evaluate("typeof 2i") == "complex" and evaluate("1.5I") == 1.5j
    with pytest.raises(ExpressionError):
        evaluate("1i > 2")
    with pytest.raises(ExpressionError):
        evaluate("2ix")


def test_split_with_defaults(spark):
    from tidegauge.functions.text import split_by

    df = spark.createDataFrame([("a.b",), (".b",), ("",), (None,), ("a..c.d.",)], "s string")
    assert [r[0] for r in df.select(split_by(F.col("s"), ".", ["x", "y", "z"])).collect()] == [["a", "b", "z"], ["x", "b", "z"], ["x", "y", "z"], ["x", "y", "z"], ["a", "y", "c", "d"]]
    assert [r[0] for r in df.select(split_by(F.col("s"), ".")).collect()] == [["a", "b"], [None, "b"], [], [], ["a", None, "c", "d"]]


def test_pt100_pieces_join():
    for edge in (8.0, 40.0):
        assert X.pt100(edge - 1e-9) == pytest.approx(X.pt100(edge), abs=0.2)


def test_formatter_and_scanner(spark):
    from tidegauge.functions.text import Formatter, Scanner

    df = spark.createDataFrame([(255, 1234.5678, "12 x 0x1F\nnext line"), (0, 1e-7, ""), (7, 0.0, None)], "n long, x double, s string")
    f = Formatter()
    line = f.setw(6).setfill("*").put(F.col("n"), "long").put("|").hex().put(F.col("n"), "long").put("|").put(F.col("x"), "double").put("|").scientific().setprecision(2).put(F.col("x"), "double").flush()
    assert [r[0] for r in df.select(line).collect()] == ["***255|ff|1234.57|1.23e+03", "*****0|0|1e-07|1.00e-07", "*****7|7|0|0.00e+00"]
    assert df.select(f.flush()).first()[0] == ""
    s = Scanner(F.col("s"))
    cols = [s.get("long"), s.get(), s.setbase(16).get("long"), s.get_line(), s.good(), s.get_line(), s.gcount()]
    got = df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).collect()
    assert tuple(got[0]) == (12, "x", 31, "", True, "next line", 0)
    assert tuple(got[1]) == (None, None, None, "", False, "", 0)


def test_macros_and_seeds(spark):
    from tidegauge.functions.columns import Compiler, Value, macro

    c = Compiler({"x": Value(F.lit(2.0), "double")}, {"sq": macro(["a"], "a*a")})
    df = spark.range(1)
    assert df.select(c.compile("sq(x + 1.0) + eval('2*x')").col).first()[0] == 13.0
    with pytest.raises(ExpressionError):
        c.compile("sq(1, 2)")
    c.compile("srand(5)")
    assert df.select(c.compile("rand()").col).first()[0] == df.select(F.rand(5)).first()[0]
