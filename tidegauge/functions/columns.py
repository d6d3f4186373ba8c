"""Expressions compiled to Spark columns: typed AST to ``Column``, evaluated JVM-side.

Where the driver evaluator raises (division by zero, logarithm of 0 and the like), ``strict`` columns raise for the row
and lenient ones, the default, give NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import expr as X
from tidegauge.functions.expr import ExpressionError

NUMERIC = ("long", "double", "void")


@dataclass(frozen=True)
class Value:
    """A column and its type: bool, long, double, string, void, complex (``col`` is then a struct re, im), list or map of ``item``."""

    col: Column
    type: str
    item: str | None = None


def _fail(message: str, kind: str = "double") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


class Compiler:
    """Compiles expressions over named columns.

    ``variables`` maps names to :class:`Value`; ``functions`` maps names to builders ``(Value...) -> Value``, which go before
    the built-in ones.
    """

    def __init__(self, variables: dict[str, Value], functions: dict[str, Callable[..., Value]] | None = None, strict: bool = False):
        self.variables, self.functions, self.strict, self.seed = variables, functions or {}, strict, None

    def compile(self, text: str | tuple) -> Value:
        return self.node(X.parse(text) if isinstance(text, str) else text)

    # ---- coercions

    def guard(self, ok: Column, col: Column, message: str) -> Column:
        """``col`` where ``ok``; elsewhere an error or NULL. NULL inputs stay NULL."""
        return F.when(ok, col).when(~ok, _fail(message)) if self.strict else F.when(ok, col)

    def double(self, v: Value, what: str) -> Column:
        if v.type in ("list", "map", "string", "complex"):
            raise ExpressionError(f"{what}: not a number")
        return F.lit(0.0) if v.type == "void" else v.col.cast("double")

    def number(self, v: Value, what: str) -> Value:
        if v.type == "void":
            return Value(F.lit(0).cast("long"), "long")
        if v.type not in ("long", "double", "complex"):
            raise ExpressionError(f"{what}: not a number: {v.type}")
        return v

    def long(self, v: Value, what: str) -> Column:
        v = self.number(v, what)
        if v.type == "complex":
            raise ExpressionError(f"{what}: complex number")
        if v.type == "long":
            return v.col
        return v.col.cast("long") if self.strict else v.col.try_cast("long")

    def bool(self, v: Value, what: str) -> Column:
        if v.type == "bool":
            return v.col
        if v.type in ("list", "map", "string"):
            raise ExpressionError(f"{what}: not a condition")
        return self.number(v, what).col != 0

    def text(self, v: Value) -> Column:
        return F.lit("") if v.type == "void" else v.col.cast("string")

    # ---- nodes

    def node(self, n: tuple) -> Value:
        return getattr(self, "_" + n[0])(*n[1:])

    def _lit(self, v: object) -> Value:
        if isinstance(v, bool):
            return Value(F.lit(v), "bool")
        if isinstance(v, int):
            return Value(F.lit(v).cast("long"), "long")
        if isinstance(v, complex):
            return Value(F.struct(F.lit(v.real).alias("re"), F.lit(v.imag).alias("im")), "complex")
        return Value(F.lit(v), "double" if isinstance(v, float) else "string")

    def _name(self, name: str) -> Value:
        if name in self.variables:
            return self.variables[name]
        if name in X.CONSTANTS:
            return Value(F.lit(X.CONSTANTS[name]), "double")
        raise ExpressionError(f"unknown variable {name}")

    def each(self, f: Callable[[Value], Value], v: Value) -> Value:
        """``f`` of a value, or of every element of a list."""
        if v.type != "list":
            return f(v)
        kind = f(Value(F.lit(None), v.item)).type
        return Value(F.transform(v.col, lambda x: f(Value(x, v.item)).col), "list", kind)

    def both(self, f: Callable[[Value, Value], Value], a: Value, b: Value) -> Value:
        """``f`` over scalars and lists; two lists have to be of equal length."""
        if a.type == "list" and b.type == "list":
            kind = f(Value(F.lit(None), a.item), Value(F.lit(None), b.item)).type
            pairs = F.zip_with(a.col, b.col, lambda x, y: f(Value(x, a.item), Value(y, b.item)).col)
            same = F.size(a.col) == F.size(b.col)
            return Value(F.when(same, pairs).when(~same, F.raise_error(F.lit("list lengths differ"))) if self.strict else F.when(same, pairs), "list", kind)
        if a.type == "list":
            return self.each(lambda x: f(x, b), a)
        if b.type == "list":
            return self.each(lambda y: f(a, y), b)
        return f(a, b)

    def _un(self, op: str, n: tuple) -> Value:
        def one(v: Value) -> Value:
            if op == "!":
                return Value(~self.bool(v, op), "bool")
            if op == "~":
                return Value(F.bitwise_not(self.long(v, op)), "long")
            w = self.number(v, op)
            if op == "-" and w.type == "complex":
                re, im = self.parts(w)
                return Value(F.struct((-re).alias("re"), (-im).alias("im")), "complex")
            return w if op == "+" else Value(-w.col, w.type)

        return self.each(one, self.node(n))

    def _fact(self, n: tuple) -> Value:
        k = self.long(self.node(n), "!")
        return Value(F.when(k <= 0, F.lit(1).cast("long")).otherwise(F.factorial(k.cast("int"))), "long")

    def _cast(self, kind: str, n: tuple) -> Value:
        def one(v: Value) -> Value:
            if kind == "bool":
                return Value(self.bool(v, kind), "bool")
            if kind == "string":
                return Value(self.text(v), "string")
            if kind in ("int", "long"):
                return Value(self.long(v, kind), "long")
            return Value(self.double(v, kind), "double")

        return self.each(one, self.node(n))

    def _bin(self, op: str, left: tuple, right: tuple) -> Value:
        a, b = self.node(left), self.node(right)
        if op in ("<+>", "<&>"):
            x, y = self.listed(a), self.listed(b)
            item = x.item if x.item == y.item else "double"
            u, v = (z.col.cast(f"array<{_sql(item)}>") for z in (x, y))
            if op == "<+>":
                return Value(F.concat(u, v), "list", item)
            # every equal pair counts
            return Value(F.flatten(F.transform(u, lambda p: F.transform(F.filter(v, lambda q: q == p), lambda q: q))), "list", item)
        if op in ("&&", "||"):
            x, y = self.bool(a, op), self.bool(b, op)
            return Value(x & y if op == "&&" else x | y, "bool")
        if op in ("+", "-", "*", "/", "%", "**"):
            return self.both(lambda x, y: self.arithmetic(op, x, y), a, b)
        if op in ("&", "|", "^", "<<", ">>"):
            return self.both(lambda x, y: self.bits(op, x, y), a, b)
        return self.both(lambda x, y: self.compare(op, x, y), a, b)

    def arithmetic(self, op: str, a: Value, b: Value) -> Value:
        if op == "+" and "void" in (a.type, b.type):
            return b if a.type == "void" else a
        if op == "+" and "string" in (a.type, b.type):
            return Value(F.concat(self.text(a), self.text(b)), "string")
        if op == "%":
            if a.type not in ("long", "void") or b.type not in ("long", "void"):
                raise ExpressionError("%: integers only")
            y = self.long(b, op)
            return Value(self.long(a, op) % y if self.strict else F.try_mod(self.long(a, op), y), "long")
        x, y = self.number(a, op), self.number(b, op)
        if "complex" in (x.type, y.type):
            return self.complex_arithmetic(op, x, y)
        if op == "**":
            return Value(F.pow(x.col.cast("double"), y.col.cast("double")), "double")
        whole = x.type == y.type == "long"
        if op == "/":
            if whole:
                return Value(F.call_function("div", x.col, y.col) if self.strict else F.when(y.col != 0, F.call_function("div", x.col, F.nullif(y.col, F.lit(0)))), "long")
            u, v = x.col.cast("double"), y.col.cast("double")
            return Value(u / v if self.strict else F.try_divide(u, v), "double")
        u, v = (x.col, y.col) if whole else (x.col.cast("double"), y.col.cast("double"))
        if whole and not self.strict:
            col = {"*": F.try_multiply, "+": F.try_add, "-": F.try_subtract}[op](u, v)
        else:
            col = u * v if op == "*" else u + v if op == "+" else u - v
        return Value(col, "long" if whole else "double")

    def complex_arithmetic(self, op: str, a: Value, b: Value) -> Value:
        (p, q), (r, s) = self.parts(a), self.parts(b)
        if op in ("+", "-"):
            re, im = (p + r, q + s) if op == "+" else (p - r, q - s)
        elif op == "*":
            re, im = p * r - q * s, p * s + q * r
        elif op == "/":
            size = r * r + s * s
            re, im = F.try_divide(p * r + q * s, size), F.try_divide(q * r - p * s, size)
        else:  # exp(w log z); a power of zero is zero
            size, phase = F.hypot(p, q), F.atan2(q, p)
            length = F.when(size == 0, F.lit(0.0)).otherwise(F.exp(r * F.ln(size) - s * phase))
            angle = F.when(size == 0, F.lit(0.0)).otherwise(s * F.ln(size) + r * phase)
            re, im = length * F.cos(angle), length * F.sin(angle)
        return Value(F.struct(re.alias("re"), im.alias("im")), "complex")

    def parts(self, v: Value) -> tuple[Column, Column]:
        return (v.col["re"], v.col["im"]) if v.type == "complex" else (v.col.cast("double"), F.lit(0.0))

    def compare(self, op: str, a: Value, b: Value) -> Value:
        if op in ("==", "!="):
            if "string" in (a.type, b.type):
                same = self.text(a) == self.text(b)
            elif "complex" in (a.type, b.type):
                (p, q), (r, s) = self.parts(self.number(a, op)), self.parts(self.number(b, op))
                same = (p == r) & (q == s)
            else:
                x, y = self.double(a, op), self.double(b, op)
                same = (x == y) & ~F.isnan(x)
            return Value(same if op == "==" else ~same, "bool")
        x, y = self.double(a, op), self.double(b, op)
        known = ~(F.isnan(x) | F.isnan(y))  # Spark orders NaN above all numbers
        return Value(known & {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op], "bool")

    def bits(self, op: str, a: Value, b: Value) -> Value:
        x, y = self.long(a, op), self.long(b, op)
        if op == "&":
            return Value(x.bitwiseAND(y), "long")
        if op == "|":
            return Value(x.bitwiseOR(y), "long")
        if op == "^":
            return Value(x.bitwiseXOR(y), "long")
        return Value(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")), "long")

    def listed(self, v: Value) -> Value:
        if v.type == "void":
            return Value(F.array().cast("array<bigint>"), "list", "long")
        return v if v.type == "list" else Value(F.array(v.col), "list", v.type)

    def _list(self, items: tuple) -> Value:
        keys = [k for k, _ in items]
        values = [self.node(v) for _, v in items]
        kinds = {v.type for v in values}
        item = kinds.pop() if len(kinds) == 1 else "double" if kinds <= {"long", "double"} else None
        if item is None:
            raise ExpressionError("list: elements of different types")
        cols = [v.col.cast(_sql(item)) if item != "list" else v.col for v in values]
        if items and all(k is not None for k in keys):
            pairs = [c for k, v in zip(keys, cols) for c in (self.text(self.node(k)), v)]
            return Value(F.create_map(*pairs), "map", item)
        return Value(F.array(*cols) if cols else F.array().cast("array<bigint>"), "list", item if cols else "long")

    def _range(self, first: tuple, last: tuple, step: tuple | None, closed: bool) -> Value:
        a, b = self.number(self.node(first), "range"), self.number(self.node(last), "range")
        s = None if step is None else self.number(self.node(step), "range")
        if "double" in (a.type, b.type, s.type if s else "long"):
            x, y = a.col.cast("double"), b.col.cast("double")
            z = s.col.cast("double") if s else F.when(y >= x, F.lit(1.0)).otherwise(F.lit(-1.0))
            n = F.floor((y - x) / z + 1e-9).cast("int")
            last_k = n if closed else F.when(F.abs(x + n * z - y) <= F.abs(z) * 1e-9, n - 1).otherwise(n)
            ks = F.when(last_k >= 0, F.sequence(F.lit(0), F.greatest(last_k, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            return Value(F.transform(ks, lambda k: x + k * z), "list", "double")
        z = s.col if s else F.when(b.col >= a.col, F.lit(1).cast("long")).otherwise(F.lit(-1).cast("long"))
        whole = F.sequence(a.col, b.col, z)
        return Value(whole if closed else F.filter(whole, lambda v: v != b.col), "list", "long")

    def _index(self, n: tuple, at: tuple) -> Value:
        v, i = self.node(n), self.node(at)
        if v.type == "string":
            k = self.long(i, "[]")
            return Value(F.substring(v.col, F.when(k < 0, k).otherwise(k + 1).cast("int"), F.lit(1)), "string")
        if v.type != "list":
            raise ExpressionError("[]: not a list")

        def pick(j: Value) -> Value:
            k = self.long(j, "[]")
            k = F.when(k < 0, k + F.size(v.col)).otherwise(k).cast("int")
            found = F.get(v.col, k)
            return Value(self.guard((k >= 0) & (k < F.size(v.col)), found, "[]: out of range") if self.strict else found, v.item)

        return self.each(pick, i)

    def _key(self, n: tuple, key: tuple) -> Value:
        v, k = self.node(n), self.node(key)
        if v.type != "map":
            raise ExpressionError("{}: the list has no keys")
        if k.type == "list":
            return Value(F.map_filter(v.col, lambda x, _: F.array_contains(k.col, x)), "map", v.item)
        return Value(F.try_element_at(v.col, self.text(k)), v.item)

    # ---- functions

    def _call(self, name: str, args: tuple) -> Value:
        values = [self.node(a) for a in args]
        if name in self.functions:
            return self.functions[name](*values)
        if name in ("sizeof", "length") and len(values) == 1:
            v = values[0]
            if v.type == "void":
                return Value(F.lit(0).cast("long"), "long")
            size = F.length(v.col) if v.type == "string" else F.size(v.col) if v.type in ("list", "map") else F.lit(1)
            return Value(size.cast("long"), "long")
        if name == "typeof" and len(values) == 1:
            return Value(F.lit("list" if values[0].type == "map" else values[0].type), "string")
        if name == "keys" and len(values) == 1:
            v = values[0]
            return Value(F.map_keys(v.col) if v.type == "map" else F.array_repeat(F.lit(""), F.size(self.listed(v).col)), "list", "string")
        if name == "rand" and not values:
            return Value(F.rand() if self.seed is None else F.rand(self.seed), "double")
        if name == "srand" and len(args) == 1 and args[0][0] == "lit":
            self.seed = int(args[0][1])
            return Value(F.lit(None).cast("long"), "void")
        if name in ("evaluate", "eval") and len(args) == 1 and args[0][0] == "lit":
            return self.compile(args[0][1])  # the text has to be known when the plan is made
        if name == "complex" and len(values) == 2:
            return Value(F.struct(self.double(values[0], name).alias("re"), self.double(values[1], name).alias("im")), "complex")
        if name == "atan2" and len(values) == 2:
            return self.both(lambda y, x: Value(F.atan2(self.double(y, name), self.double(x, name)), "double"), *values)
        if len(values) == 1 and (name in self.MATH or name in ("abs", "arg", "real", "imag")):
            return self.each(lambda v: self.math(name, v), values[0])
        if values and name in LIST_FUNCTIONS:
            return LIST_FUNCTIONS[name](self, *values)
        if values and name in STRING_FUNCTIONS:
            return STRING_FUNCTIONS[name](self, *values)
        raise ExpressionError(f"no function {name} of {len(values)} arguments")

    MATH = ("sin", "cos", "tan", "asin", "acos", "atan", "exp", "log", "log10", "sqrt", "round", "trunc", "ceil", "floor", "sinc", "pt100")

    def math(self, name: str, v: Value) -> Value:
        if name in ("abs", "arg", "real", "imag"):
            z = self.number(v, name)
            if z.type == "complex":
                re, im = self.parts(z)
                return Value({"abs": F.hypot(re, im), "arg": F.atan2(im, re), "real": re, "imag": im}[name], "double")
            if name == "abs":
                return Value(F.abs(z.col), z.type)
            if name == "arg":
                return Value(F.when(z.col < 0, F.lit(math.pi)).otherwise(F.lit(0.0)), "double")
            return z if name == "real" else Value(F.lit(0).cast(_sql(z.type)), z.type)
        if v.type == "complex" and name in ("sin", "cos", "exp"):
            re, im = self.parts(v)
            pair = {
                "sin": (F.sin(re) * F.cosh(im), F.cos(re) * F.sinh(im)),
                "cos": (F.cos(re) * F.cosh(im), -F.sin(re) * F.sinh(im)),
                "exp": (F.exp(re) * F.cos(im), F.exp(re) * F.sin(im)),
            }[name]
            return Value(F.struct(pair[0].alias("re"), pair[1].alias("im")), "complex")
        x = self.double(v, name)
        if name in ("asin", "acos"):
            col = self.guard((x >= -1) & (x <= 1), getattr(F, name)(x), f"{name}: out of range")
        elif name in ("log", "log10"):
            col = self.guard(x > 0, F.ln(x) if name == "log" else F.log10(x), f"{name}: not positive")
        elif name == "sqrt":
            col = self.guard(x >= 0, F.sqrt(x), "sqrt: negative")
        elif name == "round":
            col = F.signum(x) * F.floor(F.abs(x) + 0.5)
        elif name == "trunc":
            col = F.signum(x) * F.floor(F.abs(x))
        elif name in ("ceil", "floor"):
            col = getattr(F, name)(x).cast("double")
        elif name == "sinc":
            col = F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))
        elif name == "pt100":
            col = pt100(x)
        else:
            col = getattr(F, name)(x)
        return Value(col, "double")


def macro(parameters: list[str], body: str) -> Callable[..., Value]:
    """A function defined by an expression, inlined where it is called: for ``functions`` of the compiler."""
    node = X.parse(body)

    def call(*args: Value) -> Value:
        if len(args) != len(parameters):
            raise ExpressionError(f"{len(parameters)} arguments wanted, {len(args)} given")
        return Compiler(dict(zip(parameters, args))).node(node)

    return call


def pt100(x: Column) -> Column:
    """Temperature of a platinum sensor from its resistance, piece by piece."""
    cubic = [c[0] + x * (c[1] + x * (c[2] + x * c[3])) for _, c in X.PT100_PIECES]
    col = F.when(x < X.PT100_PIECES[0][0], cubic[0])
    for (below, _), c in list(zip(X.PT100_PIECES, cubic))[1:-1]:
        col = col.when(x < below, c)
    return col.otherwise(cubic[-1])


def _sql(kind: str) -> str:
    return {"long": "bigint", "double": "double", "bool": "boolean", "string": "string", "void": "bigint", "complex": "struct<re:double,im:double>"}[kind]


# ---- list functions


def _doubles(c: Compiler, v: Value) -> Column:
    return c.listed(v).col.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _reduced(f: Callable[[Column], Column]) -> Callable[[Compiler, Value], Value]:
    """A function of a list's numbers; an empty list is an error."""

    def run(c: Compiler, v: Value) -> Value:
        a = _doubles(c, v)
        return Value(c.guard(F.size(a) > 0, f(a), "empty list"), "double")

    return run


def _deviation(a: Column) -> Column:
    n = F.size(a)
    mean = _sum(a) / n
    return F.sqrt(F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / n - mean * mean, F.lit(0.0)))


def _delta(c: Compiler, v: Value) -> Value:
    a = c.listed(v)
    n = F.size(a.col)
    later, earlier = F.slice(a.col, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(a.col, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return Value(F.zip_with(later, earlier, lambda y, x: y - x), "list", a.item)


def _sigma(c: Compiler, v: Value) -> Value:
    a = _doubles(c, v)
    grown = F.aggregate(a, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    return Value(grown, "list", "double")


def _find(c: Compiler, v: Value) -> Value:
    a = c.listed(v)
    n = F.size(a.col)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return Value(F.filter(at, lambda i: c.bool(Value(F.get(a.col, i), a.item), "find")).cast("array<bigint>"), "list", "long")


def _count(c: Compiler, v: Value) -> Value:
    a = c.listed(v)
    return Value(F.size(F.filter(a.col, lambda x: c.bool(Value(x, a.item), "count"))).cast("long"), "long")


def _divide(c: Compiler, v: Value, by: Value) -> Value:
    a, n = c.listed(v), c.long(by, "divide").cast("int")
    parts = F.ceil(F.size(a.col) / n).cast("int")
    at = F.when(parts > 0, F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return Value(F.transform(at, lambda i: F.slice(a.col, i * n + 1, n)), "list", "list")


def _constant(value: int) -> Callable[[Compiler, Value], Value]:
    return lambda c, n: Value(F.array_repeat(F.lit(value).cast("long"), F.greatest(c.long(n, "size"), F.lit(0)).cast("int")), "list", "long")


LIST_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "min": _reduced(F.array_min), "max": _reduced(F.array_max), "sum": _reduced(_sum),
    "mean": _reduced(lambda a: _sum(a) / F.size(a)), "average": _reduced(lambda a: _sum(a) / F.size(a)),
    "deviation": _reduced(_deviation), "rms": _reduced(_deviation), "delta": _delta, "sigma": _sigma,
    "zeros": _constant(0), "ones": _constant(1), "find": _find, "count": _count, "divide": _divide,
}


# ---- string functions


def _string(c: Compiler, v: Value, what: str) -> Column:
    if v.type != "string":
        raise ExpressionError(f"{what}: not a string")
    return v.col


def _substr(c: Compiler, v: Value, start: Value, size: Value | None = None) -> Value:
    s, o = _string(c, v, "substr"), c.long(start, "substr").cast("int")
    n = F.length(s)
    o = F.when(o < 0, F.greatest(n + o, F.lit(0))).otherwise(o)
    if size is None:
        return Value(F.substring(s, o + 1, n), "string")
    k = c.long(size, "substr").cast("int")
    k = F.when(k < 0, F.greatest(n + k - o, F.lit(0))).otherwise(k)  # a negative length leaves so many at the end
    return Value(F.substring(s, o + 1, k), "string")


def _position(c: Compiler, v: Value, part: Value, start: Value | None = None) -> Value:
    at = F.lit(0) if start is None else c.long(start, "index").cast("int")
    return Value((F.call_function("locate", _string(c, part, "index"), _string(c, v, "index"), at + 1) - 1).cast("long"), "long")


STRING_FUNCTIONS: dict[str, Callable[..., Value]] = {
    "chop": lambda c, v: Value(F.right(_string(c, v, "chop"), F.lit(1)), "string"),
    "chopped": lambda c, v: Value(F.substring(_string(c, v, "chop"), F.lit(1), F.greatest(F.length(v.col) - 1, F.lit(0))), "string"),
    "chomp": lambda c, v: Value((F.length(_string(c, v, "chomp")) - F.length(F.regexp_replace(v.col, r"\n+\z", ""))).cast("long"), "long"),
    "chomped": lambda c, v: Value(F.regexp_replace(_string(c, v, "chomp"), r"\n+\z", ""), "string"),
    "substr": _substr,
    "index": _position,
}


def compile_expression(text: str, variables: dict[str, tuple[Column, str]], functions: dict[str, Callable[..., Value]] | None = None, strict: bool = False) -> Value:
    """Compiles ``text`` over ``variables`` (name -> (column, type))."""
    return Compiler({k: Value(c, t) for k, (c, t) in variables.items()}, functions, strict).compile(text)
