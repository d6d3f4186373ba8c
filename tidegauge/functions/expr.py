"""Calibration and condition expressions: tokenizer, parser and driver-side evaluator.

The grammar is C-like with a few extensions (``**``, postfix ``!``, list literals and ranges).
:func:`parse` gives an AST of plain tuples; :func:`evaluate` walks it with Python values and
:mod:`tidegauge.functions.columns` turns the same AST into a Spark ``Column``.
"""

from __future__ import annotations

import cmath
import math
import re
from dataclasses import dataclass
from typing import Any


class ExpressionError(ValueError):
    """The text can't be parsed or its value can't be computed."""


# The rank of each binary operator; a lower rank binds tighter.
RANKS = {
    "*": 4, "/": 4, "%": 4,
    "+": 6, "-": 6, "<+>": 6,
    "<<": 8, ">>": 8,
    "<": 10, ">": 10, "<=": 10, ">=": 10,
    "==": 12, "!=": 12,
    "&": 14, "<&>": 14,
    "^": 16,
    "|": 18,
    "&&": 20,
    "||": 22,
}
# Constants known to every expression (truncated on purpose).
CONSTANTS = {"pi": 3.141592, "e": 2.718281828}
CAST_TYPES = ("bool", "int", "long", "float", "double", "string")

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>0[xX][0-9a-fA-F]+ | 0[bB][01]+ | (?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[iI]?)
    | (?P<str>"(?:[^"\\]|\\.)*" | '(?:[^'\\]|\\.)*')
    | (?P<name>[A-Za-z_][A-Za-z_0-9]*)
    | (?P<op><\+> | <&> | \*\* | << | >> | <= | >= | == | != | && | \|\| | => | [-+*/%<>&^|!~()\[\]{},:;=?.])
    )""",
    re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def tokenize(text: str) -> list[Token]:
    """Tokens of ``text``; a digit run glued to letters (``2020O218``) is an error."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text!r}")
        kind = m.lastgroup
        if kind == "num" and m.end() < len(text) and (text[m.end()].isalpha() or text[m.end()] == "_"):
            raise ExpressionError(f"bad number at {at}: {text!r}")
        out.append(Token(kind, m.group(kind)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind != "str" else ""

    def take(self, want: str | None = None) -> Token:
        if self.at >= len(self.tokens):
            raise ExpressionError(f"unexpected end: {self.text!r}")
        tok = self.tokens[self.at]
        if want is not None and (tok.kind == "str" or tok.text != want):
            raise ExpressionError(f"expected {want!r}, found {tok.text!r}: {self.text!r}")
        self.at += 1
        return tok

    def whole(self) -> tuple:
        node = self.binary(22)
        if self.at != len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at].text!r}: {self.text!r}")
        return node

    def binary(self, rank: int) -> tuple:
        if rank < 4:
            return self.prefix()
        left = self.binary(rank - 2)
        while RANKS.get(op := self.peek()) == rank:
            self.take()
            left = ("bin", op, left, self.binary(rank - 2))
        return left

    def prefix(self) -> tuple:
        op = self.peek()
        if op in ("+", "-", "!", "~") and op:
            self.take()
            return ("un", op, self.prefix())
        if op in ("sizeof", "typeof", "keys") and self.peek(1) != "":
            self.take()
            return ("call", op, (self.prefix(),))
        if op == "(" and self.peek(1) in CAST_TYPES and self.peek(2) == ")":
            self.take(), (kind := self.take().text), self.take()
            return ("cast", kind, self.prefix())
        return self.postfix(self.element())

    def postfix(self, node: tuple) -> tuple:
        while True:
            op = self.peek()
            if op == "[":
                self.take()
                node = ("index", node, self.binary(22))
                self.take("]")
            elif op == "{":
                self.take()
                node = ("key", node, self.binary(22))
                self.take("}")
            elif op == "!":
                self.take()
                node = ("fact", node)
            elif op == "**":
                self.take()
                return ("bin", "**", node, self.prefix())
            else:
                return node

    def element(self) -> tuple:
        tok = self.take()
        if tok.kind == "num":
            t = tok.text.lower()
            if t.startswith("0x") or t.startswith("0b"):
                return ("lit", int(t, 0))
            if t.endswith("i"):
                return ("lit", complex(0.0, float(t[:-1])))
            return ("lit", float(t) if re.search(r"[.e]", t) else int(t))
        if tok.kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), tok.text[1:-1]))
        if tok.kind == "name":
            if tok.text in ("true", "false"):
                return ("lit", tok.text == "true")
            if self.peek() == "(":
                self.take()
                args = []
                while self.peek() != ")":
                    args.append(self.binary(22))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                return ("call", tok.text, tuple(args))
            return ("name", tok.text)
        if tok.text == "(":
            node = self.binary(22)
            self.take(")")
            return node
        if tok.text == "{":
            items = []
            while self.peek() != "}":
                item = self.binary(22)
                if self.peek() == "=>":
                    self.take()
                    items.append((item, self.binary(22)))
                else:
                    items.append((None, item))
                if self.peek() == ",":
                    self.take()
            self.take("}")
            return ("list", tuple(items))
        if tok.text == "[":
            parts, sep = [self.binary(22)], None
            while self.peek() in (",", ":"):
                if sep not in (None, self.peek()):
                    raise ExpressionError(f"mixed range separators: {self.text!r}")
                sep = self.take().text
                parts.append(self.binary(22))
            self.take("]")
            if not 2 <= len(parts) <= 3:
                raise ExpressionError(f"bad range: {self.text!r}")
            if sep == ":":
                start, stop, step = (parts[0], parts[-1], parts[1] if len(parts) == 3 else None)
            else:
                start, stop, step = parts[0], parts[1], parts[2] if len(parts) == 3 else None
            return ("range", start, stop, step, sep == ":")
        raise ExpressionError(f"unexpected {tok.text!r}: {self.text!r}")


def parse(text: str) -> tuple:
    """AST of an expression; raises :class:`ExpressionError`."""
    if not text or not text.strip():
        raise ExpressionError("empty expression")
    return _Parser(text).whole()


def substitute(node: Any, name: str, by: tuple) -> Any:
    """The AST with every variable ``name`` replaced by the AST ``by``."""
    if isinstance(node, tuple):
        if len(node) == 2 and node[0] == "name":
            return by if node[1] == name else node
        return tuple(substitute(x, name, by) for x in node)
    return node


# ---------------------------------------------------------------- driver evaluator


def _is_long(v: Any) -> bool:
    return v is None or (isinstance(v, int) and not isinstance(v, bool))


def _number(v: Any, what: str) -> Any:
    if v is None:
        return 0
    if isinstance(v, bool) or not isinstance(v, (int, float, complex)):
        raise ExpressionError(f"{what}: not a number: {v!r}")
    return v


def _long(v: Any, what: str) -> int:
    if isinstance(v, bool):
        raise ExpressionError(f"{what}: not a number: {v!r}")
    v = _number(v, what)
    if isinstance(v, complex) or (isinstance(v, float) and not math.isfinite(v)):
        raise ExpressionError(f"{what}: not an integer: {v!r}")
    return int(v)


def _double(v: Any, what: str) -> float:
    if isinstance(v, bool):
        return float(v)
    v = _number(v, what)
    if isinstance(v, complex):
        raise ExpressionError(f"{what}: complex number")
    return float(v)


def _bool(v: Any, what: str) -> bool:
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, dict, str)):
        raise ExpressionError(f"{what}: not a condition: {v!r}")
    return bool(_number(v, what))


def _text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"{v:g}" if isinstance(v, float) else str(v)


def _broadcast(f, a: Any, b: Any) -> Any:
    if isinstance(a, list) and isinstance(b, list):
        if len(a) != len(b):
            raise ExpressionError("list lengths differ")
        return [_broadcast(f, x, y) for x, y in zip(a, b)]
    if isinstance(a, dict):
        return {k: _broadcast(f, x, b) for k, x in a.items()}
    if isinstance(b, dict):
        return {k: _broadcast(f, a, x) for k, x in b.items()}
    if isinstance(a, list):
        return [_broadcast(f, x, b) for x in a]
    if isinstance(b, list):
        return [_broadcast(f, a, x) for x in b]
    return f(a, b)


def _arith(op: str, a: Any, b: Any) -> Any:
    if op == "+":
        if a is None:
            return b
        if b is None:
            return a
        if isinstance(a, str) or isinstance(b, str):
            return _text(a) + _text(b)
    if op == "%":
        if not (_is_long(a) and _is_long(b)):
            raise ExpressionError("%: integers only")
        if not (b or 0):
            raise ExpressionError("%: division by zero")
        return int(math.fmod(a or 0, b))
    a, b = _number(a, op), _number(b, op)
    if op == "/":
        if b == 0:
            raise ExpressionError("/: division by zero")
        if isinstance(a, int) and isinstance(b, int):
            q = abs(a) // abs(b)
            return q if (a < 0) == (b < 0) else -q
        return a / b
    if op == "**":
        try:
            return complex(a) ** b if isinstance(a, complex) or isinstance(b, complex) else math.pow(a, b)
        except (ValueError, OverflowError, ZeroDivisionError) as e:
            raise ExpressionError(f"**: {e}") from e
    return a * b if op == "*" else a + b if op == "+" else a - b


def _compare(op: str, a: Any, b: Any) -> bool:
    if op in ("==", "!="):
        if isinstance(a, str) or isinstance(b, str):
            same = _text(a) == _text(b)
        else:
            same = (a or 0) == (b or 0)
        return same == (op == "==")
    x, y = _double(a, op), _double(b, op)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _bits(op: str, a: Any, b: Any) -> int:
    x, y = _long(a, op), _long(b, op)
    if op in ("<<", ">>") and y < 0:
        raise ExpressionError(f"{op}: negative shift")
    return {"&": x & y, "|": x | y, "^": x ^ y, "<<": x << y if y < 64 else 0, ">>": x >> min(y, 63)}[op]


def _as_list(v: Any) -> list:
    return v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else [] if v is None else [v]


def make_range(start: float, stop: float, step: float | None, closed: bool) -> list:
    """``[a, b)`` (comma form) or ``[a, b]`` (colon form); the default step is one towards the end."""
    step = (1 if stop >= start else -1) if step is None else step
    if step == 0 or (stop - start) * step < 0:
        raise ExpressionError("range: bad step")
    n = math.floor((stop - start) / step + 1e-9) + 1
    out = [start + i * step for i in range(n)]
    return out if closed or not out or abs(out[-1] - stop) > abs(step) * 1e-9 else out[:-1]


_UNARY_MATH = {
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "asin": math.asin, "acos": math.acos, "atan": math.atan,
    "exp": math.exp, "log": math.log, "log10": math.log10, "sqrt": math.sqrt,
    "round": lambda x: float(math.copysign(math.floor(abs(x) + 0.5), x)), "trunc": lambda x: float(math.trunc(x)),
    "ceil": lambda x: float(math.ceil(x)), "floor": lambda x: float(math.floor(x)),
    "sinc": lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x),
}


def pt100(x: float) -> float:
    """Temperature (K) of a platinum sensor from its resistance; pieces join at 8 and 40."""
    c = next((c for below, c in PT100_PIECES if x < below), PT100_PIECES[-1][1])
    return c[0] + x * (c[1] + x * (c[2] + x * c[3]))


# Upper end of each piece and its cubic's coefficients, constant first.
PT100_PIECES = [
    (8.0, (-7.1030334872, 15.01325304, -1.555176, 0.0648)),
    (40.0, (25.9483968, 2.6227712, -0.0073364, 7.61e-5)),
    (math.inf, (31.17504, 2.233872, 0.0023532, -4.61e-6)),
]


def _call(name: str, args: list, functions: dict) -> Any:
    if name in functions:
        return functions[name](*args)
    if name in ("sizeof", "length"):
        v = args[0]
        return 0 if v is None else len(v) if isinstance(v, (list, dict, str)) else 1
    if name == "typeof":
        v = args[0]
        return {type(None): "void", bool: "bool", int: "long", float: "double", complex: "complex", str: "string"}.get(type(v), "list")
    if name == "keys":
        return list(args[0]) if isinstance(args[0], dict) else [""] * len(_as_list(args[0]))
    if name == "complex" and len(args) == 2:
        return complex(_double(args[0], name), _double(args[1], name))
    if name == "atan2" and len(args) == 2:
        return _broadcast(lambda y, x: math.atan2(_double(y, name), _double(x, name)), *args)
    if len(args) == 1 and isinstance(args[0], list) and (name in _UNARY_MATH or name in ("abs", "arg", "real", "imag", "pt100")):
        return [_call(name, [x], functions) for x in args[0]]
    if len(args) == 1:
        v = args[0]
        if name in ("abs", "arg", "real", "imag"):
            z = _number(v, name)
            if name == "abs":
                return abs(z)
            if name == "arg":
                return math.atan2(z.imag, z.real) if isinstance(z, complex) else math.pi if z < 0 else 0.0
            return (z.real if name == "real" else z.imag) if isinstance(z, complex) else z if name == "real" else type(z)(0)
        if isinstance(v, complex) and name in ("sin", "cos", "exp"):
            return getattr(cmath, name)(v)
        if name in _UNARY_MATH or name == "pt100":
            x = _double(v, name)
            if name == "tan" and math.cos(x) == 0:
                raise ExpressionError("tan: pole")
            return (pt100 if name == "pt100" else _UNARY_MATH[name])(x)
    raise ExpressionError(f"no function {name} of {len(args)} arguments")


def _eval(node: tuple, env: dict, functions: dict) -> Any:
    kind = node[0]
    if kind == "lit":
        return node[1]
    if kind == "name":
        if node[1] in env:
            return env[node[1]]
        if node[1] in CONSTANTS:
            return CONSTANTS[node[1]]
        raise ExpressionError(f"unknown variable {node[1]}")
    if kind == "un":
        v = _eval(node[2], env, functions)
        f = {"-": lambda x: -_number(x, "-"), "+": lambda x: _number(x, "+"), "!": lambda x: not _bool(x, "!"), "~": lambda x: ~_long(x, "~")}[node[1]]
        return [f(x) for x in v] if isinstance(v, list) else f(v)
    if kind == "fact":
        n = _long(_eval(node[1], env, functions), "!")
        return 1 if n <= 0 else math.factorial(n)
    if kind == "cast":
        v = _eval(node[2], env, functions)
        f = {"bool": lambda x: _bool(x, "bool"), "int": lambda x: _long(x, "int"), "long": lambda x: _long(x, "long"), "string": _text}.get(node[1], lambda x: _double(x, node[1]))
        return [f(x) for x in v] if isinstance(v, list) else f(v)
    if kind == "bin":
        op, a, b = node[1], _eval(node[2], env, functions), _eval(node[3], env, functions)
        if op == "<+>":
            return _as_list(a) + _as_list(b)
        if op == "<&>":
            return [x for x in _as_list(a) for y in _as_list(b) if _compare("==", x, y)]
        if op in ("&&", "||"):
            x, y = _bool(a, op), _bool(b, op)
            return (x and y) if op == "&&" else (x or y)
        if op in ("+", "-", "*", "/", "%", "**"):
            return _broadcast(lambda x, y: _arith(op, x, y), a, b)
        if op in ("&", "|", "^", "<<", ">>"):
            return _broadcast(lambda x, y: _bits(op, x, y), a, b)
        return _broadcast(lambda x, y: _compare(op, x, y), a, b)
    if kind == "call":
        return _call(node[1], [_eval(x, env, functions) for x in node[2]], functions)
    if kind == "list":
        items = [(None if k is None else _text(_eval(k, env, functions)), _eval(v, env, functions)) for k, v in node[1]]
        return {k: v for k, v in items} if items and all(k is not None for k, _ in items) else [v for _, v in items]
    if kind == "range":
        a, b = _number(_eval(node[1], env, functions), "range"), _number(_eval(node[2], env, functions), "range")
        return make_range(a, b, None if node[3] is None else _number(_eval(node[3], env, functions), "range"), node[4])
    if kind == "index":
        v, i = _eval(node[1], env, functions), _eval(node[2], env, functions)
        try:
            return [v[_long(j, "[]")] for j in i] if isinstance(i, list) else v[_long(i, "[]")]
        except (IndexError, TypeError, KeyError) as e:
            raise ExpressionError(f"[]: {e}") from e
    v, k = _eval(node[1], env, functions), _eval(node[2], env, functions)
    if not isinstance(v, dict):
        raise ExpressionError("{}: the list has no keys")
    return {x: v[x] for x in k if x in v} if isinstance(k, list) else v.get(_text(k))


def evaluate(text: str | tuple, variables: dict | None = None, functions: dict | None = None) -> Any:
    """Value of an expression with the given variables; any failure is an :class:`ExpressionError`."""
    try:
        return _eval(parse(text) if isinstance(text, str) else text, variables or {}, functions or {})
    except ExpressionError:
        raise
    except (ArithmeticError, ValueError, TypeError, RecursionError, AttributeError) as e:
        raise ExpressionError(str(e)) from e


def condition_holds(text: str | None, variables: dict) -> bool:
    """``valid_if``: empty conditions hold, and so do those that can't be evaluated."""
    if text is None or not text.strip():
        return True
    try:
        return _bool(evaluate(text, variables), "condition")
    except ExpressionError:
        return True
