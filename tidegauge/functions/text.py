"""Text from values and values from text, as column expressions: a formatter and a scanner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_by(text: Column, separator: str, defaults: list[str | None] = []) -> Column:
    """Parts of a text between separators, as an array; an empty part is the default of its place, or NULL.

    There are at least as many parts as defaults. A NULL text gives the defaults.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\\Q" + separator + "\\E", -1)
    given = F.array(*(F.lit(d).cast("string") for d in defaults))
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    last = F.greatest(F.size(cut), F.lit(len(defaults))) - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.coalesce(F.nullif(F.get(cut, i), F.lit("")), F.get(given, i)))


class Formatter:
    """Collects pieces of text; settings hold for the pieces put after them. Width holds for the next piece only.

    >>> Formatter().setw(8).setfill("0").put(F.col("n")).put(" V").flush()
    """

    def __init__(self) -> None:
        self.pieces: list[Column] = []
        self.width, self.fill, self.base, self.precision, self.notation = 0, " ", 10, 6, "general"

    def setw(self, width: int) -> Formatter:
        self.width = width
        return self

    def setfill(self, fill: str) -> Formatter:
        self.fill = fill[:1] or " "
        return self

    def setprecision(self, digits: int) -> Formatter:
        self.precision = digits
        return self

    def setbase(self, base: int) -> Formatter:
        self.base = base
        return self

    def hex(self) -> Formatter:
        return self.setbase(16)

    def dec(self) -> Formatter:
        return self.setbase(10)

    def fixed(self) -> Formatter:
        self.notation = "fixed"
        return self

    def scientific(self) -> Formatter:
        self.notation = "scientific"
        return self

    def put(self, value: Column | str | int | float, kind: str | None = None) -> Formatter:
        """Adds a value; plain Python values are text or numbers of their own type, columns are of ``kind`` (string)."""
        if not isinstance(value, Column):
            kind = kind or ("long" if isinstance(value, int) else "double" if isinstance(value, float) else "string")
            value = F.lit(value)
        if kind == "long":
            text = value.cast("string") if self.base == 10 else F.lower(F.conv(value.cast("string"), 10, self.base))
        elif kind == "double":
            text = self._double(value)
        else:
            text = value.cast("string")
        if self.width:
            text = F.when(F.length(text) >= self.width, text).otherwise(F.lpad(text, self.width, self.fill))
            self.width = 0
        self.pieces.append(text)
        return self

    def _double(self, x: Column) -> Column:
        if self.notation == "fixed":
            return F.format_string(f"%.{self.precision}f", x)
        if self.notation == "scientific":
            return F.format_string(f"%.{self.precision}e", x)
        # significant digits: plain notation unless the exponent is below -4 or not below the digits; no trailing zeros
        digits = max(self.precision, 1)
        size = F.floor(F.log10(F.abs(x)))
        exponent = F.floor(F.log10(F.abs(F.format_string(f"%.{digits - 1}e", x).cast("double"))))
        plain = F.element_at(F.array(*(F.format_string(f"%.{n}f", x) for n in range(digits + 4))), F.greatest(F.least(digits - 1 - exponent, F.lit(digits + 3)), F.lit(0)).cast("int") + 1)
        cut = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
        wide = F.regexp_replace(F.format_string(f"%.{digits - 1}e", x), r"\.?0+e", "e")
        return F.when(x == 0, F.lit("0")).when(F.isnan(x), F.lit("nan")).when((exponent < -4) | (exponent >= digits), wide).when(size.isNotNull(), cut)

    def flush(self) -> Column:
        """The text so far; the formatter is empty again. A NULL piece makes the text NULL."""
        out = F.concat(*self.pieces) if self.pieces else F.lit("")
        self.pieces = []
        return out


class Scanner:
    """Takes typed fields from the front of a text, one after another."""

    def __init__(self, text: Column):
        self.rest, self.base = text, 10

    def setbase(self, base: int) -> Scanner:
        self.base = base
        return self

    def skipws(self) -> Scanner:
        self.rest = F.regexp_replace(self.rest, r"^\s+", "")
        return self

    def get(self, kind: str = "string") -> Column:
        """Next word as a string, long or double; NULL if there is none or it isn't of the type."""
        word = F.regexp_extract(self.rest, r"^\s*(\S+)", 1)
        self.rest = F.regexp_replace(self.rest, r"^\s*\S+", "")
        word = F.when(word != "", word)
        if kind == "long" and self.base != 10:
            return F.conv(F.regexp_extract(word, r"^(?:0[xX])?([0-9a-zA-Z]+)$", 1), self.base, 10).try_cast("long")
        return word.try_cast({"long": "bigint"}.get(kind, kind))

    def get_line(self, end: str = "\n") -> Column:
        """Text up to ``end``, which is taken too."""
        at = F.locate(end, self.rest)
        line = F.when(at > 0, F.substring(self.rest, F.lit(1), at - 1)).otherwise(self.rest)
        self.rest = F.when(at > 0, F.substring(self.rest, at + len(end), F.length(self.rest))).otherwise(F.lit(""))
        return line

    def good(self) -> Column:
        """Whether something is left."""
        return F.length(self.rest) > 0

    def gcount(self) -> Column:
        """Characters left."""
        return F.length(self.rest).cast("long")
