"""Values recorded in different units, brought to the common unit of their quantity.

Pure SQL: number and unit are taken from the text by ``regexp_extract``, aliases are normalised by a join, the first
known of text unit, source's unit and name's unit counts, then factor and shift apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model

#: Spellings of units, compared in lower case with single blanks; the unit's own spelling always counts.
ALIASES = {
    "mbar": ("millibar", "millibars", "mbars", "hpa"),
    "Pa": ("pascal", "pascals"),
    "Torr": ("torrs", "mmhg", "mm hg"),
    "mTorr": ("millitorr", "millitorrs"),
    "psia": ("psi absolute", "psi abs", "psi (abs)", "psi a"),
    "degC": ("°c", "deg c", "deg. c", "degree c", "degrees c", "celsius", "deg celsius", "degree celsius", "degrees celsius", "centigrade", "degrees centigrade", "℃"),
    "K": ("kelvin", "kelvins", "deg k", "degrees kelvin", "degrees k", "°k"),
    "degF": ("°f", "deg f", "deg. f", "degree f", "degrees f", "fahrenheit", "deg fahrenheit", "degree fahrenheit", "degrees fahrenheit", "℉"),
    "V": ("volt", "volts"),
    "mV": ("millivolt", "millivolts"),
    "A": ("amp", "amps", "ampere", "amperes"),
    "mA": ("milliamp", "milliamps", "milliampere", "milliamperes"),
    "sccm": (),
    "slm": ("slpm", "standard litres per minute", "standard liters per minute"),
}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: Whole memos that say the unit of the very value: a bare bracket, "unit: x", "value in x", "logged in x", "entered by hand as x", "this one is x, ...".
MEMO_PATTERN = (
    r"(?i)^\s*(?:"
    r"[\[(]\s*([^\])]+?)\s*[\])]"
    r"|(?:units?|einheit)\s*(?:[:=]|is|ist)?\s*(\S.*?)"
    r"|(?:values?|readings?|logged|recorded|measured|taken|entered|noted|given)\b[^,;.]*?\b(?:in|as)\s+(\S.*?)"
    r"|this\s+(?:one|value|reading)\s+is\s+(?:in\s+)?([^,;]+?)\s*(?:[,;].*)?"
    r")\s*$"
)
#: A number and what follows it up to the end, perhaps after a lead like "panel shows".
MEMO_NUMBER = rf"(?i)^\s*(?:(?:panel|display|gauge|meter|it|value|reading)s?\s+(?:shows?|says?|reads?|is|was)\s*:?\s*|value\s*[:=]?\s*)?({_NUMBER})\s*(\S.*?)\s*$"
#: Words of a label about the gauge's own unit.
LABEL_PATTERNS = (
    r"(?i)\(\s*(?:in\s+)?([^()]+?)\s*\)\s*$",
    r"(?i)\breads?\s+(?:in\s+)?(\S.*?)\s*$",
    r"(?i)\b((?:degrees?|deg\.?)\s+\w+)\s*$",
    r"(?i)\b(?:in|unit:?)\s+(\S.*?)\s*$",
    r"(?i)[,;]\s*([^,;]+?)\s*$",
)


def normal(col: Column) -> Column:
    """Key under which a spelling is looked up."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


_UNIT_COLUMNS = ("unit", "quantity", "common_unit", "factor", "shift")


def definitions(unit_def: DataFrame, max_rows: int = model.BROADCAST_ROWS) -> DataFrame:
    """Each unit once, held and broadcast if the table is small, so that its uses don't read it again."""
    return model.broadcast_if_small(unit_def.where("unit is not null").dropDuplicates(["unit"]).select(*_UNIT_COLUMNS), max_rows)


def alias_table(defs: DataFrame) -> DataFrame:
    """(alias, unit) for every spelling of the units in ``defs``; a spelling of two units stands for the first in order."""
    spark = defs.sparkSession
    known = spark.createDataFrame([(a, u) for u, more in ALIASES.items() for a in more], "alias string, unit string").join(defs.select("unit"), "unit", "left_semi")
    own = defs.select(normal(F.col("unit")).alias("alias"), "unit")
    return own.unionByName(known).groupBy("alias").agg(F.min("unit").alias("unit"))


def memo_unit_text(memo: str, value: str) -> Column:
    """Text that a memo gives as the unit of its very value, normalised; NULL if it gives none.

    A number in the memo has to be the value itself (to 1 part in a million): other numbers belong to something else.
    """
    m, v = F.col(memo), F.col(value)
    number = F.expr(f"try_cast(regexp_extract(`{memo}`, r'{MEMO_NUMBER}', 1) as double)")
    same = F.abs(number - v) <= 1e-6 * F.greatest(F.abs(number), F.abs(v))
    named = F.concat(*(F.regexp_extract(m, MEMO_PATTERN, i) for i in range(1, 5)))
    text = F.when(same, F.regexp_extract(m, MEMO_NUMBER, 2)).otherwise(named)
    return F.when(m.isNotNull() & (text != ""), normal(text))


def unit_versions(states: DataFrame, aliases: DataFrame) -> DataFrame:
    """(endpoint_name, from_us, to_us, source_unit): spans in which the sensor table gives an endpoint's raw values one unit.

    The unit is the input name of the calibration in force, else the label's words about the gauge's own unit.
    Neighbouring states with the same unit are one span, so an endpoint has few. ``aliases`` comes from :func:`alias_table`.
    """
    s = states.withColumn("i0", normal(F.element_at(F.split("default_calibration", ":"), 1)))
    for i, p in enumerate(LABEL_PATTERNS, 1):
        s = s.withColumn(f"i{i}", normal(F.regexp_extract(F.coalesce("label", F.lit("")), p, 1)))
    n = len(LABEL_PATTERNS) + 1
    for i in range(n):
        s = s.join(aliases.select(F.col("alias").alias(f"i{i}"), F.col("unit").alias(f"u{i}")), f"i{i}", "left")
    w = W.partitionBy("endpoint_name").orderBy("from_us")
    s = s.select("endpoint_name", "from_us", F.coalesce(*(f"u{i}" for i in range(n))).alias("source_unit"))
    s = s.withColumn("before", F.lag("source_unit").over(w)).withColumn("first", F.row_number().over(w) == 1)
    s = s.where("first or not (source_unit <=> before)")
    return s.select("endpoint_name", "from_us", F.coalesce(F.lead("from_us").over(w), F.lit(2**62)).alias("to_us"), "source_unit").where("source_unit is not null")


def to_common_units(readings: DataFrame, states: DataFrame, unit_def: DataFrame, broadcast_rows: int = model.BROADCAST_ROWS) -> DataFrame:
    """Readings with ``unit``, ``quantity``, ``common_unit`` and ``value_common`` = value_raw * factor + shift.

    ``unit`` is the first known of: the unit the memo gives for this very value; the one the sensor table gives at the
    reading's time; the first component of the endpoint's name. All four columns are NULL where none is known, and
    ``value_common`` is NULL for NULL and NaN values. Every row is kept, repeated ones too. Columns of these names in
    the input are replaced. NULL memo, endpoint or time only rule out that way to a unit.
    The side tables are broadcast once their size is checked; beyond the bound they are joined by shuffle.
    """
    model.utc(readings.sparkSession)
    added = ("unit", "quantity", "common_unit", "value_common")
    kept = [c for c in readings.columns if c not in added]
    defs = definitions(unit_def, broadcast_rows)
    # the small sides bring all that is to be known of a unit along, so that the readings are joined once for each way to it
    aliases = model.broadcast_if_small(alias_table(defs).join(defs, "unit").select("alias", "unit", F.struct(*_UNIT_COLUMNS).alias("u")), broadcast_rows)
    spans = unit_versions(states, aliases).join(defs.withColumnRenamed("unit", "source_unit"), "source_unit")
    spans = spans.select(*(F.col(c).alias(f"{c}__") for c in ("endpoint_name", "from_us", "to_us")), F.struct(F.col("source_unit").alias("unit"), *_UNIT_COLUMNS[1:]).alias("u2__"))
    spans = model.broadcast_if_small(spans, broadcast_rows)
    r = readings.select(*kept).withColumns({"at__": model.micros("timestamp"), "memo__": memo_unit_text("memo", "value_raw"), "name__": normal(F.substring_index("endpoint_name", "_", 1))})
    r = r.join(spans, (r["endpoint_name"] == spans["endpoint_name__"]) & (r["at__"] >= spans["from_us__"]) & (r["at__"] < spans["to_us__"]), "left")
    for way, text in (("u1__", "memo__"), ("u3__", "name__")):
        r = r.join(aliases.select(F.col("alias").alias(text), F.col("u").alias(way)), text, "left")
    r = r.withColumn("u__", F.coalesce("u1__", "u2__", "u3__"))
    value = model.value_or_null("value_raw") * F.col("u__.factor") + F.col("u__.shift")
    return r.select(*kept, *(F.col(f"u__.{c}").alias(c) for c in added[:3]), value.alias("value_common"))
