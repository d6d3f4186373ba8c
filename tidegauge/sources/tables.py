"""Tables of readings and of other data: parquet, CSV, JDBC, text tables with a header tree, and the empty source.

:class:`Source` finds the name column, lists names and reads a half-open time range, all as lazy plans whose predicates
reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge import model
from tidegauge.sources import trees

NAME_COLUMNS = ("endpoint_name", "sensor_name")
EMPTY_SCHEMA = "endpoint_name string, timestamp timestamp_ntz, value_raw double"


class Source:
    """A table of readings, with an optional dictionary of names."""

    def __init__(self, readings: DataFrame, names: DataFrame | None = None, timestamp: str = "timestamp", value: str = "value_raw"):
        self.readings, self.dictionary, self.timestamp, self.value = readings, names, timestamp, value
        self.name_column = name_column(readings)
        self._names: list[str] | None = None

    @classmethod
    def parquet(cls, spark: SparkSession, path: str, names_path: str | None = None) -> Source:
        model.utc(spark)
        return cls(spark.read.parquet(path), spark.read.parquet(names_path) if names_path else None)

    @classmethod
    def csv(cls, spark: SparkSession, path: str, schema: str = model.READINGS_SCHEMA, **options: str) -> Source:
        model.utc(spark)
        return cls(spark.read.schema(schema).options(header=True, **options).csv(path))

    @classmethod
    def jdbc(
        cls, spark: SparkSession, url: str, table: str = "numeric_data", names_table: str | None = None, partitions: int | None = None, span: tuple[str, str] | None = None,
        timestamp: str = "timestamp", **options: str,
    ) -> Source:
        """A database; the driver's jar has to be on the class path. Range, names and columns are pushed into its SQL.

        With ``partitions`` the readings are read by so many queries at once, each for a part of ``span`` (first and last time
        as text; else asked of the database). Readings outside the span come with the first and last part.
        """
        model.utc(spark)
        url = url if url.startswith("jdbc:") else "jdbc:postgresql://" + re.sub(r"^postgres(?:ql)?://", "", url)
        base = {"url": url, **options}
        read = lambda t, **more: spark.read.format("jdbc").options(dbtable=t, **base, **more).load()
        names = read(names_table) if names_table else None
        if not partitions:
            return cls(read(table), names)
        if span is None:
            first, last = read(table).agg(F.min(timestamp).cast("string"), F.max(timestamp).cast("string")).first()
            if first is None:
                return cls(read(table), names)
            span = first, last
        return cls(read(table, partitionColumn=timestamp, lowerBound=span[0], upperBound=span[1], numPartitions=str(partitions)), names)

    @classmethod
    def directory(cls, spark: SparkSession, path: str, table: str = "numeric_data", names_table: str = "endpoint_id_map") -> Source:
        """Parquet tables below a directory; the dictionary of names is used if it is there."""
        there = table_names(spark, path)
        if table not in there:
            raise ValueError(f"no table {table} among {there}")
        return cls(model.table(spark, path, table), model.table(spark, path, names_table) if names_table in there else None)

    @classmethod
    def empty(cls, spark: SparkSession) -> Source:
        model.utc(spark)
        return cls(spark.createDataFrame([], EMPTY_SCHEMA))

    def name_table(self) -> DataFrame:
        """``name``: the distinct data names, from the dictionary if there is one (its size, not that of the readings)."""
        df = self.dictionary if self.dictionary is not None else self.readings
        return df.select(F.col(name_column(df)).alias("name")).where("name is not null").distinct()

    def names(self, most: int = 1_000_000) -> list[str]:
        """The names in order, kept; more than ``most`` of them are an error, as sensors are bound to them on the driver."""
        if self._names is None:
            rows = model.collected_if_small(self.name_table(), most)
            if rows is None:
                raise ValueError(f"more than {most} data names")
            self._names = sorted(r["name"] for r in rows)
        return self._names

    def range(self, names: Iterable[str], start: float, stop: float) -> DataFrame:
        """Long series ``(name, i, t, x)`` of the names with start <= t < stop, bounds cut to whole seconds.

        Names asked for twice are read once; a name without data has no row.
        """
        from tidegauge.operators import series

        wanted = list(dict.fromkeys(names))
        t = F.col(self.timestamp)
        kind = dict(self.readings.dtypes)[self.timestamp]  # bounds of the column's own type reach the scan
        a, b = (F.timestamp_seconds(F.lit(int(x))).cast(kind) for x in (start, stop))
        df = self.readings.where(F.col(self.name_column).isin(wanted) & (t >= a) & (t < b))
        order = "reading_id" if "reading_id" in df.columns else None
        return series.to_series(df, self.name_column, self.timestamp, self.value, order)


def name_column(df: DataFrame) -> str:
    """The column that names the source of a reading."""
    for c in NAME_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError(f"none of {NAME_COLUMNS} among {df.columns}")


def table_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the parquet tables below a directory, of any file system that Spark reads."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(n[: -len(".parquet")] for f in found if (n := f.getPath().getName()).endswith(".parquet"))


def probe(spark: SparkSession, path: str) -> DataFrame:
    """``(table_name, column_name, names)`` of all tables below a directory; ``names`` marks the column that names the source of a reading."""
    model.utc(spark)
    rows = []
    for t in table_names(spark, path):
        columns = spark.read.parquet(f"{path.rstrip('/')}/{t}.parquet").columns
        chosen = next((c for c in columns if c in NAME_COLUMNS), None)
        rows += [(t, c, c == chosen) for c in columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, names boolean")


# ---- text tables with a header


def tokenize(line: str, delimiter: str | None = None, quote: str = '"') -> list[str]:
    """Cells of a row: parted by ``delimiter``, or by blanks; quoted cells may hold it, a backslash escapes; blanks around are cut."""
    out, cell, inside, any_quote, i = [], "", "", False, 0
    quotes = ('"', "'") if quote == '"' else (quote,)
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            cell += line[i + 1]
            i += 2
            continue
        if inside and c == inside:
            inside = ""
        elif not inside and c in quotes and not cell.strip():
            cell, inside, any_quote = "", c, True
        elif not inside and (c == delimiter if delimiter else c.isspace()):
            if delimiter or cell or any_quote:
                out.append(cell if any_quote else cell.strip())
            cell, any_quote = "", False
        else:
            cell += c
        i += 1
    if delimiter or cell or any_quote:
        out.append(cell if any_quote else cell.strip())
    return out


def lines_of(text: str) -> list[str]:
    """Lines with any of the three line ends."""
    return re.split(r"\r\n|\r|\n", text)


# Type letters of a leaf descriptor.
LEAF_TYPES = {"C": "string", "B": "int", "S": "int", "I": "int", "L": "long", "F": "float", "D": "double"}


def leaf_descriptor(line: str) -> list[tuple[str, str]] | None:
    """Columns of a header line ``name/T:name[n]/T:...``; a leaf without type is a float; None if the line is none."""
    leaves = line.strip().split(":")
    out, typed = [], False
    for leaf in leaves:
        m = re.fullmatch(r"([A-Za-z0-9_ ]+)(?:\[(\d+)\])?(?:/([CBSILFD]))?", leaf)
        if not m:
            return None
        typed = typed or bool(m[3])
        kind = LEAF_TYPES.get(m[3] or "F")
        names = [f"{m[1].strip()}{i}" for i in range(int(m[2]))] if m[2] else [m[1].strip()]
        out += [(n, kind) for n in names]
    return out if typed or (len(leaves) > 1 and " " not in line.strip()) else None


def _type(name: str) -> T.DataType:
    n = name.lower()
    return T.LongType() if n in ("int", "long", "integer") else T.DoubleType() if n in ("float", "double") else T.StringType()


@dataclass
class Layout:
    """How a text table's rows are cut and typed. ``skip`` is the line of names, where that is part of the body."""

    header: trees.Tree
    columns: list[tuple[str, str | None]]
    delimiter: str | None = None
    quote: str = '"'
    skip: str | None = None
    comment: str | None = "#"

    @classmethod
    def of(cls, lines: list[str], suffix: str = ".ktf") -> Layout:
        if suffix.lower() == ".csv":
            first = next((x for x in lines if x.strip()), None)
            return cls(trees.Tree(), [(c, None) for c in tokenize(first, ",")] if first is not None else [], ",", '"', first, None)
        header = trees.parse_ktf("\n".join(lines))

        def words(*keys: str) -> list[str]:
            v = next((header[k] for k in keys if header.get(k) is not None), [])
            return [str(x) for x in v] if isinstance(v, list) else tokenize(str(v))

        fields, types = words("Fields", "Field"), words("FieldTypes", "FieldType")
        out = cls(header, [(f, types[i] if i < len(types) else None) for i, f in enumerate(fields)])
        out.delimiter = str(header["Delimiter"])[:1] if header.get("Delimiter") else None
        out.quote = str(header["Quote"])[:1] if header.get("Quote") else '"'
        first = next((x for x in lines if x.strip() and not x.startswith("#")), "")
        if not fields and (leaves := leaf_descriptor(first)):
            out.columns, out.skip = list(leaves), first
        return out

    def cells(self, line: str) -> list[str]:
        return tokenize(line, self.delimiter, self.quote)


class TextTable:
    """A text table: header tree, columns with types, and rows with the number of their segment (parted by blank lines).

    For texts that fit on the driver; :func:`read_table` reads files of any size.
    """

    def __init__(self, text: str, suffix: str = ".ktf"):
        lines = lines_of(text)
        layout = Layout.of(lines, suffix)
        self.header = layout.header
        self.rows: list[list[object]] = []
        self.segments: list[int] = []
        body = [x for x in lines if not (layout.comment and x.startswith(layout.comment))]
        if layout.skip is not None:
            body = body[body.index(layout.skip) + 1 :]
        segment, open_ = 0, False
        for line in body:
            if not line.strip():
                segment, open_ = segment + open_, False
                continue
            self.rows.append(list(layout.cells(line)))
            self.segments.append(segment)
            open_ = True
        columns = numbered(layout.columns, max(map(len, self.rows), default=0))
        self.columns = [c for c, _ in columns]
        self.types = [_type(t) if t else self._inferred(i) for i, (_, t) in enumerate(columns)]
        self.rows = [[_cell(r[i] if i < len(r) else "", t) for i, t in enumerate(self.types)] for r in self.rows]

    def _inferred(self, i: int) -> T.DataType:
        """Double if every cell with content is a number, else string."""
        cells = [r[i] for r in self.rows if i < len(r) and r[i] != ""]
        return T.DoubleType() if cells and all(isinstance(_number(c), float) for c in cells) else T.StringType()

    def dataframe(self, spark: SparkSession, segment: str = "segment") -> DataFrame:
        schema = T.StructType([*(T.StructField(c, t) for c, t in zip(self.columns, self.types)), T.StructField(segment, T.IntegerType())])
        return spark.createDataFrame([(*r, s) for r, s in zip(self.rows, self.segments)], schema)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _cell(text: str, kind: T.DataType) -> object:
    if text == "":
        return None
    if isinstance(kind, T.StringType):
        return text
    v = _number(text)
    if v is None:
        return int(text, 16) if isinstance(kind, T.LongType) and re.fullmatch(r"0[xX][0-9a-fA-F]+", text) else None
    return int(v) if isinstance(kind, T.LongType) else v


def numbered(columns: list[tuple[str, str | None]], width: int) -> list[tuple[str, str | None]]:
    """The columns, and numbered ones for further cells."""
    return [*columns, *((f"Column{i:03d}", None) for i in range(len(columns), width))]


_BLOCK = "file string, start long, opens long, begins boolean, ends boolean, width int, numeric array<boolean>"


def _line_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Runs of lines of one block of a file; a file's lines come block by block."""
    for b in batches:
        file, start = b["file"].to_pylist(), b["start"].to_numpy()
        cuts = [0, *(i for i in range(1, b.num_rows) if start[i] != start[i - 1] or file[i] != file[i - 1]), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield file[x], int(start[x]), b.slice(x, y - x)


class _Body:
    """Rows of one block of lines, with their segments counted from the block's begin."""

    def __init__(self, layout: Layout, start: int):
        self.layout, self.skip = layout, layout.skip if start == 0 else None
        self.opens, self.begins, self.open = 0, None, False

    def rows(self, lines: list[str]) -> Iterator[tuple[int, list[str]]]:
        for line in lines:
            if self.layout.comment and line.startswith(self.layout.comment):
                continue
            if self.skip is not None and line == self.skip:
                self.skip = None
                continue
            blank = not line.strip()
            if self.begins is None:
                self.begins = not blank
            if blank:
                self.open = False
                continue
            if not self.open:
                self.opens += 1
            self.open = True
            yield self.opens - 1, self.layout.cells(line)


def read_table(spark: SparkSession, path: str, segment: str = "segment", suffix: str | None = None) -> DataFrame:
    """A text table, or a folder of tables with equal headers, of any size and file system, with the number of each row's segment.

    By its suffix (or ``suffix``): ``.csv`` has a line of names, anything else a header tree (of at most 10,000 lines) or a
    leaf descriptor. Lines are cut where Spark cuts files; a first pass counts segments and looks at the types of each
    block, of which one row comes to the driver, a second one parses the rows. Segments go on over a folder's files in the
    order of their names. Undeclared columns are doubles if all their cells are numbers, else strings.
    """
    model.utc(spark)
    suffix = suffix or Path(path).suffix
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    first = text.where("start = 0").agg(F.min("file")).first()[0]
    head = [r["value"] for r in text.where((F.col("start") == 0) & (F.col("file") == first)).limit(10_000).collect()] if first else []
    layout = Layout.of(head, suffix)
    names = len(layout.columns)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, body, width, numeric = None, None, 0, []
        found: list[tuple] = []
        for file, start, b in _line_blocks(batches):
            if at != (file, start):
                if at is not None:
                    found.append((*at, body.opens, body.begins, body.open, width, numeric))
                at, body, width, numeric = (file, start), _Body(layout, start), 0, [True] * names
            for _, cells in body.rows(b["value"].to_pylist()):
                width = max(width, len(cells))
                numeric += [True] * (len(cells) - len(numeric))
                for i, c in enumerate(cells):
                    numeric[i] = numeric[i] and (c == "" or _number(c) is not None)
        if at is not None:
            found.append((*at, body.opens, body.begins, body.open, width, numeric))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.list_(pa.bool_()))
        columns = list(zip(*found)) if found else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=["file", "start", "opens", "begins", "ends", "width", "numeric"])

    blocks = sorted(text.mapInArrow(look, _BLOCK).collect(), key=lambda r: (r["file"], r["start"]))
    offsets: dict[tuple[str, int], int] = {}
    done, open_ = 0, False
    for r in blocks:
        joined = open_ and r["begins"] is True and r["start"] > 0
        offsets[r["file"], r["start"]] = done - joined
        done += r["opens"] - joined
        open_ = r["ends"] or (open_ and r["begins"] is None)
    columns = numbered(layout.columns, max((r["width"] for r in blocks), default=0))
    numeric = lambda i: all(r["numeric"][i] for r in blocks if i < len(r["numeric"])) and any(i < len(r["numeric"]) and r["width"] for r in blocks)
    types = [_type(t) if t else T.DoubleType() if numeric(i) else T.StringType() for i, (_, t) in enumerate(columns)]
    schema = T.StructType([*(T.StructField(c, t) for (c, _), t in zip(columns, types)), T.StructField(segment, T.IntegerType())])
    arrow = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.IntegerType: pa.int32()}
    fields = pa.schema([(f.name, arrow[type(f.dataType)]) for f in schema])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, body = None, None
        for file, start, b in _line_blocks(batches):
            if at != (file, start):
                at, body = (file, start), _Body(layout, start)
            rows = [(*(_cell(cells[i] if i < len(cells) else "", t) for i, t in enumerate(types)), s + offsets[at]) for s, cells in body.rows(b["value"].to_pylist())]
            columns = list(zip(*rows)) if rows else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, fields)], schema=fields)

    return text.mapInArrow(parse, schema)


def _text_cell(v: object, blank: str) -> str:
    if v is None:
        return blank
    if isinstance(v, float):
        return f"{v:.9g}"
    s = str(v)
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' if re.search(r'[\s,"\\#]', s) or not s else s


def _head(df: DataFrame, suffix: str, header: dict | None) -> str:
    if suffix.lower() == ".csv":
        return ",".join(_text_cell(c, "") for c in df.columns)
    kinds = ["long" if t in ("tinyint", "smallint", "int", "bigint") else "double" if t in ("float", "double") else "string" for _, t in df.dtypes]
    return trees.to_ktf({**(header or {}), "Fields": " ".join(df.columns), "FieldTypes": " ".join(kinds)}).rstrip("\n") + "\n"


def _row_text(row: Iterable[object], suffix: str) -> str:
    return ",".join(_text_cell(v, "") for v in row) if suffix.lower() == ".csv" else " ".join(_text_cell(v, '""') for v in row)


def write_table(df: DataFrame, path: str, suffix: str = ".ktf", header: dict | None = None) -> None:
    """A table of any size as text tables, one per partition and each with the header, below a new folder ``path``.

    Numbers have nine significant digits; NULL is an empty cell (``""`` between blanks). Line ends inside texts become blanks.
    """
    model.utc(df.sparkSession)
    head = _head(df, suffix, header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            lines = [_row_text(r, suffix).replace("\r", " ").replace("\n", " ") for r in zip(*(c.to_pylist() for c in b.columns))]
            if first:
                lines, first = [*head.split("\n"), *lines], False
            yield pa.RecordBatch.from_arrays([pa.array(lines, type=pa.string())], names=["value"])
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(head.split("\n"), type=pa.string())], names=["value"])

    df = df if df.rdd.getNumPartitions() else df.repartition(1)
    df.mapInArrow(run, "value string").write.text(path)


def to_text(df: DataFrame, suffix: str = ".ktf", header: dict | None = None) -> str:
    """A small table as one text; see :func:`write_table` for others."""
    return "\n".join([_head(df, suffix, header), *(_row_text(r, suffix) for r in df.toLocalIterator())]) + "\n"
