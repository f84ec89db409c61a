"""Science files as DataFrames.

Files come in through Spark's binaryFile source, so any store that Spark reads
will do, and each file is one row, parsed by one task: archives hold many files of
moderate size, and none may be over 2 GB. The schema is taken from the first file
by name, the only one that is read before the query runs; only the variables asked
for are decoded, and record ranges are cut at the block index. Files are written
the same way, one by each group of rows, by the tasks. ``ScienceFiles`` offers the
reader to spark.read.format("scifile") for paths that the workers can open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyloom.functions import time as times
from skyloom.functions.values import formatted
from skyloom.sources.layout import NUMPY, File, FormatError, Variable, Writer, changed
from skyloom.sources.text import write_skeleton

SPARK = {"INT1": T.ByteType(), "BYTE": T.ByteType(), "INT2": T.ShortType(), "INT4": T.IntegerType(), "INT8": T.LongType(), "UINT1": T.ShortType(), "UINT2": T.IntegerType(), "UINT4": T.LongType(), "REAL4": T.FloatType(), "FLOAT": T.FloatType(), "REAL8": T.DoubleType(), "DOUBLE": T.DoubleType(), "EPOCH": T.DoubleType(), "TIME_TT2000": T.LongType(), "CHAR": T.StringType(), "UCHAR": T.StringType(), "EPOCH16": T.ArrayType(T.DoubleType())}
WIDE = {"UINT1": np.int16, "UINT2": np.int32, "UINT4": np.int64}


def field_of(v: Variable, attributes: dict | None = None, zmode: int = 2) -> T.StructField:
    """The variable's field; its metadata has the attributes, and the data type under "type"."""
    kind = SPARK[v.type]
    for _ in v.shape if zmode == 2 else v.dims:
        kind = T.ArrayType(kind)
    return T.StructField(v.name, kind, True, {"type": v.type} | {k: x for k, x in (attributes or {}).items() if isinstance(x, (str, int, float, list))})


def attributes_of(file: File) -> dict[str, dict]:
    """Attribute values by variable and name."""
    by_number = {(v.is_z, v.number): v.name for v in file.variables.values()}
    out: dict[str, dict] = {}
    for a in file.attributes:
        for sign, number, _, value in a.entries:
            if sign != "g" and (name := by_number.get((sign == "z", number))):
                out.setdefault(name, {})[a.name] = value
    return out


def schema_of(file: File, names: list[str], zmode: int = 2) -> T.StructType:
    found = attributes_of(file)
    return T.StructType([T.StructField("file", T.StringType()), T.StructField("rec", T.LongType()), *(field_of(file.variables[n], found.get(n), zmode) for n in names)])


def chosen(file: File, names: list[str] | None) -> list[str]:
    """The variables asked for, else those that vary by record."""
    if names is not None:
        if missing := [n for n in names if n not in file.variables]:
            raise KeyError(f"no variable named {', '.join(missing)}")
        return names
    return [v.name for v in file.variables.values() if v.record_varies]


def depth_of(kind: pa.DataType) -> int:
    return 1 + depth_of(kind.value_type) if pa.types.is_list(kind) else 0


def nested(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array with one row a record as (nested) lists, without Python objects for numbers."""
    if x.dtype.kind == "U":
        flat = pa.array(x.ravel().tolist(), pa.string())
    else:
        flat = pa.array(np.ascontiguousarray(x).reshape(-1))
    inner, kinds = kind, []
    while pa.types.is_list(inner):
        kinds.append(inner)
        inner = inner.value_type
    out = flat.cast(inner)
    for size in x.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size, dtype=np.int32)) if size else pa.array(np.zeros(2, np.int32)), out)
    return out.cast(kind)


def stacked(lists: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """(Nested) lists of one shape as an array, the inverse of nested."""
    x, shape = lists.combine_chunks(), [len(lists)]
    while pa.types.is_list(x.type) and not x.null_count and len(x):
        sizes = pc.min_max(pc.list_value_length(x)).as_py()
        if sizes["min"] != sizes["max"]:
            break
        shape, x = [*shape, sizes["min"]], x.flatten()
    if pa.types.is_list(x.type) or x.null_count:
        return np.array(lists.to_pylist(), dtype)
    return x.to_numpy(zero_copy_only=False).astype(dtype).reshape(shape)


def column(file: File, name: str, first: int, last: int, kind: pa.DataType, zmode: int = 2) -> pa.Array:
    """Records first to last; null beyond the variable's last record or without the variable, one that does not vary repeats its value."""
    n = last - first + 1
    v = file.variables.get(name)
    if v is None:
        return pa.nulls(n, kind)
    x = file.read(name, first, last, zmode == 1) if v.record_varies else np.repeat(file.read(name, 0, 0, zmode == 1), n, axis=0)
    x = x.astype(WIDE[v.type]) if v.type in WIDE else x
    if x.dtype.kind == "S":
        x = np.char.rstrip(np.char.decode(x, "ascii", "replace"), " \0")
    if depth_of(kind) != x.ndim - 1:
        raise FormatError(f"{name} has another number of dimensions than in the first file")
    found = nested(x, kind)
    return pa.concat_arrays([found, pa.nulls(n - len(x), kind)]) if len(x) < n else found


def batches_of(file: File, path: str, names: list[str], kinds: list[pa.DataType], low: int = 0, high: int | None = None, step: int = 50_000, zmode: int = 2) -> Iterator[pa.RecordBatch]:
    last = max((file.variables[n].last_record if file.variables[n].record_varies else 0 for n in names if n in file.variables), default=-1)
    last = last if high is None else min(last, high)
    for first in range(low, last + 1, step):
        end = min(last, first + step - 1)
        cells = [pa.array([path] * (end - first + 1)), pa.array(range(first, end + 1), pa.int64())]
        for n, k in zip(names, kinds, strict=True):
            try:
                cells.append(column(file, n, first, end, k, zmode))
            except (FormatError, pa.ArrowInvalid, ValueError) as e:
                raise FormatError(f"{path}: {n} cannot be read as {k}: {e}") from e
        yield pa.RecordBatch.from_arrays(cells, ["file", "rec", *names])


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at a path; their contents are not read."""
    return raw_files(spark, path).select("path", "length")


def first_file(spark: SparkSession, path: str) -> File:
    """The file whose path comes first; the names are sorted, and only this one is read."""
    first = listed(spark, path).agg(F.min("path")).first()[0]
    if first is None:
        raise FormatError(f"no file at {path}")
    rows = raw_files(spark, path).where(F.col("path") == first).select("content").limit(1).collect()
    return File(bytes(rows[0]["content"]))


def read(spark: SparkSession, path: str, variables: list[str] | None = None, records: tuple[int, int] | None = None, exclude: list[str] | None = None, zmode: int = 2) -> DataFrame:
    """(file, rec, variables ...) of the files at a path; records: first and last record to read.

    Without names the variables that vary by record are read, those excluded left
    out. The schema is that of the first file. A variable that another file lacks is
    null there; one of another type or shape is an error that names the file. zmode 2
    drops the dimensions in which a variable does not vary, 1 repeats their values.
    """
    _, schema, parse = parser(first_file(spark, path), variables, records, exclude, zmode)
    out = raw_files(spark, path).select("path", "content").mapInArrow(parse, schema)
    return out.select("file", "rec", *(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in schema.fields[2:]))


def parser(head: File, variables: list[str] | None = None, records: tuple[int, int] | None = None, exclude: list[str] | None = None, zmode: int = 2):
    """(names, schema, function for mapInArrow over (path, content)) by a file that has the schema; see read."""
    if zmode not in (1, 2):
        raise ValueError("zmode is 1 or 2")
    names = [n for n in chosen(head, variables) if n not in (exclude or ())]
    schema = schema_of(head, names, zmode)
    low, high = records or (0, None)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)][2:]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from batches_of(opened(content.as_py(), p), p, names, kinds, low, high, zmode=zmode)

    return names, schema, parse


def opened(content: bytes, path: str) -> File:
    try:
        return File(content)
    except FormatError as e:
        raise FormatError(f"{path}: {e}") from e


def decoded(df: DataFrame) -> DataFrame:
    """df with its times (see the field metadata "type") as timestamps in UTC: epochs to the millisecond, the others to the microsecond."""
    shown = {}
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.metadata.get("type")
        if kind == "EPOCH" and not isinstance(f.dataType, T.ArrayType):
            shown[f.name] = times.epoch_to_timestamp(c)
        elif kind == "TIME_TT2000" and not isinstance(f.dataType, T.ArrayType):
            shown[f.name] = times.tt2000_to_timestamp(c)
        elif kind == "EPOCH16" and isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.ArrayType):
            shown[f.name] = times.epoch16_to_timestamp(F.struct(c[0].alias("sec"), c[1].alias("psec")))
    return df.withColumns(shown) if shown else df


def metadata_rows(file: File) -> list[tuple[str, str, str]]:
    """(variable, attribute, value as text)."""
    return [(n, a, x if isinstance(x, str) else repr(x)) for n, own in attributes_of(file).items() for a, x in own.items()]


def in_order(df: DataFrame) -> Iterator:
    """The records one after another, by file and number, a partition at a time on the driver."""
    return df.orderBy("file", "rec").toLocalIterator()


def _table(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                cells = [(p, *r) for r in rows(content.as_py())]
                names = [c.split()[0] for c in schema.split(", ")]
                kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kinds[s.split()[1]]) for i, s in enumerate(schema.split(", "))], names)

    return raw_files(spark, path).select("path", "content").mapInArrow(run, schema)


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: encoding, majority, sizes and whether the checksum fits."""

    def rows(content: bytes):
        f = File(content)
        z = [v for v in f.variables.values() if v.is_z]
        yield (".".join(map(str, f.version)), f.encoding, "ROW" if f.row_major else "COLUMN", max((v.last_record for v in f.variables.values()), default=-1), len(f.variables) - len(z), len(z), len(f.attributes), list(f.rdims), f.leap_date, f.verified())

    return _table(spark, path, rows, "file string, version string, encoding int, majority string, max_rec long, n_r int, n_z int, n_attributes int, dim_sizes array<int>, leap_date int, verified boolean")


def variables(spark: SparkSession, path: str) -> DataFrame:
    """One row a variable."""

    def rows(content: bytes):
        for v in File(content).variables.values():
            yield (v.name, v.type, v.number, v.is_z, v.elements, v.record_varies, list(v.dims), v.last_record, v.sparse, v.compression, str(v.pad))

    return _table(spark, path, rows, "file string, name string, type string, number int, is_z boolean, elements int, record_varies boolean, dims array<int>, max_rec long, sparse int, compression int, pad string")


def attributes(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry; variable is null for global attributes, and value is text."""

    def rows(content: bytes):
        f = File(content)
        by_number = {(v.is_z, v.number): v.name for v in f.variables.values()}
        for a in f.attributes:
            for sign, number, kind, value in a.entries:
                yield (a.name, a.scope, None if sign == "g" else by_number.get((sign == "z", number)), number, kind, value if isinstance(value, str) else repr(value))

    return _table(spark, path, rows, "file string, attribute string, scope string, variable string, entry int, type string, value string")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a value block: the variable's index."""
    return _table(spark, path, lambda c: ((v.name, a, b, at) for f in [File(c)] for v in f.variables.values() for a, b, at in v.blocks), "file string, name string, first_rec long, last_rec long, offset long")


def index_statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row a variable: index records, their entries, levels, records stored and allocated, and the size of its blocks in percent of the plain values."""

    def rows(content: bytes):
        f = File(content)
        for v in f.variables.values():
            plain = sum(b - a + 1 for a, b, _ in v.blocks) * v.record_bytes
            sizes = sum(f.q(at) for _, _, at in v.blocks)
            written = sum(max(0, min(b, v.last_record) - a + 1) for a, b, _ in v.blocks)
            yield (v.name, len(v.index), sum(used for _, _, used in v.index), max((d for d, _, _ in v.index), default=0), written, sum(b - a + 1 for a, b, _ in v.blocks), int(100 * sizes / plain + 0.5) if plain else 0)

    return _table(spark, path, rows, "file string, name string, n_index long, n_entries long, n_levels long, n_records long, n_allocated long, percent long")


def validate(spark: SparkSession, path: str) -> DataFrame:
    """One row an internal record (offset, record, size), a pointer that leads to no record of its kind, or one with the reason why a file cannot be read."""

    def rows(content: bytes):
        try:
            f = File(content)
        except FormatError as e:
            yield (0, "file", len(content), False, str(e))
            return
        for at, kind, size in f.records():
            yield (at, kind, size, kind != "?", None if kind != "?" else "unknown record or size")
        for at, kind, name, to, fits in f.links():
            if not fits:
                yield (at, kind, 0, False, f"{name} points to {to}, where no record of its kind stands")
        for v in f.variables.values():
            if v.number < 0 or v.elements < 1 or any(n < 1 for n in v.dims):
                yield (0, "zVDR" if v.is_z else "rVDR", 0, False, f"{v.name} has numbers out of range")
            for a, b, at in v.blocks:
                try:
                    short = len(f.block(v, at)) < (b - a + 1) * v.record_bytes
                except FormatError as e:
                    yield (at, "block", 0, False, str(e))
                else:
                    if short:
                        yield (at, "block", 0, False, f"{v.name}: records {a} to {b} need more bytes")
        if f.verified() is False:
            yield (f.eof, "checksum", 16, False, "checksum does not fit")

    return _table(spark, path, rows, "file string, offset long, record string, size long, ok boolean, reason string")


def skeleton(spark: SparkSession, path: str, values: str = "nrv") -> str:
    """A skeleton table of one file, which skyloom.sources.text.read_skeleton reads back."""
    return write_skeleton(first_file(spark, path), path.rstrip("/").rpartition("/")[2], values)


def dump(spark: SparkSession, path: str, variables: list[str] | None = None, records: tuple[int, int] | None = None, exclude: list[str] | None = None, transposed: bool = False, digits: int | None = None) -> DataFrame:
    """(file, rec, line) rows of text: each record's values as "variable: value"; records count from 1, both ends included.

    transposed swaps the first two dimensions of arrays, digits rounds real values to so
    many significant ones.
    """
    df = read(spark, path, variables, (records[0] - 1, records[1] - 1) if records else None, exclude)
    cells = []
    for f in df.schema.fields[2:]:
        c = F.col(f"`{f.name}`")
        if transposed and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.ArrayType):
            c = F.transform(F.sequence(F.lit(0), F.size(c[0]) - 1), lambda j, c=c: F.transform(c, lambda row: F.get(row, j)))
        if digits and isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.format_string(f"%.{digits - 1}e", c.cast("double")).cast("double")
        text = F.to_json(F.struct(c.alias("v"))) if isinstance(f.dataType, T.ArrayType) else c.cast("string")
        text = F.regexp_extract(text, r'^\{"v":(.*)\}$', 1) if isinstance(f.dataType, T.ArrayType) else text
        cells.append(F.concat(F.lit(f"{f.name}: "), F.coalesce(text, F.lit("null"))))
    return df.select("file", (F.col("rec") + 1).alias("rec"), F.concat_ws("; ", *cells).alias("line"))


def horizontal(df: DataFrame, columns: list[str], formats: dict[str, str] | None = None, separator: str = " ", heading: bool = True) -> DataFrame:
    """(line) rows of the horizontal text layout: a column each, by its Fortran or C format where one is given."""
    cells = [formatted(F.col(c), formats[c]) if formats and c in formats else F.col(c).cast("string") for c in columns]
    lines = df.select(F.concat_ws(separator, *(F.coalesce(x, F.lit("")) for x in cells)).alias("line"))
    head = df.sparkSession.createDataFrame([(separator.join(columns),)], "line string")
    return head.unionByName(lines) if heading else lines


def save_files(contents: DataFrame, path: str) -> None:
    """Writes each row (name, content) as a file of its own in path/name=<name>/, by the tasks that hold the rows.

    Spark's text writer passes bytes through and adds one line feed, which stands
    behind the end that a file names and so is not part of it. A file is one binary
    value, so at most 2 GB.
    """
    contents.select("name", F.col("content").cast("string").alias("value")).write.partitionBy("name").option("maxRecordsPerFile", 1).text(path)


def written(df: DataFrame, types: dict[str, str], by: str = "file", rec: str = "rec", options: dict | None = None, attributes: dict[str, dict] | None = None, compression: dict[str, int] | None = None) -> DataFrame:
    """(name, content): a file for each value of by, built from its rows in the order of rec, by the tasks.

    types: the data type of each variable to write; options: those of Writer;
    attributes: name -> value by variable, text or numbers of the variable's type. A
    null value becomes the type's pad.
    """
    names = list(types)
    from skyloom.functions.values import PADS

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by(rec)
        w = Writer(**(options or {}))
        for n in names:
            kind, c = types[n], table.column(n)
            if NUMPY[kind] == "S":
                x = [("" if v is None else v) for v in c.to_pylist()]
                w.variable(n, kind, np.array([v.encode("ascii", "replace") for v in x], f"S{max([1, *map(len, x)])}"))
                continue
            if pa.types.is_list(c.type):
                x = stacked(c, NUMPY[kind])
            else:
                x = pc.fill_null(c.cast(pa.from_numpy_dtype(np.dtype(NUMPY[kind]))), pa.scalar(PADS[kind], pa.from_numpy_dtype(np.dtype(NUMPY[kind])))).to_numpy()
            w.variable(n, kind, x, compression=(compression or {}).get(n, 0))
        for n, own in (attributes or {}).items():
            for a, v in own.items():
                w.attribute(a, v, "CHAR" if isinstance(v, str) else types[n], n)
        return pa.table({"name": [str(table.column(by)[0].as_py())], "content": pa.array([w.build()], pa.binary())})

    return df.select(by, rec, *names).groupBy(by).applyInArrow(build, "name string, content binary")


def converted_files(spark: SparkSession, path: str, **changes) -> DataFrame:
    """(name, content) of the files at a path with the changes of skyloom.sources.layout.changed, by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                name = re.sub(r"^name=", "", p.rstrip("/").split("/")[-2]) if "/name=" in p else p.rstrip("/").rpartition("/")[2]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([changed(opened(content.as_py(), p), **changes)], pa.binary())], ["name", "content"])

    return raw_files(spark, path).select("path", "content").mapInArrow(run, "name string, content binary")


class FileReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema = options["path"], schema
        low, _, high = options.get("recordRange", "0-").partition("-")
        self.low, self.high = int(low or 0), int(high) if high else None

    def partitions(self):
        return [InputPartition(p) for p in local_files(self.path)]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        with open(partition.value, "rb") as f:
            file = opened(f.read(), partition.value)
        names = [f.name for f in self.schema.fields[2:]]
        yield from batches_of(file, partition.value, names, [f.type for f in to_arrow_schema(self.schema)][2:], self.low, self.high)


def local_files(path: str) -> list[str]:
    import glob
    import os

    found = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path) or glob.glob(path + ".*"))
    if not found:
        raise FormatError(f"no file at {path}")
    return found


class ScienceFiles(DataSource):
    """spark.dataSource.register(ScienceFiles); options: variables (a,b), recordRange (first-last)."""

    @classmethod
    def name(cls) -> str:
        return "scifile"

    def schema(self) -> T.StructType:
        with open(local_files(self.options["path"])[0], "rb") as f:
            file = File(f.read())
        names = self.options.get("variables")
        return schema_of(file, chosen(file, names.split(",") if names else None))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FileReader(self.options, schema)
