"""SAS transport files: rows of a fixed length, read by many tasks; and a writer.

A file is cut into ranges of rows. Each is a partition of the ``transport`` source, whose task reads
its bytes in chunks, so neither the file nor a range is ever in memory as a whole. Where only Spark
can open a store, a file is decoded in one task instead (and then must fit Spark's 2 GB).

Files of one survey component become one table. Their columns are found first, from the headers
alone; files that cannot be read are skipped and listed by ``xport_headers``.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from panelwise.functions.columns import nan_as_null
from panelwise.operators.joins import survey_join
from panelwise.sources.folders import arrow_store as _store
from panelwise.sources.studies import find_files
from panelwise.vocabulary import KEY, SURVEY_FILES

CHUNK_ROWS = 50_000
#: Bytes of rows that one task reads, and that it holds at a time.
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
HEAD_BYTES = 1 << 18
_NAMES = b"HEADER RECORD*******NAMESTR HEADER RECORD!!!!!!!"
_ROWS = b"HEADER RECORD*******OBS     HEADER RECORD!!!!!!!"
_CARD = 80
_NAME_SIZE = 140


@dataclass(frozen=True)
class _Column:
    name: str
    is_text: bool
    start: int
    width: int


def _layout(content: bytes) -> tuple[list[_Column], int]:
    """Columns of a version 5 transport file, and where its rows begin (the published layout)."""
    names, rows = content.find(_NAMES), content.find(_ROWS)
    if names < 0 or rows < 0:
        raise ValueError("not a SAS transport file")
    count = int(content[names + 54 : names + 58])
    columns = []
    for i in range(count):
        entry = content[names + _CARD + i * _NAME_SIZE :][:_NAME_SIZE]
        kind, _, width = struct.unpack(">hhh", entry[:6])
        (start,) = struct.unpack(">l", entry[84:88])
        columns.append(_Column(entry[8:16].decode("latin1").strip(), kind == 2, start, width))
    return columns, rows + _CARD


def _doubles(cells: np.ndarray) -> np.ndarray:
    """Base-16 floating numbers, cut to their first bytes, as doubles; missing values as NaN."""
    full = np.zeros((len(cells), 8), dtype=np.uint8)
    full[:, : cells.shape[1]] = cells
    bits = full.view(">u8").ravel().astype(np.uint64)
    fraction = (bits & np.uint64((1 << 56) - 1)).astype(np.float64) / 2.0**56
    exponent = ((bits >> np.uint64(56)) & np.uint64(127)).astype(np.int64) - 64
    values = np.ldexp(fraction, 4 * exponent)
    values[(bits >> np.uint64(63)) == 1] *= -1
    values[(fraction == 0) & (full[:, 0] != 0)] = np.nan
    return values


def _table(rows: np.ndarray, columns: Sequence[_Column]) -> dict[str, np.ndarray]:
    """Columns of rows given as a matrix of bytes; an empty text is None."""
    out: dict[str, np.ndarray] = {}
    for c in columns:
        cells = np.ascontiguousarray(rows[:, c.start : c.start + c.width])
        if c.is_text:
            text = [v.decode("latin1").rstrip() or None for v in cells.view(f"S{c.width}").ravel()]
            out[c.name] = np.array(text, dtype=object)
        else:
            out[c.name] = _doubles(cells)
    return out


def _batch(rows: np.ndarray, columns: Sequence[_Column], kinds: dict[str, bool]) -> pa.RecordBatch:
    """Rows under the wanted columns (name to whether it is text); one that is not there is null."""
    own, n = _table(rows, columns), len(rows)
    is_text = {c.name: c.is_text for c in columns}
    arrays = []
    for name, text in kinds.items():
        kind = pa.string() if text else pa.float64()
        if name not in own:
            arrays.append(pa.nulls(n, kind))
        elif text and not is_text[name]:
            arrays.append(pa.array([None if np.isnan(v) else str(v) for v in own[name]], kind))
        else:
            arrays.append(pa.array(own[name], kind, from_pandas=not text))
    return pa.RecordBatch.from_arrays(arrays, names=list(kinds))


def _row_count(size: int, begin: int, width: int, tail: bytes) -> int:
    """Rows of a file of ``size`` bytes. The last card is filled up with blanks, which may look like
    rows; ``tail`` are the last bytes of the file, a card or less."""
    count = (size - begin) // width if width else 0
    while count:
        at = begin + (count - 1) * width - (size - len(tail))
        if at < 0 or tail[at : at + width].strip(b" "):
            break
        count -= 1
    return count


# --------------------------------------------------------------------------------------------
# files


@dataclass(frozen=True)
class _Range(InputPartition):
    """Rows of one file: where they begin, their number, and the file's columns."""

    path: str
    offset: int
    rows: int
    width: int
    columns: tuple[_Column, ...]


def _head(path: str) -> tuple[list[_Column], int, int]:
    """Columns, place of the first row, and number of rows of a file; only its ends are read."""
    store, name = _store(path)
    with store.open_input_file(name) as file:
        size, want = file.size(), HEAD_BYTES
        content = file.read_at(min(want, size), 0)
        while content.find(_ROWS) < 0 and len(content) < size and content.startswith(b"HEADER RECORD"):
            want *= 4
            content = file.read_at(min(want, size), 0)
        columns, begin = _layout(content)
        tail = file.read_at(min(_CARD, size - begin), max(begin, size - _CARD))
    return columns, begin, _row_count(size, begin, sum(c.width for c in columns), tail)


class TransportReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.kinds = {f.name: isinstance(f.dataType, T.StringType) for f in schema.fields}
        self.paths = json.loads(options["paths"])
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            columns, begin, count = _head(path)
            width = sum(c.width for c in columns)
            step = max(1, self.range_bytes // max(1, width))
            for first in range(0, count, step):
                out.append(_Range(path, begin + first * width, min(step, count - first), width, tuple(columns)))
        return out or [_Range("", 0, 0, 0, ())]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, name = _store(partition.path)
        step = max(1, CHUNK_BYTES // partition.width)
        with store.open_input_file(name) as file:
            for first in range(0, partition.rows, step):
                n = min(step, partition.rows - first)
                data = file.read_at(n * partition.width, partition.offset + first * partition.width)
                yield _batch(np.frombuffer(data, dtype=np.uint8).reshape(n, partition.width), partition.columns, self.kinds)


class TransportSource(DataSource):
    """``spark.read.format("transport").schema(...).option("paths", json)``: rows of transport files
    under the columns of the schema (strings and doubles)."""

    @classmethod
    def name(cls) -> str:
        return "transport"

    def reader(self, schema: T.StructType) -> TransportReader:
        return TransportReader(schema, self.options)


def _files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")


_HEADERS = "path string, column string, is_text boolean, problem string"


def xport_headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, column, is_text, problem) per column; an unreadable file has a problem instead."""

    def described(path: str, layout) -> pd.DataFrame:
        try:
            found = [(path, c.name, c.is_text, None) for c in layout()]
        except Exception as error:  # noqa: BLE001 - the reason is part of the result
            found = [(path, None, None, str(error))]
        return pd.DataFrame(found, columns=["path", "column", "is_text", "problem"])

    def look(batches):
        for batch in batches:
            for path in batch["path"]:
                yield described(path, lambda: _head(path)[0])  # noqa: B023 - called at once

    def look_inside(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                yield described(path, lambda: _layout(content)[0])  # noqa: B023 - called at once

    if all(_store(p) for p in paths):
        named = spark.createDataFrame([(p,) for p in paths], "path string")
        return named.repartition(max(1, min(len(paths), 200))).mapInPandas(look, _HEADERS)
    return _files(spark, paths).mapInPandas(look_inside, _HEADERS)


def read_xport(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of all readable files under the union of their columns.

    A column that is text in one file is text; missing numbers and empty texts are null. No paths,
    or no readable file, give a table without rows and columns.
    """
    headers = xport_headers(spark, paths).collect() if paths else []  # one row per column of a file
    good = sorted({h["path"] for h in headers if h["problem"] is None})
    kinds: dict[str, bool] = {}
    for h in sorted(headers, key=lambda h: h["path"]):
        if h["problem"] is None:
            kinds[h["column"]] = kinds.get(h["column"], False) or h["is_text"]
    schema = T.StructType([T.StructField(c, T.StringType() if text else T.DoubleType()) for c, text in kinds.items()])
    if not good:
        return spark.createDataFrame([], schema)
    if all(_store(p) for p in good):
        spark.dataSource.register(TransportSource)
        rows = spark.read.format("transport").schema(schema).option("paths", json.dumps(good)).option("rangebytes", str(range_bytes)).load()
    else:
        rows = _files(spark, good).mapInArrow(lambda batches: _decode_whole(batches, kinds), schema)
    table = nan_as_null(rows)
    return table.withColumn(KEY, F.col(KEY).cast("bigint")) if KEY in kinds else table


def _decode_whole(batches: Iterator[pa.RecordBatch], kinds: dict[str, bool]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch["content"]:
            data = content.as_buffer()
            columns, begin = _layout(data.to_pybytes())
            width = sum(c.width for c in columns)
            count = _row_count(data.size, begin, width, data.slice(max(begin, data.size - _CARD)).to_pybytes())
            rows = np.frombuffer(data, dtype=np.uint8, offset=begin, count=count * width).reshape(count, width)
            for at in range(0, count, CHUNK_ROWS):
                yield _batch(rows[at : at + CHUNK_ROWS], columns, kinds)


# --------------------------------------------------------------------------------------------
# writing

# Cards of the published layout.
_STAMP = b"01JAN70:00:00:00"
_ZEROS = b"0" * 30 + b"  "


def _mark(name: str, tail: bytes) -> bytes:
    return f"HEADER RECORD*******{name:<8}HEADER RECORD!!!!!!!".encode() + tail


def _header(columns: Sequence[_Column]) -> bytes:
    member = b" " * 24 + _STAMP
    out = _mark("LIBRARY", _ZEROS) + b"SAS     SAS     SASLIB  9.4     LINUX   " + member + _STAMP.ljust(_CARD)
    out += _mark("MEMBER", b"000000000000000001600000000140  ") + _mark("DSCRPTR", _ZEROS)
    out += b"SAS     DATA    SASDATA 9.4     LINUX   " + member + _STAMP.ljust(_CARD)
    out += _mark("NAMESTR", f"000000{len(columns):04d}00000000000000000000  ".encode())
    names = b""
    for i, c in enumerate(columns, 1):
        entry = struct.pack(">hhhh8s", 2 if c.is_text else 1, 0, c.width, i, c.name.encode("ascii").ljust(8))
        names += (entry + b" " * 48 + b"\0" * 20).ljust(84, b"\0") + struct.pack(">l", c.start) + b"\0" * 52
    return out + names + b" " * (-len(names) % _CARD) + _mark("OBS", _ZEROS)


def _base16(values: np.ndarray) -> np.ndarray:
    """Doubles as base-16 floating numbers of eight bytes; NaN and infinite values are missing."""
    usable = np.isfinite(values)
    part, power = np.frexp(np.where(usable, values, 0.0))
    places = -(-power // 4)
    if (np.abs(places) > 63).any():
        raise ValueError("a value is out of the range of transport files")
    whole = np.ldexp(np.abs(part), power - 4 * places + 56).astype(np.uint64)
    bits = whole | ((places + 64).astype(np.uint64) << np.uint64(56)) | (np.signbit(part).astype(np.uint64) << np.uint64(63))
    bits[part == 0] = 0
    bits[~usable] = ord(".") << 56
    return bits.astype(">u8").view(np.uint8).reshape(-1, 8)


def write_xport(df: DataFrame, folder: str, text_width: dict[str, int] | None = None) -> None:
    """Numbers and texts as transport files, one per partition with rows, each row of all columns.

    Texts are Latin-1 and padded to ``text_width`` (default: the longest value, one more pass); a
    longer one is an error, as is a name of more than eight characters. Files are written under
    temporary names and renamed when complete.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if too_long := [c for c in df.columns if len(c) > 8]:
        raise ValueError(f"names of more than eight characters: {too_long}")
    widths = dict(text_width or {})
    if unknown := [c for c in texts if c not in widths]:
        widths |= df.agg(*[F.max(F.length(c)).alias(c) for c in unknown]).first().asDict()
    columns, at = [], 0
    for f in df.schema.fields:
        width = max(1, widths[f.name] or 0) if f.name in widths else 8
        columns.append(_Column(f.name, f.name in texts, at, width))
        at += width
    if _store(folder) is None:
        raise ValueError(f"{folder}: a store that cannot be written from tasks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.xpt"
        file, size = None, 0
        for batch in batches:
            if not len(batch):
                continue
            if file is None:
                store.create_dir(base, recursive=True)
                file = store.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}.tmp")
                file.write(_header(columns))
            rows = np.empty((len(batch), at), dtype=np.uint8)
            for c in columns:
                if c.is_text:
                    cells = [(v or "").encode("latin1").ljust(c.width) for v in batch[c.name].to_pylist()]
                    if any(len(v) > c.width for v in cells):
                        raise ValueError(f"{c.name}: a text of more than {c.width} characters")
                    rows[:, c.start : c.start + c.width] = np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(-1, c.width)
                else:
                    values = batch[c.name].to_numpy(zero_copy_only=False).astype(np.float64)
                    rows[:, c.start : c.start + 8] = _base16(values)
            file.write(rows.tobytes())
            size += rows.nbytes
        if file is not None:
            file.write(b" " * (-size % _CARD))
            file.close()
            store.move(temporary, name)
        yield from ()

    numbers = [F.col(c) if c in texts else F.col(c).cast("double").alias(c) for c in df.columns]
    df.select(*numbers).mapInArrow(write, "done boolean").write.format("noop").mode("overwrite").save()


def convert_survey(spark: SparkSession, root: str, out: str) -> list[str]:
    """Decode every known component under ``root`` once, one Parquet table each.

    Returns the components that had a readable file.
    """
    done = []
    found = find_files(spark, root, "*.[xX][pP][tT]")
    for name in SURVEY_FILES:
        paths = [p for p in found if p.rsplit("/", 1)[-1].upper() == f"{name}.XPT"]
        table = read_xport(spark, paths) if paths else None
        if table is not None and table.columns:
            table.write.mode("overwrite").parquet(f"{out}/{name}")
            done.append(name)
    return done


def read_survey(spark: SparkSession, converted: str, names: Sequence[str]) -> DataFrame:
    """The converted components joined to one row per respondent of the base component."""
    return survey_join({n: spark.read.parquet(f"{converted}/{n}") for n in names})
