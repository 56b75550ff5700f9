"""Text tables: delimited files with a header, and bulk dumps without one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.columns import nan_as_null
from panelwise.session import written

# Separators tried in this order, and the marks of the dump format.
SEPARATORS = ("\t", "~@@~", "~@~", ",")
DUMP_FIELD = "~@~"
DUMP_RECORD = "~@@~\n"
DUMP_NULL = "\\N"

_BAD, _PATH = "__bad_line", "__path"


def header_line(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """First line of the first file; None if there is none."""
    row = spark.read.text(paths[0]).first()
    return None if row is None else row[0]


def find_separator(header: str) -> str:
    """The first separator that cuts the header line; a comma if none does."""
    return next((s for s in SEPARATORS if s in header), SEPARATORS[-1])


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    separator: str | None = None,
    with_path: bool = False,
) -> DataFrame:
    """Files with one header line each, matched to the schema by name, without regard to case.

    Lines with too many fields are skipped, missing trailing fields are null, as is a cell that
    does not fit its type. Without a schema the types are inferred (one more pass). Paths that do
    not exist give an empty table.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        header = header_line(spark, paths) if paths else None
    except AnalysisException:
        header = None
    if header is None:
        return spark.createDataFrame([], schema or T.StructType())
    separator = separator or find_separator(header)
    names = [n.strip().strip('"') for n in header.lstrip("﻿").split(separator)]
    if schema is None:
        reader = spark.read.option("header", True).option("sep", separator)
        return nan_as_null(reader.option("inferSchema", True).option("mode", "DROPMALFORMED").csv(paths))
    lines = _permissive(spark, paths, names, separator)
    fields = F.size(F.split(F.col(_BAD), _literal(separator)))
    fitting = lines.where(F.col(_BAD).isNull() | (fields <= len(names)))
    return _typed(fitting, schema, {n.lower(): n for n in names}, with_path)


def read_with_rejects(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, separator: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows that ``read_delimited`` gives, and what was wrong: (file, line, reason, row_kept).

    A line with too many fields is rejected; a cell that does not fit its type is null in the row,
    which is kept. The files are read once: rows and reasons are written together and both tables
    read from there. An empty cell is no error. Paths that do not exist give two empty tables.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rejects = "file string, line string, reason string, row_kept boolean"
    try:
        header = header_line(spark, paths) if paths else None
    except AnalysisException:
        header = None
    if header is None:
        return spark.createDataFrame([], schema), spark.createDataFrame([], rejects)
    separator = separator or find_separator(header)
    names = [n.strip().strip('"') for n in header.lstrip("\ufeff").split(separator)]
    lines = _permissive(spark, paths, names, separator).select("*", F.col("_metadata.file_path").alias(_PATH))
    fields = F.size(F.split(F.col(_BAD), _literal(separator)))
    too_many = F.col(_BAD).isNotNull() & (fields > len(names))
    reasons = [F.when(too_many, F.concat(F.lit("too many fields: "), fields, F.lit(f" of {len(names)}")))]
    by_name = {n.lower(): n for n in names}
    cells = {f.name: F.col(f"`{by_name[f.name.lower()]}`") for f in schema.fields if f.name.lower() in by_name}
    for f in schema.fields:
        if f.name in cells and f.dataType != T.StringType():
            misfit = cells[f.name].isNotNull() & cells[f.name].try_cast(f.dataType).isNull()
            said = F.concat(F.lit(f"{f.name}: '"), cells[f.name], F.lit(f"' is no {f.dataType.simpleString()}"))
            reasons.append(F.when(~too_many & misfit, said))
    text = F.coalesce(F.col(_BAD), F.concat_ws(separator, *[F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in names]))
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    marked = lines.select(
        F.struct(*_typed_cells(schema, by_name)).alias("row"), too_many.alias("rejected"), F.struct(F.col(_PATH).alias("file"), F.when(F.size(found) > 0, text).alias("line"), found.alias("reasons")).alias("wrong")
    )
    stored = written(marked, "scanned")
    kept = nan_as_null(stored.where("not rejected").select("row.*"))
    wrong = stored.where(F.size("wrong.reasons") > 0).select("wrong.file", "wrong.line", F.explode("wrong.reasons").alias("reason"), (~F.col("rejected")).alias("row_kept"))
    return kept, wrong


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def _permissive(spark: SparkSession, paths: list[str], names: list[str], separator: str) -> DataFrame:
    """All lines below the headers as texts; one that has more or fewer fields is also whole."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (
        spark.read.schema(text.add(_BAD, T.StringType()))
        .option("header", True)
        .option("sep", separator)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .csv(paths)
    )


def _typed_cells(schema: T.StructType, names: dict[str, str]) -> list[Column]:
    columns = []
    for f in schema.fields:
        source = names.get(f.name.lower())
        cell = F.col(f"`{source}`") if source else F.lit(None).cast("string")
        columns.append((cell if f.dataType == T.StringType() else cell.try_cast(f.dataType)).alias(f.name))
    return columns


def _typed(rows: DataFrame, schema: T.StructType, names: dict[str, str], with_path: bool) -> DataFrame:
    columns = _typed_cells(schema, names)
    if with_path:
        columns.append(F.col("_metadata.file_path").alias(_PATH))
    return nan_as_null(rows.select(*columns))


def read_dump(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType,
    with_path: bool = False,
) -> DataFrame:
    """Dump files: fields in schema order, no header, own marks for field, record and null.

    The text source splits a large file at the record mark, so one file is read by many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], schema)
    records = spark.read.option("lineSep", DUMP_RECORD).text(paths)
    cells = F.split(F.col("value"), _literal(DUMP_FIELD))
    named = [
        F.when(F.get(cells, F.lit(i)) != F.lit(DUMP_NULL), F.get(cells, F.lit(i))).alias(f.name)
        for i, f in enumerate(schema.fields)
    ]
    extra = [F.col("_metadata.file_path").alias(_PATH)] if with_path else []
    rows = records.where(F.length(F.trim("value")) > 0).select(*named, *extra)
    typed = [
        (F.col(f.name) if f.dataType == T.StringType() else F.col(f.name).try_cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return nan_as_null(rows.select(*typed, *([_PATH] if with_path else [])))


def dump_lines(df: DataFrame) -> DataFrame:
    """Rows in the dump format, one ``value`` per record without its end mark."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(DUMP_NULL)) for c in df.columns]
    return df.select(F.concat(F.concat_ws(DUMP_FIELD, *cells), F.lit(DUMP_FIELD)).alias("value"))


def write_dump(df: DataFrame, path: str) -> None:
    dump_lines(df).write.mode("overwrite").option("lineSep", DUMP_RECORD).text(path)
