"""Saved stages: tables, reports and reuse of fresh results.

A stage is a folder with one subfolder per version and a small file that names the current one. A
version is complete before it is named, and naming it is one rename: a write that fails or is killed
leaves the stage as it was, and a reader that has begun keeps the version it began with.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.operators.quality import table_fingerprint
from panelwise.sources.folders import list_folder, read_small, remove, replace_small

_POINTER = "CURRENT"
#: Versions of a stage that are kept: the current one, and what a reader may still be at.
KEPT_VERSIONS = 2


def _commit(df: DataFrame, path: str, write) -> None:
    spark = df.sparkSession
    name = f"version-{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{name}")
    except BaseException:
        remove(spark, f"{path}/{name}")
        raise
    replace_small(spark, f"{path}/{_POINTER}", name)
    versions = sorted(p for p, _, _ in list_folder(spark, path) if p.rsplit("/", 1)[-1].startswith("version-"))
    for old in versions[:-KEPT_VERSIONS]:
        remove(spark, old)


def stage_path(spark: SparkSession, path: str) -> str | None:
    """Folder of a stage's current version; None if none was committed."""
    name = read_small(spark, f"{path}/{_POINTER}")
    return None if name is None else f"{path}/{name}"


def save_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A new version of a stage as Parquet, or as CSV under a header."""
    writer = df.write.partitionBy(*partition_by)
    _commit(df, path, writer.option("header", True).csv if kind == "csv" else writer.parquet)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage that must exist."""
    version = stage_path(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed stage in {path}")
    return spark.read.parquet(version)


def load_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stage that may be missing: then an empty table of the schema."""
    version = stage_path(spark, path)
    return spark.createDataFrame([], schema) if version is None else spark.read.parquet(version)


def save_report(df: DataFrame, path: str) -> None:
    """A result table as JSON lines."""
    _commit(df, path, df.write.json)


def load_report(spark: SparkSession, path: str) -> DataFrame:
    version = stage_path(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed report in {path}")
    return spark.read.json(version)


# --------------------------------------------------------------------------------------------
# reports


def report_entries(results: dict[str, DataFrame]) -> DataFrame | None:
    """(name, entry) of all result tables, one JSON text per row; None without tables."""
    parts = [df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("entry")) for name, df in results.items()]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def final_report(
    spark: SparkSession,
    settings: dict[str, float],
    results: dict[str, DataFrame],
    summary: dict[str, str],
) -> DataFrame:
    """One row: time, settings, summary, and each (small) result table as an array of JSON texts.

    The tables are folded into the row where they lie: first the rows of each table, then the
    tables by name. Nothing of them passes through the driver. An empty table is an empty array.
    """
    head = spark.createDataFrame(
        [(datetime.now(timezone.utc), settings, summary)], "created_at timestamp, settings map<string,double>, summary map<string,string>"
    )
    names = spark.createDataFrame([(name,) for name in results], "name string")
    entries = report_entries(results)
    if entries is None:
        return head.withColumn("results", F.create_map().cast("map<string,array<string>>"))
    folded = entries.groupBy("name").agg(F.array_sort(F.collect_list("entry")).alias("rows"))
    every = names.join(folded, "name", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<string>")))
    table = every.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "rows")))).alias("results"))
    return head.join(table)  # one row each


# --------------------------------------------------------------------------------------------
# reuse

_MARK = "path string, bytes bigint, changed bigint, schema string, digest string"


def _is_plain_scan(df: DataFrame) -> bool:
    """Whether the frame is the files themselves, with nothing done to them."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


def _file_states(df: DataFrame) -> dict[str, tuple[int, int]]:
    """Bytes and time of the last change of a frame's files, by path, from their folders' listings."""
    files = {_plain(p) for p in df.inputFiles()}
    folders = sorted({p.rsplit("/", 1)[0] for p in files})
    listed = [entry for folder in folders for entry in list_folder(df.sparkSession, folder)]
    return {_plain(p): (size, changed) for p, size, changed in listed if _plain(p) in files}


def _plain(path: str) -> str:
    path = unquote(path)
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _file_digests(df: DataFrame, paths: list[str]) -> dict[str, str]:
    """Content digest of each of the files: a hash per row, whatever their order. Only these files
    are read."""
    source = F.col("_metadata.file_path")
    wanted = {p for p in df.inputFiles() if _plain(p) in set(paths)}
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    rows = df.where(source.isin(sorted(wanted))).select(source.alias("path"), row.alias("h"))
    sums = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))
    digests = sums.select("path", F.md5(F.concat_ws("|", "n", "x", "s")).alias("digest"))
    found = {_plain(r["path"]): r["digest"] for r in digests.collect()}  # one row per file
    return {p: found.get(p, "no rows") for p in paths}


def input_mark(df: DataFrame, folder: str) -> str:
    """A digest of an input's schema and rows.

    For a plain scan of files it is made of one digest per file, which is kept with the file's size
    and time of change: files that have not changed are not read again, and none is if all are as
    they were. Other frames are read.
    """
    if not _is_plain_scan(df):
        return table_fingerprint(df).first()["fingerprint"]
    spark, schema = df.sparkSession, df.schema.simpleString()
    states = _file_states(df)
    try:
        marks = spark.read.schema(_MARK).json(f"{folder}/marks").where(F.col("schema") == schema).collect()
    except AnalysisException:
        marks = []
    known = {(m["path"], m["bytes"], m["changed"]): m["digest"] for m in marks}
    fresh = [p for p, state in states.items() if (p, *state) not in known]
    if fresh:
        digests = _file_digests(df, fresh)
        rows = [(p, *states[p], schema, digests[p]) for p in fresh]
        spark.createDataFrame(rows, _MARK).write.mode("append").json(f"{folder}/marks")
        known |= {(p, *states[p]): digests[p] for p in fresh}
    tree = json.dumps([schema, sorted(known[p, *state] for p, state in states.items())])
    return hashlib.md5(tree.encode()).hexdigest()


def reuse(df: DataFrame, inputs: list[DataFrame], name: str, folder: str, ttl_hours: float = 24.0) -> DataFrame:
    """A stored copy of ``df`` if one is fresh for the same inputs, else a new one.

    Copies are keyed by the name and the marks of the inputs (``input_mark``): inputs that are
    unchanged files are not read. A log entry is written after the copy is complete, so an
    interrupted write is never read.
    """
    spark = df.sparkSession
    marks = [input_mark(i, folder) for i in inputs]
    key = "-".join([name, *marks])
    log = f"{folder}/log"
    now = datetime.now(timezone.utc)
    try:
        fresh = (
            spark.read.schema("key string, path string, created_at timestamp")
            .json(log)
            .where((F.col("key") == key) & (F.col("created_at") > F.lit(now - timedelta(hours=ttl_hours))))
            .orderBy(F.desc("created_at"))
            .first()
        )
    except AnalysisException:
        fresh = None
    if fresh is not None:
        return spark.read.parquet(fresh["path"])
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.createDataFrame([(key, path, now)], "key string, path string, created_at timestamp").write.mode(
        "append"
    ).json(log)
    return spark.read.parquet(path)
