"""What the text operators share: settings, files in the shared folder, expressions for words."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from panelwise.session import configure, shared_folder

#: White space that separates words, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows that Spark hands to Python at a time; a text may be long, so few.
BATCH_ROWS = 256
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Run-time settings for rows that hold whole texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for one set of files, in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def commit_file(store: fs.FileSystem, temporary: str, path: str) -> None:
    """Give a finished file its name. A second attempt at the same task writes the same bytes, so
    it does not matter whose file stays."""
    store.move(temporary, path)


def temporary_name(path: str) -> str:
    return f"{path}.{uuid.uuid4().hex}.tmp"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text that is not null."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")
