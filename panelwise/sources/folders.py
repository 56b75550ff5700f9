"""Small files and names in the stores that Spark reads: listing, pointers, renames."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def arrow_store(path: str) -> tuple[fs.FileSystem, str] | None:
    """The store of a path or URI for use in tasks, and the path in it; None if only Spark can open it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError):
        return None


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, store = _store(spark, path)
    return store.exists(target)


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of the last change) of what lies in a folder; no file is opened."""
    target, store = _store(spark, path)
    if not store.exists(target):
        return []
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in store.listStatus(target)]


def read_small(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if it does not exist."""
    target, store = _store(spark, path)
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Give a small file new text in one step: readers see the old text or the new one."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    target, store = _store(spark, temporary)
    stream = store.create(target)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(target, jvm.org.apache.hadoop.fs.Path(path), options)


def remove(spark: SparkSession, path: str) -> None:
    target, store = _store(spark, path)
    store.delete(target, True)


def move(spark: SparkSession, path: str, new: str) -> None:
    """Give a file or folder a new place; the folders above it are made."""
    target, store = _store(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(new)
    store.mkdirs(place.getParent())
    if not store.rename(target, place):
        raise OSError(f"{path} could not be moved to {new}")
