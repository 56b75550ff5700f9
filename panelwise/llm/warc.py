"""WARC archives: write pages as deterministic shards and read the records back.

Records are range-sorted by page, each is one gzip member, and files roll when their compressed
size is reached, so the same rows give the same bytes in the same files. Headers and digests are
made anew from the payload. A task writes under temporary names, renames its finished files, and
leaves a manifest of them; the archive as a whole is listed in ``manifest.json``, written last.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import commit_file, filesystem, partitions, prepare, temporary_name

#: The date of records whose capture time is not known; a clock would make reruns differ.
NO_DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --------------------------------------------------------------------------------------------
# records


def _written_key(key) -> str | None:
    return None if key is None else quote(str(key))


def _header_value(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _record_id(page: str | None, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}#{copy}')}>"


def record_bytes(page: str | None, copy: int, url: str | None, payload: bytes, digest: bytes, revisit: bool, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record; ``copy`` counts the rows of one page. A revisit carries the digest
    and size of the payload, not the payload."""
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page, copy),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _header_value(url),
        "WARC-Payload-Digest": "sha256:" + base64.b32encode(digest).decode().rstrip("="),
        "X-Page-Id": page,
        "X-Payload-Bytes": str(len(payload)),
    }
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head
    if revisit:
        headers["WARC-Profile"] = REVISIT_PROFILE
        headers["WARC-Refers-To"] = _record_id(refers_to)
        headers["X-Refers-To-Page-Id"] = refers_to
    else:
        block += payload
    headers["WARC-Block-Digest"] = "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode().rstrip("=")
    headers["Content-Type"] = "application/http; msgtype=response"
    headers["Content-Length"] = str(len(block))
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open, decompressed archive."""
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not at the start of a record")
        headers = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = file.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("record cut short")
        yield headers, block


# --------------------------------------------------------------------------------------------
# writing


def write_archive(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_revisit: int = 100,
    roll_bytes: int = 64 << 20,
    date: str = NO_DATE,
) -> list[dict]:
    """Write every page; returns the manifest, one entry per file.

    The payload is the html in UTF-8, null as empty. Of pages whose equal payload has at least
    ``least_revisit`` bytes, the one with the smallest ``key`` is a response and the others are
    revisits of it; of repeated rows with that key, the first is the response. A null key comes
    first in the order, but is no one's response while a page with a key has the payload. A null
    url is left out; other columns are not read. An empty table gives no file.
    """
    spark = prepare(pages.sparkSession)
    kind = pages.schema[key].dataType
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    facts = pages.select(F.col(key).alias("key"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("bytes"))
    facts = facts.where(F.col("bytes") >= least_revisit)
    # Copies are counted before they are shuffled; only payloads with a second page go on.
    repeated = facts.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("pages")).where("pages > 1")
    marks = facts.join(repeated, "digest").select("key", "digest", "first")
    rows = pages.select(
        F.col(key).alias("key"), F.lit(1).alias("kind"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(kind).alias("first")
    )
    notes = marks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "first").distinct()
    # Each page's marks lie just before it, so one sort brings both together.
    ranged = rows.unionByName(notes).repartitionByRange(partitions(spark), "key").sortWithinPartitions("key", "kind", "payload", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Roller(folder, TaskContext.get().partitionId(), roll_bytes)
        last, copies, marked, written = object(), 0, {}, set()
        for batch in batches:
            for k, kind, link, data, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if k != last:
                    last, copies, marked, written = k, 0, {}, set()
                if kind == 0:
                    marked[digest] = first
                    continue
                raw = hashlib.sha256(data).digest()
                first = marked.get(raw.hex())
                revisit = raw.hex() in marked and (first != k or raw in written)
                written.add(raw)
                writer.add(record_bytes(_written_key(k), copies, link, data, raw, revisit, _written_key(first) if revisit else None, date))
                copies += 1
        files = writer.finish()
        columns = [pa.array([f[c] for f in files], t) for c, t in (("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "records", "bytes", "sha256"])

    found = ranged.mapInArrow(run, "file string, records long, bytes long, sha256 string").collect()  # one row per file
    manifest = sorted((row.asDict() for row in found), key=lambda f: f["file"])
    with store.open_output_stream(temporary := temporary_name(f"{base}/manifest.json")) as file:
        file.write(json.dumps(manifest).encode())
    commit_file(store, temporary, f"{base}/manifest.json")
    return manifest


class _Roller:
    """Files of one range of pages, each begun when the one before has reached its size."""

    def __init__(self, folder: str, number: int, roll_bytes: int):
        self.store, self.base = filesystem(folder)
        self.number, self.roll_bytes = number, roll_bytes
        self.files: list[dict] = []
        self.out = None

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.store.create_dir(self.base, recursive=True)
            self.name = f"pages-{self.number:05d}-{len(self.files):05d}.warc.gz"
            self.temporary = temporary_name(f"{self.base}/{self.name}")
            self.out, self.digest, self.records, self.size = self.store.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        member = gzip.compress(record, compresslevel=6, mtime=0)
        self.out.write(member)
        self.digest.update(member)
        self.records += 1
        self.size += len(member)
        if self.size >= self.roll_bytes:
            self._close()

    def _close(self) -> None:
        self.out.close()
        commit_file(self.store, self.temporary, f"{self.base}/{self.name}")
        self.files.append({"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest()})
        self.out = None

    def finish(self) -> list[dict]:
        if self.out is not None:
            self._close()
        if self.files:
            name = f"{self.base}/part-{self.number:05d}.json"
            with self.store.open_output_stream(temporary := temporary_name(name)) as file:
                file.write(json.dumps(self.files).encode())
            commit_file(self.store, temporary, name)
        return self.files


# --------------------------------------------------------------------------------------------
# reading


class _Members:
    """A file of gzip members as one stream of bytes; reads a block at a time."""

    def __init__(self, file):
        self.file, self.inflate, self.rest, self.data, self.at = file, None, b"", b"", 0

    def _more(self) -> bool:
        self.rest = self.rest or self.file.read(1 << 20)
        if not self.rest:
            if self.inflate is not None:
                raise ValueError("archive cut short")
            return False
        self.inflate = self.inflate or zlib.decompressobj(31)
        self.data = self.data[self.at :] + self.inflate.decompress(self.rest)
        self.at = 0
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, None
        else:
            self.rest = b""
        return True

    def read(self, size: int) -> bytes:
        while len(self.data) - self.at < size and self._more():
            pass
        got = self.data[self.at : self.at + size]
        self.at += len(got)
        return got

    def readline(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0 and self._more():
            pass
        return self.read(end + 1 - self.at if end >= 0 else len(self.data) - self.at)


def read_archive(spark: SparkSession, folder: str, manifest: list[dict], kind: T.DataType) -> DataFrame:
    """One row per record: ``page_id`` of type ``kind``, ``url``, ``record_type``, ``payload`` (null
    for revisits), ``payload_bytes`` and ``payload_digest`` of the full payload, ``refers_to``, and
    ``intact``: whether the stored payload has that digest."""
    prepare(spark)
    wanted = ["X-Page-Id", "WARC-Target-URI", "WARC-Type", "X-Payload-Bytes", "WARC-Payload-Digest", "X-Refers-To-Page-Id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as file:
                    rows, held = [], 0
                    for headers, block in read_records(_Members(file)):
                        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
                        said = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2] + "====")
                        said_of = [headers.get(name) for name in wanted]
                        said_of[0], said_of[5] = (None if x is None else unquote(x) for x in (said_of[0], said_of[5]))
                        rows.append([*said_of, payload, said.hex(), payload is None or hashlib.sha256(payload).digest() == said])
                        held += len(block)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows))
        names = ["page", "url", "record_type", "bytes", "labelled", "refers", "payload", "payload_digest", "intact"]
        types = [pa.string()] * 6 + [pa.binary(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    files = spark.createDataFrame([(f["file"],) for f in manifest], "file string").repartition(max(1, len(manifest)))
    schema = "page string, url string, record_type string, bytes string, labelled string, refers string, payload binary, payload_digest string, intact boolean"
    return files.mapInArrow(read, schema).select(
        F.col("page").cast(kind).alias("page_id"), "url", "record_type", "payload", F.col("bytes").cast("bigint").alias("payload_bytes"), "payload_digest", F.col("refers").cast(kind).alias("refers_to"), "intact"
    )
