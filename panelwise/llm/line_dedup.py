"""Remove lines that other documents hold too, but for the first document that holds them.

Two Bloom filters say which lines may repeat: a key goes to the first filter when it is seen, and
to the second when the first already has it. Only lines in the second filter are shuffled; there
the keys themselves are compared, so a false alarm costs a row and never a line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import SPACE_CHARS, prepare, text_or_empty
from panelwise.session import written

PROBES = 5
BITS_PER_LINE = 10
#: A filter is cut into parts, which are merged apart from each other.
PARTS = 64
#: Filters are never larger than this (128 MB each), so they can be sent to every worker. Beyond
#: it, more lines are suspected than repeat, and the shuffle grows; results do not change.
MOST_BITS = 1 << 30

_SPACE = SPACE_CHARS.encode()


def line_keys(text: str) -> list[bytes]:
    """Each line without white space at its ends and with A-Z lower-cased."""
    return [line.strip(_SPACE).lower() for line in text.encode().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    # A character takes at most four bytes.
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)


def _different_keys(text: str, least: int) -> list[bytes]:
    return [k for k in dict.fromkeys(line_keys(text)) if _long_enough(k, least)]


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash: one part of the filter, and PROBES bits in it."""
    inside = np.uint64(bits // PARTS)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        probes = [(hashes + step * np.uint64(i * i + i + 1)) >> np.uint64(7) for i in range(PROBES)]
    part = (hashes % np.uint64(PARTS)) * inside
    return np.stack([part + p % inside for p in probes], axis=1)


def _test(filter_bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which rows have all their bits set."""
    return ((filter_bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _set(filter_bits: np.ndarray, places: np.ndarray) -> None:
    flat = np.unique(places.ravel())
    byte = (flat >> np.uint64(3)).astype(np.int64)
    at = np.flatnonzero(np.diff(byte, prepend=-1))
    if len(at):
        filter_bits[byte[at]] |= np.bitwise_or.reduceat(np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8), at)


def _add(once: np.ndarray, twice: np.ndarray, hashes: np.ndarray) -> None:
    """See each hash once more."""
    hashes, counts = np.unique(hashes, return_counts=True)
    places = _places(hashes, 8 * len(once))
    _set(twice, places[(counts > 1) | _test(once, places)])
    _set(once, places)


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def repeat_filter(docs: DataFrame, text: str, least: int) -> np.ndarray:
    """The filter of line keys seen twice or more.

    Each task fills its own pair over its rows; pairs are merged part by part: what two first
    filters have in common has been seen twice.
    """
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    lines = docs.agg(F.sum(breaks)).first()[0] or 0
    bits = min(MOST_BITS, 1 << max(16, int(lines * BITS_PER_LINE).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys = [k for x in batch.column(0).to_pylist() for k in _different_keys(x, least)]
            _add(once, twice, _hashes(keys))
        if once.any():
            packed = [[zlib.compress(x, 1) for x in np.split(f, PARTS)] for f in (once, twice)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *(pa.array(p, pa.binary()) for p in packed)], names=["part", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, *pair in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in pair)
                have = parts.setdefault(part, [np.zeros_like(once), np.zeros_like(once)])
                have[1] |= twice | (have[0] & once)
                have[0] |= once
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([zlib.compress(v[1], 1) for v in parts.values()], pa.binary())], names=["part", "twice"])

    filled = docs.select(text_or_empty(text)).mapInArrow(fill, "part int, once binary, twice binary")
    merged = filled.repartition(PARTS, "part").mapInArrow(merge, "part int, twice binary")
    found = np.zeros((PARTS, bits // 8 // PARTS), np.uint8)
    for row in merged.collect():  # at most MOST_BITS in all
        found[row["part"]] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return found.ravel()


def dedup_lines(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``key``, the columns ``carry`` in the struct ``carried``, ``n_lines``, ``n_dropped`` and ``kept``,
    the text without its dropped lines.

    A line's key has no white space at its ends and A-Z lower-cased. Keys of ``least`` characters
    or more that two documents hold lose all their lines but in the document with the smallest
    ``key``. A null or empty text is one empty line. Rows that share a ``key`` count as one
    document, each with its own lines; rows with a null key are one document after all others. What
    a row loses is found by its key and a hash of its text, so the rows of one key, however many,
    are spread and meet their own lines only.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[key].dataType
    twice = spark.sparkContext.broadcast(repeat_filter(docs, text, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in batches:
            keys, owner = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                mine = _different_keys(value, least)
                keys += mine
                owner += [i] * len(mine)
            hits = np.flatnonzero(_test(bits, _places(_hashes(keys), 8 * len(bits)))) if keys else []
            rows = pa.array([owner[i] for i in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array([keys[i] for i in hits], pa.binary())], names=["owner", "own", "line"])

    chosen = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"), F.struct(*carry, F.lit(None).cast("int").alias("_")).alias("carried"))
    chosen = chosen.withColumn("mark", F.xxhash64("text"))
    found = chosen.select("key", "text", "mark").mapInArrow(suspects, T.StructType([T.StructField("owner", kind), T.StructField("own", T.LongType()), T.StructField("line", T.BinaryType())]))
    found = written(found, "suspected-lines")
    # Written, so that the join can split a line that a large share of all documents holds.
    repeated = written(
        found.groupBy("line")
        .agg(F.min("owner").alias("first"), F.max("owner").alias("last"), F.max(F.isnull("owner")).alias("unnamed"))
        .where("first <> last or (unnamed and first is not null)")
        .select("line", "first"),
        "repeated-lines",
    )
    drops = (
        found.join(repeated, "line")
        .where(~F.col("owner").eqNullSafe(F.col("first")))
        .groupBy("owner", "own")  # lines of one text
        .agg(F.collect_set("line").alias("drops"))
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, dropped, kept = [], [], []
            for value, drop in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist()):
                lines = value.split("\n")
                drop = set(drop or ())
                stay = [line for line, k in zip(lines, line_keys(value)) if k not in drop] if drop else lines
                counts.append(len(lines))
                dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("carried"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["key", "carried", "n_lines", "n_dropped", "kept"],
            )

    schema = T.StructType([
        T.StructField("key", kind),
        T.StructField("carried", chosen.schema["carried"].dataType),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("kept", T.StringType()),
    ])
    joined = chosen.join(drops, F.col("key").eqNullSafe(F.col("owner")) & (F.col("mark") == F.col("own")), "left").select("key", "carried", "text", "drops")
    return joined.mapInArrow(rebuild, schema).select(F.col("key").alias(key), *(["carried"] if carry else []), "n_lines", "n_dropped", "kept")
