"""Token ids in binary shards, and a minimal perfect hash index over their document keys.

``write_shards`` sorts the documents by key over the cluster and writes, per range of keys,

* ``shard-NNNNN.ids``  the ids of its documents one after another, little-endian, 2 bytes each if
  the vocabulary allows it, else 4;
* ``shard-NNNNN.idx``  a minimal perfect hash from the shard's keys to slots, and per slot the key's
  fingerprint and its rows in the payload.

``manifest.json`` lists the shards in order with the ids before each. ``read_documents`` finds a
key by its shard's key range, one hash and one comparison of fingerprints, whatever the number of
documents, and reads only that document's bytes.
"""

from __future__ import annotations

import io
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelwise.llm.common import commit_file, filesystem, partitions, prepare, temporary_name, text_or_empty

#: Bytes of pieces that a worker remembers twice over (see ``_Remembered``), what an entry takes
#: besides its key and value, and how many new pieces are encoded together.
PIECE_BYTES, ENTRY_BYTES, TOGETHER = 100 << 20, 160, 4096
#: Texts that are cut at a time: few, so that their pieces stay in the processor's cache.
GROUP = 8
#: Bits per key and level of the hash: fewer levels against less room.
ROOM = 2.0

# --------------------------------------------------------------------------------------------
# ids of texts

# The steps of a tokenizer whose pieces can be cut here, and what its pattern says of
# the first 256 characters, lower-cased: contractions, letters, digits, and runs of all else.
_STEPS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_LATIN = re.compile("[\x00-\xff]*")


class _Remembered(dict):
    """Ids by piece. At ``limit`` bytes the entries are put aside; those that are asked for again
    come back, the others go with the next change."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.bytes, self.old = limit, 0, {}

    def put(self, key: str, value: bytes) -> None:
        self.bytes += len(key) + len(value) + ENTRY_BYTES
        self[key] = value

    def make_room(self) -> None:
        if self.bytes > self.limit:
            self.old, self.bytes = dict(self), 0
            self.clear()

    def recall(self, keys: set[str]) -> list[str]:
        """Bring back what was put aside; the keys that are not remembered."""
        missing = []
        for key in keys:
            value = self.old.get(key)
            if value is None:
                missing.append(key)
            else:
                self.put(key, value)
        return missing


class TextIds:
    """Ids of texts, as little-endian bytes.

    The tokenizer drops white space, and none of its steps looks across the pieces that its pattern
    cuts a text into, so the ids of a text are those of its pieces. Texts of the first 256
    characters are cut here, and what is new in a batch is encoded as one text, whose ids are cut
    after every token that ends a word. In other texts this is done word by word, and words with
    other characters are encoded each by itself. Other tokenizers encode whole texts.
    """

    def __init__(self, tokenizer: str, width: int):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.encode_special_tokens = True
        self.dtype, self.width = f"<u{width}", width
        spec = json.loads(tokenizer)
        pre, normalizer = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        splits = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])]
        kinds = [n["type"] for n in normalizer.get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        self.cut_here = bool(suffix) and kinds == _STEPS and splits[:1] == [_PATTERN]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.pieces = _Remembered(PIECE_BYTES)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.cut_here:
            return [self._encode(text) for text in texts]
        self.pieces.make_room()
        return [ids for at in range(0, len(texts), GROUP) for ids in self._group(texts[at : at + GROUP])]

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [_PIECES.findall(text.lower()) if _LATIN.fullmatch(text) else self._cut_words(text) for text in texts]
        get = self.pieces.get
        found = [list(map(get, pieces)) for pieces in cut]
        missing: set[str] = set()
        for pieces, ids in zip(cut, found):
            if None in ids:
                missing.update([p for p, i in zip(pieces, ids) if i is None])
        self._learn(self.pieces.recall(missing))
        return [b"".join(ids if None not in ids else map(self.pieces.__getitem__, pieces)) for pieces, ids in zip(cut, found)]

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _cut_words(self, text: str) -> list[str]:
        """Pieces, and whole words with other characters; these are marked by a space before them."""
        out: list[str] = []
        for word in text.encode().split():
            word = word.decode()
            if _LATIN.fullmatch(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(f" {word}")
        return out

    def _learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            if piece[0] == " ":
                self.pieces.put(piece, self._encode(piece[1:]))
        todo = [piece for piece in pieces if piece[0] != " "]
        for at in range(0, len(todo), TOGETHER):
            part = todo[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end every piece with a token of its own")
            data, begin = ids.astype(self.dtype).tobytes(), 0
            for piece, end in zip(part, ends.tolist()):
                self.pieces.put(piece, data[begin:end])
                begin = end


_encoders: dict[tuple[str, int], TextIds] = {}  # of this worker


def _encoder_of(tokenizer: str, width: int) -> TextIds:
    if (tokenizer, width) not in _encoders:
        _encoders[tokenizer, width] = TextIds(tokenizer, width)
    return _encoders[tokenizer, width]


# --------------------------------------------------------------------------------------------
# minimal perfect hash


def key_hashes(keys: list) -> np.ndarray:
    """Two independent 64-bit hashes of each key (null included), as columns: one places the key,
    the other is its fingerprint."""
    data = bytearray()
    for key in keys:
        if isinstance(key, (date, datetime)):
            key = key.isoformat()
        data += xxhash.xxh3_128_digest(key if isinstance(key, bytes) else repr(key).encode())
    return np.frombuffer(bytes(data), dtype="<u8").reshape(-1, 2)


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes[:, 0] + hashes[:, 1] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key sits at the first level where no other key left shares its place, and
    its slot is the number of bits set before. n different keys get the slots 0 to n - 1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(hashes):
            if len(sizes) > 60:
                raise ValueError("two keys have the same 128-bit hash")
            size = 64 * max(1, int(np.ceil(ROOM * len(hashes) / 64)))
            places = _places(hashes, len(sizes), size)
            alone = np.bincount(places, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            hashes = hashes[~alone[places]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key; -1, or any slot, for a key that is not in the set."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            place = base + _places(hashes[left], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[left[here]] = self.before[place[here] >> 6] + np.bitwise_count(below)
            left, base = left[~here], base + size
        return found


def _index_bytes(keys: list, lengths: list[int]) -> bytes:
    """The index of one shard; rows with the same key lie together."""
    first = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
    hashes = key_hashes([keys[i] for i in first])
    table = PerfectHash.build(hashes)
    slot = table.slots(hashes)
    by_slot = np.empty((3, len(first)), dtype="<u8")
    by_slot[:, slot] = hashes[:, 1], first, np.diff([*first, len(keys)])
    out = io.BytesIO()
    np.savez(out, sizes=np.array(table.sizes, "<i8"), words=table.words, slots=by_slot, ends=np.cumsum([0, *lengths], dtype="<i8"))
    return out.getvalue()


# --------------------------------------------------------------------------------------------
# writing


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> list[dict]:
    """Encode and write all documents in ascending order of ``key``; returns the manifest's shards.

    A null text is empty, a null key comes first. Rows that share a key follow each other, by text.
    An empty table has no shard. Other columns are not read. Each task streams one range of keys to
    its files and gives them their names at the end, so a lost executor's work is simply repeated;
    the driver sees one row per shard.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    vocabulary = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    width = 2 if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(spec)  # of the tokenizer's constant size
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        encoder = _encoder_of(shared.value, width)
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        name = f"{base}/shard-{TaskContext.get().partitionId():05d}"
        keys: list = []
        lengths: list[int] = []
        out = None
        for batch in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(temporary := temporary_name(f"{name}.ids"))
            keys += batch.column(0).to_pylist()
            for ids in encoder.texts(batch.column(1).to_pylist()):
                payload = ids + end
                lengths.append(len(payload) // width)
                out.write(payload)
        if out is None:
            return
        out.close()
        commit_file(store, temporary, f"{name}.ids")
        with store.open_output_stream(temporary := temporary_name(f"{name}.idx")) as index:
            index.write(_index_bytes(keys, lengths))
        commit_file(store, temporary, f"{name}.idx")
        row = [TaskContext.get().partitionId(), len(keys), sum(lengths), keys[0], keys[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int64(), pa.int64(), batch.column(0).type, batch.column(0).type])], names=["shard", "rows", "ids", "first", "last"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("first", kind), T.StructField("last", kind)])
    chosen = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    order = ["key", F.xxhash64("text"), "text"]
    ranged = chosen.repartitionByRange(partitions(spark), *order[:2]).sortWithinPartitions(*order)
    shards, start = [], 0
    for row in sorted(ranged.mapInArrow(run, schema).collect(), key=lambda r: r["shard"]):
        shards.append(row.asDict() | {"start": start, "width": width})
        start += row["ids"]
    with store.open_output_stream(f"{base}/manifest.json") as file:
        file.write(json.dumps(shards, default=str).encode())
    return shards


# --------------------------------------------------------------------------------------------
# reading


class Shard:
    """One shard's index in memory and its payload, open for reading."""

    def __init__(self, folder: str, shard: dict):
        store, base = filesystem(folder)
        name = f"{base}/shard-{shard['shard']:05d}"
        with store.open_input_file(f"{name}.idx") as file, np.load(io.BytesIO(file.read())) as index:
            self.table = PerfectHash(index["sizes"].tolist(), index["words"])
            self.fingerprints, self.first, self.rows = index["slots"]
            self.ends = index["ends"]
        self.payload = store.open_input_file(f"{name}.ids")
        self.width = shard["width"]

    def find(self, keys: list) -> Iterator[tuple[int, int]]:
        """Position in ``keys`` and row in the shard, of each row that has one of the keys."""
        hashes = key_hashes(keys)
        slots = self.table.slots(hashes)
        slots[(slots >= 0) & (self.fingerprints[slots] != hashes[:, 1])] = -1
        for i, slot in enumerate(slots.tolist()):
            if slot >= 0:
                for row in range(int(self.first[slot]), int(self.first[slot] + self.rows[slot])):
                    yield i, row

    def ids(self, row: int) -> np.ndarray:
        begin, end = int(self.ends[row]), int(self.ends[row + 1])
        return np.frombuffer(self.payload.read_at((end - begin) * self.width, begin * self.width), dtype=f"<u{self.width}")


def read_documents(keys: DataFrame, folder: str, shards: list[dict], key: str = "doc_id") -> DataFrame:
    """The stored rows of each different key: ``key``, ``start`` (ids of all documents before it),
    ``n_tokens``, and ``ids`` as little-endian unsigned 32-bit integers.

    Keys that are not stored are left out; null is a key. Keys are sent to the shards whose range
    holds them; a key's rows are read wherever they lie.
    """
    spark = prepare(keys.sparkSession)
    rank = lambda v: (v is not None, v)  # noqa: E731  null comes first
    first, last = [rank(s["first"]) for s in shards], [rank(s["last"]) for s in shards]
    kind = keys.schema[key].dataType

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            spans = [(bisect_left(last, rank(v)), bisect_right(first, rank(v))) for v in values]
            at = [i for i, (low, high) in enumerate(spans) for _ in range(low, high)]
            number = [n for low, high in spans for n in range(low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32())], names=["key", "number"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            for n in np.unique(numbers):
                if n != number:
                    number, shard = n, Shard(folder, shards[n])
                mine = batch.column(0).filter(pa.array(numbers == n))
                found = list(shard.find(mine.to_pylist()))
                ids = [shard.ids(row) for _, row in found]
                starts = [shards[n]["start"] + int(shard.ends[row]) for _, row in found]
                yield pa.RecordBatch.from_arrays(
                    [mine.take(pa.array([i for i, _ in found], pa.int64())), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    names=["key", "start", "n_tokens", "ids"],
                )

    routed = keys.select(F.col(key).alias("key")).distinct().mapInArrow(route, T.StructType([T.StructField("key", kind), T.StructField("number", T.IntegerType())]))
    by_shard = routed.repartition(max(1, len(shards)), "number").sortWithinPartitions("number", "key")
    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return by_shard.mapInArrow(read, schema).withColumnRenamed("key", key)
