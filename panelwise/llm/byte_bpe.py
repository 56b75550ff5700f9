"""Byte-level BPE: encode whole texts to ids with character offsets, and decode ids to bytes.

The merges of a rank file are given to the ``tokenizers`` library as a BPE model over the usual
byte alphabet, where each of the 256 bytes is one printable character. A text is cut by the
pattern, and each different piece is merged once per worker: pieces repeat so much that looking
ids up costs less than merging again.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from panelwise.llm.common import prepare, text_or_empty

#: Pieces a worker remembers; then it starts afresh.
REMEMBERED = 150_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Texts of these characters only can be cut with the pattern's classes written out.
_PLAIN = re.compile(rf"[\x00-\x1b\x20-\x7f{_LETTERS}]*")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last two parts of a token when only earlier merges are applied; None if it cannot be
    built by merges."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            return None
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_text(ranks: dict[bytes, int]) -> str:
    """The BPE model of the ranks, as the library's JSON."""
    alphabet = byte_characters()

    def written(token: bytes) -> str:
        return "".join(alphabet[b] for b in token)

    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1 and (pair := _halves(token, ranks)):
            merges.append((written(pair[0]), written(pair[1])))
    # A piece that is a token is that token even where merges would not reach it.
    model = BPE(vocab={written(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    return Tokenizer(model).to_str()


class _Pieces(dict):
    """Ids of pieces, as the bytes of 32-bit integers; a missing piece is merged."""

    def __init__(self, model: str):
        super().__init__()
        self.model = Tokenizer.from_str(model).model
        self.table = dict(enumerate(byte_characters()))

    def __missing__(self, piece: str) -> bytes:
        mapped = piece.encode().decode("latin-1").translate(self.table)
        ids = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<i4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


_pieces: dict[str, _Pieces] = {}  # of this worker, by the model


def _pieces_of(model: str) -> _Pieces:
    if model not in _pieces:
        _pieces[model] = _Pieces(model)
    return _pieces[model]


def _cutters(pattern: str):
    """The pattern, and the same for plain texts if it is the usual one."""
    from public_tokenizers import PATTERN

    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full, full
    # Letters come first: no other branch begins like them, so the order does not matter.
    plain = rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"
    return full, re.compile(plain).findall


def _encoder(model: str, lengths: bytes, pattern: str, offsets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces_of(model)
        full, plain = _cutters(pattern)
        width = np.frombuffer(lengths, dtype="<i4")
        for batch in batches:
            found, spans = [], []
            for text in batch.column(1).to_pylist():
                cut = plain if _PLAIN.fullmatch(text) else full
                ids = b"".join(map(known.__getitem__, cut(text)))
                found.append(ids)
                if offsets:
                    spans.append(_character_spans(text, np.frombuffer(ids, dtype="<i4"), width))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype="<i4")
            lists = [np.frombuffer(b"".join(found), dtype="<i4")]
            if offsets:
                lists += [np.concatenate([s[i] for s in spans]) if spans else np.zeros(0, "<i4") for i in (0, 1)]
            columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, type=pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "ids", "starts", "ends"][: 1 + len(columns)])

    return run


def _character_spans(text: str, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and the one after the last, of each token; tokens that share a split
    character each span it."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    after = np.cumsum(width[ids])
    return character[after - width[ids]].astype("<i4"), (character[after - 1] + 1).astype("<i4")


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    offsets: bool = True,
) -> DataFrame:
    """One row per document: ``key``, ``ids`` and, if wanted, ``starts`` and ``ends`` of each token
    in characters (end exclusive).

    A null or empty text has empty lists. Repeated rows and null keys are encoded like any other;
    other columns are not read. Nothing is shuffled, and a task holds one small batch of texts.
    The driver reads the rank file (of constant size) and ships it to the workers.
    """
    spark = prepare(docs.sparkSession)
    ranks = read_ranks(ranks_path)
    size = np.zeros(max(ranks.values()) + 1, dtype="<i4")
    for token, rank in ranks.items():
        size[rank] = len(token)
    model = spark.sparkContext.broadcast((model_text(ranks), size.tobytes()))

    def run(batches):
        return _encoder(*model.value, pattern, offsets)(batches)

    lists = ["ids", "starts", "ends"] if offsets else ["ids"]
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists)])
    chosen = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ids: ``key``, the ``bytes`` they stand for, and these as ``text``.

    Bytes are joined before they are read as UTF-8, so characters split over tokens come back
    whole; bytes that are no UTF-8 become U+FFFD in ``text`` only. A list that is null, or that
    holds null or an id that the rank file lacks, gives null.
    """
    spark = prepare(encoded.sparkSession)
    tokens = spark.sparkContext.broadcast({rank: token for token, rank in read_ranks(ranks_path).items()})

    def joined(row: pa.ListScalar) -> bytes | None:
        if not row.is_valid or row.values.null_count:
            return None
        try:
            return b"".join(map(tokens.value.__getitem__, row.values.to_numpy().tolist()))
        except KeyError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [joined(row) for row in batch.column(1)]
            texts = [None if x is None else x.decode("utf-8", "replace") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(texts, pa.string())], names=["key", "bytes", "text"])

    schema = T.StructType([T.StructField("key", encoded.schema[key].dataType), T.StructField("bytes", T.BinaryType()), T.StructField("text", T.StringType())])
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)
