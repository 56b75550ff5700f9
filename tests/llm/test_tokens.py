"""Token files and byte-level BPE beside the libraries' own results."""

from __future__ import annotations

import base64
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelwise.llm import byte_bpe, token_files
from panelwise.llm.common import filesystem, new_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        hashes = token_files.key_hashes(list(range(n)))
        table = token_files.PerfectHash.build(hashes)
        assert sorted(table.slots(hashes).tolist()) == list(range(n))


def test_perfect_hash_rejects_equal_keys():
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(token_files.key_hashes([1, 1]))


def test_files_hold_every_document(spark, awkward, awkward_rows, words):
    folder = new_folder(spark, "tokens")
    shards = token_files.write_shards(awkward, folder, WORDS, end_id=2)
    stored = token_files.read_documents(awkward, folder, shards).orderBy("start").collect()
    assert len(stored) == len(awkward_rows)
    expected = [(r[0], words.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in awkward_rows]
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in stored]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    keys = [r["doc_id"] for r in stored]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    ends = np.cumsum([r["n_tokens"] for r in stored])
    assert [r["start"] for r in stored] == [0, *ends[:-1].tolist()]


def test_absent_keys_are_not_found(spark, awkward):
    folder = new_folder(spark, "tokens")
    shards = token_files.write_shards(awkward, folder, WORDS)
    keys = spark.range(50, 3000).withColumnRenamed("id", "doc_id")
    found = {r["doc_id"] for r in token_files.read_documents(keys, folder, shards).collect()}
    assert found == set(range(77, 101))


def test_files_are_the_same_again(spark, awkward):
    def contents():
        folder = new_folder(spark, "tokens")
        token_files.write_shards(awkward, folder, WORDS, 2)
        store, base = filesystem(folder)
        from pyarrow import fs

        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base)))
        return names, [zlib.crc32(store.open_input_file(f"{base}/{n}").read()) for n in names if n.endswith(".ids")]

    first = contents()
    assert first == contents() and not any(n.endswith(".tmp") for n in first[0])


def test_empty_table_has_no_shard(spark, nothing):
    folder = new_folder(spark, "tokens")
    assert token_files.write_shards(nothing, folder, WORDS, 2) == []
    assert token_files.read_documents(nothing, folder, []).count() == 0


HARD = [
    "It's Émile's naïve co-op, 3.14²½ ßÿ ﬁ ǅ", "á Å İ Σίσυφος ΟΔΟΣ", "don't I'LL 'tis '' ''s \"' !'s 's't", "<|endoftext|> x y z <|startoftext|>a",
    "日本語 가각 é", "a\u00a0b\u2003c \x85 \x1c\x1d \x00", "🙂🙃 a🙂b", "ÀÉÎ ñandú. µªº×÷ ¼¾¹", "x" * 3000 + "! ?!", "e\u0301x \u0301 a\u200d \ufeff", "", " \n ", "a.b,c d... 12ab",
]


@pytest.mark.parametrize("room", [100 << 20, 0, 2000])
def test_pieces_give_the_ids_of_the_text(words, room, monkeypatch):
    """Whatever is remembered: all, nothing from one batch to the next, or some of it."""
    monkeypatch.setattr(token_files, "PIECE_BYTES", room)
    encoder = token_files.TextIds(words.to_str(), 2)
    assert encoder.cut_here
    pick = random.Random(2)
    pool = [w for text in HARD for w in text.split(" ")]
    mixed = [pick.choice([" ", "\n", "  "]).join(pick.choice(pool) for _ in range(pick.randrange(25))) for _ in range(120)]
    for texts in (HARD, mixed, HARD[::-1], mixed[:50]):
        for text, own in zip(texts, encoder.texts(texts), strict=True):
            assert np.frombuffer(own, "<u2").tolist() == words.encode(text, add_special_tokens=False).ids


def test_every_latin_character(words):
    encoder = token_files.TextIds(words.to_str(), 2)
    texts = [form.format(chr(c)) for c in range(256) for form in ("{0}", "a{0}b", "{0}{0}'s1{0}", "1{0}.{0}'{0}")]
    for text, own in zip(texts, encoder.texts(texts)):
        assert np.frombuffer(own, "<u2").tolist() == words.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_encode_whole_texts():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    encoder = token_files.TextIds(library.to_str(), 2)
    assert not encoder.cut_here
    for text, own in zip(HARD, encoder.texts(HARD)):
        assert np.frombuffer(own, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_bpe_is_the_library(spark, awkward, awkward_rows, library):
    encoded = byte_bpe.encode(awkward, RANKS, public_tokenizers.PATTERN)
    got = encoded.collect()
    expected = sorted(repr((r[0], library.encode_ordinary(r[1] or ""))) for r in awkward_rows)
    assert sorted(repr((r["doc_id"], list(r["ids"]))) for r in got) == expected
    decoded = byte_bpe.decode(encoded, RANKS).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in decoded) == sorted(repr((r[0], r[1] or "")) for r in awkward_rows)


def test_byte_bpe_on_every_character(spark, library):
    texts = [(i, "".join(f"{chr(c)}a{chr(c)}{chr(c)} {chr(c)}1" for c in range(i * 512, i * 512 + 512) if not 0xD800 <= c < 0xE000)) for i in range(0x110000 // 512)]
    got = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), RANKS, public_tokenizers.PATTERN, offsets=False).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in got} == {i: library.encode_ordinary(t) for i, t in texts}


def test_offsets_are_characters(spark, library):
    text = "né 日本 🙂 x\n\n"
    row = byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first()
    for token, start, end in zip(row["ids"], row["starts"], row["ends"]):
        piece = library.decode_single_token_bytes(token)
        assert piece in text[start:end].encode()
        assert len(text[start:end].encode()) < len(piece) + 4
    assert row["starts"][0] == 0 and row["ends"][-1] == len(text)


def test_decode_odd_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [60_000]), (4, []), (5, [None]), (6, [187])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in byte_bpe.decode(rows, RANKS).collect()}
    assert got[1] == '!"' and got[2] is None and got[3] is None and got[4] == "" and got[5] is None
    assert got[6] == "�"


def test_byte_bpe_of_nothing(nothing):
    encoded = byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN)
    assert encoded.count() == 0 and byte_bpe.decode(encoded, RANKS).count() == 0


def test_manifest(spark, awkward):
    folder = new_folder(spark, "tokens")
    shards = token_files.write_shards(awkward, folder, WORDS, 2)
    store, base = filesystem(folder)
    saved = json.loads(store.open_input_file(f"{base}/manifest.json").read())
    assert [s["ids"] for s in saved] == [s["ids"] for s in shards] and saved[0]["width"] == 2
