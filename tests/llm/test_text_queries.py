"""The registered text queries beside their SQL, or plain Python, on the smallest test tables."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import connect, difference
from panelwise.llm import byte_bpe
from panelwise.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    types = {row[0]: row[1] for row in database.execute(f"DESCRIBE {SQL[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert difference(df.toPandas(), database.execute(SQL[name]).df()) is None


def test_token_files(spark, documents):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words.encode_special_tokens = True
    got = {r["doc_id"]: r for r in QUERIES["op1_token_files"](spark, FOLDER).collect()}
    start = 0
    for doc in documents:
        ids = words.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        row = got[doc["doc_id"]]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_byte_bpe(spark, documents):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in QUERIES["op8_byte_bpe"](spark, FOLDER).collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    for doc in documents:
        ids = library.encode_ordinary(doc["text"] or "")
        row = got[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids)).encode()), digest((doc["text"] or "").encode()))


def test_byte_bpe_has_offsets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = encoded.select("doc_id", F.xxhash64("starts", "ends")).collect()
    got = QUERIES["op8_byte_bpe"](spark, FOLDER).select("doc_id", "offsets_hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected))


def test_mixing(spark, documents):
    got = QUERIES["op2_mixing"](spark, FOLDER).toPandas()
    source = {d["doc_id"]: d["source"] for d in documents}
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    assert (got["size"] == got["doc_id"].map(size)).all() and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby(got["doc_id"].map(source), dropna=False).agg(size=("size", "sum"), stated=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["stated"]).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    assert ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"] + 4).all()


def test_toxicity_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no larger tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op9_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    toxic, clean = got[got["toxic"] == 1], got[got["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.85 and clean["predicted"].mean() < 0.02


# --------------------------------------------------------------------------------------------
# pipeline


def test_stages_on_awkward_documents(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).where("not intact").count() == 0


def test_stages_on_nothing(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_stages_keep_what_they_should(spark):
    words = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    first = " ".join(words("a", 100))
    rows = [(1, first, "en", "s", 0), (2, first + " more", "en", "s", 0), (3, " ".join(words("b", 100)), None, None, 0), (4, "too short", "en", "s", 0), (5, " ".join(words("c", 80)) + "\n" + first, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stages["quality_rules"](spark, docs, FOLDER)) == [1, 2, 3, 5]
    lines = {r["doc_id"]: r for r in stages["drop_repeated_lines"](spark, docs, FOLDER).collect()}
    assert lines[5]["text"] == " ".join(words("c", 80)) and lines[5]["n_chars"] == len(lines[5]["text"]) and lines[1]["text"] == first
    assert ids(stages["drop_near_copies"](spark, docs, FOLDER)) == [1, 3, 4, 5]
    twice = docs.unionByName(docs.where("doc_id = 1"))
    assert ids(stages["drop_near_copies"](spark, twice, FOLDER)) == [1, 3, 4, 5]


def test_one_row_of_each_group_of_near_copies(spark):
    base = " ".join(f"a{i}" for i in range(100))
    near, lone = base + " more", " ".join(f"b{i}" for i in range(90))
    rows = [(5, base), (5, near), (5, base), (5, lone), (9, near), (None, lone + " x"), (None, "c d e"), (None, "C d e"), (None, ""), (None, ""), (None, None), (7, " \n"), (7, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["drop_near_copies"](spark, docs, FOLDER).collect()]
    assert sum(r in ((5, base), (5, near)) for r in got) == 1 and (9, near) not in got
    assert got.count((5, lone)) == 1 and (None, lone + " x") not in got
    assert sum(r in ((None, "c d e"), (None, "C d e")) for r in got) == 1
    assert sorted(map(repr, (r for r in got if not (r[1] or "").strip()))) == sorted(map(repr, rows[-5:]))


def test_boilerplate_of_a_large_source_goes(spark):
    """A line in 3 % of a source with nearly all rows, and texts made of little else."""
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    common = " ".join(f"common{j}" for j in range(70))
    rows = [(i, f"{common}\n{own(i, 60)}", "en", "hot", 0) for i in range(40)] + [(40, f"{common}\nfew words", "en", "hot", 0)]
    rows += [(i, own(i, 60), "en", "hot", 0) for i in range(100, 1400)] + [(i, f"{common}\n{own(i, 60)}", "en", "small", 0) for i in range(2000, 2020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, FOLDER).collect()}
    assert got[0] == rows[0][1] and all(got[i] == own(i, 60) for i in range(1, 40))
    assert 40 not in got and len(got) == len(rows) - 1
    assert all(common in got[i] for i in range(2000, 2020))  # 20 texts are not over the limit


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    row = out.agg(F.count("*").alias("n"), F.count_if(~F.col("intact")).alias("broken"), F.sum("n_tokens").alias("tokens")).first()
    assert row["n"] > 100 and row["broken"] == 0 and row["tokens"] > 10_000
