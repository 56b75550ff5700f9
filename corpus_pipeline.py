"""From raw documents to token ids: filter, drop repeated lines and near copies, mix, encode.

Every stage is a function of (spark, docs, sf_dir). All but the last return the columns of
``documents``; where a stage changes a text, ``n_chars`` follows it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import byte_bpe, line_dedup, minhash, mixing, quality
from panelwise.llm.common import WORD, text_or_empty
from panelwise.session import written


def _same_columns(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs``, as carried along, with a new text."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return df.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that their source repeats. A line
    is repeated if more than 20 texts of the source hold it, however large the source is."""
    judged = quality.apply_rules(docs, share=0.0, carry=_others(docs))
    return _same_columns(judged.where("kept"), docs, F.col("cleaned"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds."""
    return _same_columns(line_dedup.dedup_lines(docs, carry=_others(docs)), docs, F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.
    Texts without words are no copies and all stay."""
    found = minhash.near_duplicates(docs, minhash.Settings(words=5, percent=80))
    kept = found.where("first and n_shingles > 0").select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct()
    words = text_or_empty("text").rlike(WORD)
    own = docs.where(words).withColumn("__own", F.xxhash64("text"))
    one = own.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__content")), "left_semi")
    return one.dropDuplicates(["doc_id", "__own"]).select(*docs.columns).unionByName(docs.where(~words))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, a hash of their offsets, and whether decoding the ids
    gives the text back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    keyed = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content")).alias("key"), "text")
    encoded = byte_bpe.encode(keyed, ranks, public_tokenizers.PATTERN, key="key")
    decoded = byte_bpe.decode(encoded.select(F.struct("key.*", "ids", F.xxhash64("starts", "ends").alias("offsets_hash")).alias("key"), "ids"), ranks, key="key")
    return decoded.select("key.doc_id", F.size("key.ids").cast("bigint").alias("n_tokens"), "key.ids", "key.offsets_hash", (F.xxhash64("text") == F.col("key.content")).alias("intact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("drop_repeated_lines", drop_repeated_lines),
    ("drop_near_copies", drop_near_copies),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Seeded hashes and learned merges are not SQL; the rows of run() are compared with the same five
#: stages in plain Python instead (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
