"""Toxic passages: runs of words that speak for toxicity more than chance allows.

``learn`` counts words over the whole corpus and over labelled texts, and gives each word the log
odds between toxic and clean texts under a Dirichlet prior whose shape is the corpus. ``passages``
finds every maximal run of positive total in time linear in the words. How high such a total gets
by chance follows an extreme-value law; its two constants come from the clean texts. A text's
score is a logistic function of how far its passages exceed that law.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import prepare, text_or_empty
from panelwise.session import written

#: Words of texts that a task holds before it hands their counts on.
HELD = 1 << 19
#: Weight of the prior as a share of the toxic counts; standard errors a word's log odds must
#: exceed; the cost of each word, which keeps passages short.
PRIOR_SHARE, ERRORS, DRIFT = 0.5, 2.0, 0.2
#: The highest mean of the fitted chance law that still counts a passage as beyond chance.
SIGNIFICANT = 0.05
REMEMBERED = 150_000

_WORD = re.compile(r"[^\W_]+")


class _Keys(dict):
    """The 63 bits by which each word is known; of this worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word.encode()) >> 1
        return key


_keys = _Keys()


def word_keys(text: str) -> np.ndarray:
    """Key of each word of a text, lower-cased."""
    return np.fromiter(map(_keys.__getitem__, _WORD.findall(text.lower())), dtype=np.int64)


@dataclass(frozen=True)
class Scores:
    """Scores of words by their sorted keys; all other words have -DRIFT."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words), -DRIFT, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, self.values[at], np.float32(-DRIFT))


@dataclass(frozen=True)
class Model:
    """Scores of words, and the law of the best passage by chance: of n words it exceeds s with
    probability ``1 - exp(-k * n * exp(-decay * s))``."""

    scores: Scores
    decay: float
    k: float


# --------------------------------------------------------------------------------------------
# learning


def count_words(docs: DataFrame) -> DataFrame:
    """In how many texts each word is: ``word`` (its key), ``every`` for all texts, ``toxic`` and
    ``clean`` for labelled ones. ``docs`` has ``text`` and ``toxic`` (null: not labelled). A text
    that repeats a word counts once, so one odd text cannot make its words toxic.

    Tasks add up a bounded number of words at a time, and Spark the rest.
    """

    def packed(words: list[np.ndarray], kinds: list[int]) -> pa.RecordBatch:
        word, at = np.unique(np.concatenate(words), return_inverse=True)
        kind = np.repeat(kinds, [len(w) for w in words])
        counts = [np.bincount(x, minlength=len(word)) for x in (at, at[kind == 1], at[kind == 0])]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (word, *counts)], names=["word", "every", "toxic", "clean"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds, held = [], [], 0
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.append(np.unique(word_keys(text)))
                kinds.append(-1 if toxic is None else 1 if toxic else 0)
                held += len(words[-1])
                if held >= HELD:
                    yield packed(words, kinds)
                    words, kinds, held = [], [], 0
        if held:
            yield packed(words, kinds)

    each = docs.select("text", "toxic").mapInArrow(count, "word long, every long, toxic long, clean long")
    return each.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("every", "toxic", "clean")))


def word_scores(counts: DataFrame) -> tuple[Scores, np.ndarray]:
    """Log odds of toxic against clean, less ERRORS standard errors (0 if that changes the sign),
    less DRIFT, and the clean counts of the same words. The prior is spread like the corpus.

    Only words with a score of their own come to the driver: those of the labelled texts, which
    are bounded, and those whose prior alone exceeds its error; the prior adds up to a share of the
    toxic counts, so these are fewer still. Nothing comes without labels of both kinds.
    """
    totals = [float(n or 0) for n in counts.agg(*(F.sum(c) for c in ("every", "toxic", "clean"))).first()]
    n_every, n_toxic, n_clean = totals
    if not (n_toxic and n_clean):
        return Scores(np.zeros(0, np.int64), np.zeros(0, np.float32)), np.zeros(0)
    weight = max(1.0, PRIOR_SHARE * n_toxic)
    share = weight / n_every * F.col("every")
    alone = F.abs(F.log(n_clean + weight - share) - F.log(n_toxic + weight - share)) > ERRORS * F.sqrt(2 / share)
    found = counts.where((F.col("toxic") + F.col("clean") > 0) | alone).toArrow().sort_by("word")
    keys, every, toxic, clean = (found[c].to_numpy() for c in ("word", "every", "toxic", "clean"))
    prior = weight * every / n_every
    odds = lambda c, n: np.log(c + prior) - np.log(n + weight - c - prior)
    delta = odds(toxic, n_toxic) - odds(clean, n_clean)
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    sure = np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0)
    return Scores(keys, (sure - DRIFT).astype(np.float32)), clean.astype(np.float64)


def decay_of(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``sum(p * exp(x * score)) = 1``, p the words of clean texts."""
    used = counts > 0
    if not (scores[used] > 0).any():
        return 1.0  # no word can start a passage
    values, at = np.unique(scores[used].astype(np.float64), return_inverse=True)
    share = np.bincount(at, weights=counts[used]) / counts.sum()
    low, high = 1e-9, 1.0
    total = lambda x: float((share * np.exp(np.minimum(x * values, 700.0))).sum())
    while total(high) < 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return high


# --------------------------------------------------------------------------------------------
# passages


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring runs, as (first, after last, total), in linear time.

    Neighbouring words of positive score are taken together. A run in hand looks for the nearest
    run before it that starts lower; if that also ends lower, the two and all between become one
    run, which looks again. Each run remembers what it found, so no run is passed twice.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    runs: list[tuple[int, int, float, float, int]] = []  # first, after, total before, total after, found
    for first, after in zip(edge[::2].tolist(), edge[1::2].tolist()):
        before, reached = total[first], total[after]
        at = len(runs) - 1
        while True:
            while at >= 0 and runs[at][2] >= before:
                at = runs[at][4]
            if at < 0 or runs[at][3] >= reached:
                break
            first, before = runs[at][0], runs[at][2]
            del runs[at:]
            at -= 1
        runs.append((first, after, before, reached, at))
    return [(first, after, reached - before) for first, after, before, reached, _ in runs]


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("total", T.DoubleType())]))


def passages(docs: DataFrame, scores: Scores, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words`` and ``passages``: every maximal run of a text, as first and last
    character (end exclusive) and total. A null or empty text has none."""
    table = docs.sparkSession.sparkContext.broadcast(scores)  # of words in a bounded number of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for value in batch.column(1).to_pylist():
                words = word_keys(value)
                segments = maximal_segments(table.value.of(words))
                if segments:
                    spans = [m.span() for m in _WORD.finditer(value)]
                    # Lower case may change how a rare letter counts; then ends are of words.
                    same = len(spans) == len(words)
                    segments = [(spans[a][0] if same else a, spans[b - 1][1] if same else b, s) for a, b, s in segments]
                counts.append(len(words))
                found.append([dict(zip(("start", "end", "total"), s)) for s in segments])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("total", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["key", "n_words", "passages"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("passages", PASSAGES)])
    return docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def _best() -> Column:
    return F.coalesce(F.array_max(F.transform("passages", lambda p: p["total"])), F.lit(0.0))


def chance(total: Column, n_words: Column, model: Model) -> Column:
    """How many passages as high a text of that many words has by chance."""
    return model.k * F.greatest(n_words, F.lit(1)) * F.exp(-model.decay * total)


def _with_features(found: DataFrame, model: Model) -> DataFrame:
    beyond = lambda p: F.greatest(-F.log(chance(p["total"], F.col("n_words"), model)), F.lit(0.0))
    return found.withColumns({
        "f_best": F.least(-F.log(chance(_best(), F.col("n_words"), model)), F.lit(50.0)),
        "f_all": F.log1p(F.aggregate(F.transform("passages", beyond), F.lit(0.0), lambda a, x: a + x)),
        "f_many": F.log1p(F.size(F.filter("passages", lambda p: chance(p["total"], F.col("n_words"), model) <= SIGNIFICANT)).cast("double")),
    })


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    most_labelled: int = 200_000,
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``passages`` (each with ``significant``) and
    ``score``, the fitted probability that it is toxic.

    ``labels`` has ``key`` and ``label``; of them, only rows for which ``learn_from`` (over the
    key) holds are read, and of more than ``most_labelled`` labelled documents about so many, chosen by
    hash, so that their keys can be sent to every task. A document with several labels is toxic if
    one says so. The words of all documents shape the prior; nothing but the text reaches a score. Null or empty texts have the
    score of a text without passages. Without labels of both kinds, every score is the share of
    toxic ones, and 0.5 without any. Repeated rows and null keys are scored like others; other
    columns are not read.
    """
    prepare(docs.sparkSession)
    known = labels.where(learn_from & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(label).alias("toxic"))
    known = written(known, "training-labels")
    fraction = most_labelled / max(1, known.count())
    known = F.broadcast(known.where(F.pmod(F.xxhash64("of"), F.lit(1 << 30)) < fraction * (1 << 30)))
    texts = docs.select(F.col(key).alias("of"), text_or_empty(text).alias("text")).join(known, "of", "left")
    scores, clean_counts = word_scores(written(count_words(texts), "word-counts"))
    found = written(passages(docs, scores, key, text), "passages")
    decay = decay_of(scores.values, clean_counts)

    training = found.join(known, F.col(key) == F.col("of")).select("n_words", "passages", F.col("toxic").cast("double").alias("toxic"))
    clean = training.where("toxic = 0").agg(F.count("*").alias("n"), F.sum(F.greatest("n_words", F.lit(1)) * F.exp(-decay * _best())).alias("expected")).first()
    model = Model(scores, decay, clean["n"] / clean["expected"] if clean["n"] else 1.0)

    features = ["f_best", "f_all", "f_many"]
    share = training.agg(F.avg("toxic")).first()[0]
    marked = _with_features(found, model)
    if share is None or share in (0.0, 1.0):
        scored = marked.withColumn("score", F.lit(0.5 if share is None else share))
    else:
        to_vector = VectorAssembler(inputCols=features, outputCol="features")
        sample = to_vector.transform(_with_features(training, model)).select("features", "toxic")
        fitted = LogisticRegression(labelCol="toxic", regParam=1e-3, maxIter=50).fit(sample)
        scored = fitted.transform(to_vector.transform(marked)).withColumn("score", vector_to_array("probability")[1])
    significant = F.transform("passages", lambda p: p.withField("significant", chance(p["total"], F.col("n_words"), model) <= SIGNIFICANT))
    return scored.select(key, "n_words", significant.alias("passages"), "score")
