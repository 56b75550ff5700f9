"""Language of texts: the family first, then the languages of the family against each other.

Features are hashed groups of two to four bytes of the lower-cased text, without what is no letter;
a text's vector holds the square roots of their shares, so that long and short texts weigh alike.

* a naive Bayes model over families;
* for every two languages of a family a linear support vector machine; the language that wins the
  most duels is predicted.

The models are fitted on a bounded sample of labelled texts; every text of the table is predicted,
by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, NaiveBayes
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import prepare, text_or_empty
from panelwise.operators.ranking import bounded_rows
from panelwise.session import written

# Languages by family. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "finnic": ("et", "fi"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "malayic": ("id", "ms"),
}

UNDETERMINED = "und"
_LETTER = r"\p{L}"

#: Bytes that are read at a time; groups that cross a piece's end are read with the next.
PIECE = 1 << 20
ORDERS = (2, 3, 4)
_SPACE = 32
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else _SPACE for b in range(256)], dtype=np.uint32)


@dataclass(frozen=True)
class Settings:
    """``per_language`` texts of each language, chosen by hash, are learned from; more than
    ``languages`` languages are refused."""

    dimensions: int = 1 << 15
    per_language: int = 1000
    languages: int = 100
    penalty: float = 1e-4
    iterations: int = 30
    smoothing: float = 0.1


def family_of(language: str) -> str:
    base = language.lower().replace("_", "-").split("-")[0]
    return next((name for name, members in FAMILIES.items() if base in members), language)


def group_counts(text: str, dimensions: int) -> np.ndarray:
    """How often each hashed group of bytes is in a text."""
    counts = np.zeros(dimensions, dtype=np.int64)
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    last = np.full(0, _SPACE, dtype=np.uint32)
    for at in range(0, len(data), PIECE):
        piece = np.concatenate([last, _LETTERS[data[at : at + PIECE]]])
        space = piece == _SPACE
        keep = np.ones(len(piece), dtype=bool)
        keep[1:] = ~(space[1:] & space[:-1])
        piece = piece[keep]
        code = piece[:-1]
        for order in ORDERS:
            # Groups that lie in what was left over alone were counted with the piece before.
            if len(piece) < order:
                break
            code = code[: len(piece) - order + 1] * np.uint32(0x01000193) ^ piece[order - 1 :]
            fresh = code[max(0, len(last) - order + 1) :]
            counts += np.bincount((fresh * np.uint32(0x9E3779B1)) >> shift, minlength=dimensions)
        last = piece[-(max(ORDERS) - 1) :]
    return counts


def vector(text: str, dimensions: int) -> np.ndarray:
    """Square roots of the shares of the groups; its length is 1."""
    counts = group_counts(text, dimensions)
    return np.sqrt(counts / max(1, counts.sum()))


@dataclass
class LanguageModel:
    """``families`` with the languages of each; columns of ``weights`` (and ``offsets``) are first
    the families' log likelihoods, then the machines of ``pairs``, positive for the first."""

    families: list[tuple[str, list[str]]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    offsets: np.ndarray
    dimensions: int

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score: the share of the family, times the mean chance of the language's
        duels. Ties go to the larger sum of margins, then to the first name."""
        return self.decide(vector(text, self.dimensions) @ self.weights + self.offsets)

    def decide(self, scores: np.ndarray) -> tuple[str, float]:
        n = len(self.families)
        share = np.exp(scores[:n] - scores[:n].max())
        share /= share.sum()
        best = int(np.argmax(share))
        members = self.families[best][1]
        duels: dict[str, list[float]] = {m: [] for m in members}
        for (a, b), margin in zip(self.pairs, scores[n:].tolist()):
            if a in duels and b in duels:
                duels[a].append(margin)
                duels[b].append(-margin)
        wins = lambda m: (sum(x > 0 for x in duels[m]), sum(duels[m]))
        language = max(sorted(members), key=wins)
        chance = 1 / (1 + np.exp(-2 * np.array(duels[language]))) if duels[language] else np.ones(1)
        return language, float(min(1.0, share[best] * chance.mean()))


def learning_sample(labelled: DataFrame, settings: Settings) -> DataFrame:
    """(lang, text): about ``per_language`` rows of each language, by a hash of the text."""
    found = bounded_rows(labelled.groupBy("lang").agg(F.count("*").alias("n")), settings.languages)
    if found is None:
        raise ValueError(f"more than {settings.languages} languages")
    if not found:
        return labelled
    span = 1 << 30
    limits = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(span, span * settings.per_language // r["n"]))])
    # Copies of a text share its hash: what tells them apart is where they were read.
    drawn = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(span))
    return labelled.where(drawn < limits[F.col("lang")])


def fit(labelled: DataFrame, settings: Settings = Settings()) -> LanguageModel | None:
    """A model of the rows (lang, text), all with a letter and a language; None without rows."""

    @F.udf(VectorUDT())
    def features(text: str) -> SparseVector:
        x = vector(text, settings.dimensions)
        at = np.flatnonzero(x)
        return SparseVector(settings.dimensions, at, x[at])

    sample = written(learning_sample(labelled, settings).select("lang", features("text").alias("features")), "language-sample")
    known = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # at most settings.languages
    if not known:
        return None
    by_family: dict[str, list[str]] = {}
    for language in known:
        by_family.setdefault(family_of(language), []).append(language)
    families = sorted(by_family.items())
    number = {language: i for i, (_, members) in enumerate(families) for language in members}
    pairs = [p for _, members in families for p in combinations(members, 2)]
    weights = np.zeros((settings.dimensions, len(families) + len(pairs)))
    offsets = np.zeros(weights.shape[1])
    numbered = F.create_map(*[F.lit(x) for item in number.items() for x in item])
    if len(families) > 1:
        rows = sample.withColumn("label", numbered[F.col("lang")].cast("double"))
        bayes = NaiveBayes(smoothing=settings.smoothing).fit(rows)
        weights[:, : len(families)] = bayes.theta.toArray().T
        offsets[: len(families)] = 0.0  # every family is as likely before its text is read
    for i, (a, b) in enumerate(pairs, len(families)):
        rows = sample.where(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == a).cast("double"))
        machine = LinearSVC(regParam=settings.penalty, maxIter=settings.iterations, standardization=False).fit(rows)
        weights[:, i], offsets[i] = machine.coefficients.toArray(), machine.intercept
    return LanguageModel(families, pairs, weights, offsets, settings.dimensions)


def predict_language(
    docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",), settings: Settings = Settings()
) -> DataFrame:
    """``carried`` (the columns ``carry``), ``lang_pred`` and ``score`` (0 to 1) of every row.

    Learns from the rows where ``learn_from`` is true, ``lang`` not null and ``text`` with a letter;
    ``lang`` is read for nothing else. A null text and one without a letter are ``und`` with score 0,
    and so is every text if there is nothing to learn from. Copies, repeated ids and null ids are
    rows like others and get the prediction of their text; other columns are not read. The model
    sent to the tasks has a number for each of its dimensions and machines.
    """
    spark = prepare(docs.sparkSession)
    letters = F.coalesce(F.col(text).rlike(_LETTER), F.lit(False))
    labelled = docs.where(learn_from & F.col(lang).isNotNull() & letters).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    model = fit(labelled, settings)
    chosen = docs.select(F.struct(*carry).alias("carried"), F.when(letters, text_or_empty(text)).alias("text"))
    if model is None:
        return chosen.select("carried", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [(UNDETERMINED, 0.0) if t is None else model.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["carried", "lang_pred", "score"])

    return chosen.mapInArrow(run, chosen.select("carried").schema.add("lang_pred", "string").add("score", "double"))
