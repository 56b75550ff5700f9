"""Language identification: features beside plain Python, accuracy on texts it has not seen."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import language

FOLDER = "/root/testdata/sf0.01"
SMALL = language.Settings(dimensions=1 << 12, per_language=50, iterations=10)


def plain_counts(text, dimensions):
    data = f" {text.lower()} ".encode()
    out = bytearray()
    for b in data:
        b = b if b >= 128 or chr(b).isalpha() else 32
        if not (b == 32 and out and out[-1] == 32):
            out.append(b)
    counts = Counter()
    for order in language.ORDERS:
        for i in range(len(out) - order + 1):
            code = out[i]
            for b in out[i + 1 : i + order]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            counts[(code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - dimensions.bit_length() + 1)] += 1
    return [counts[i] for i in range(dimensions)]


@pytest.mark.parametrize("text", ["", "a", "The quick, brown fox!!  12", "ÉTÉ à l'été", "日本 🙂", "\n\n"])
def test_counts(text, monkeypatch):
    expected = plain_counts(text, 512)
    assert language.group_counts(text, 512).tolist() == expected
    for piece in (1, 2, 3, 5):  # groups that cross the pieces of a long text
        monkeypatch.setattr(language, "PIECE", piece)
        assert language.group_counts(text, 512).tolist() == expected


def test_families():
    assert language.family_of("en-US") == language.family_of("de") == "germanic"
    assert language.family_of("es") == "romance"
    assert language.family_of("tlh") == "tlh"


def plain_decision(model, text):
    """Family by likelihood, then duels, written out."""
    x = [math.sqrt(c / max(1, sum(counts))) for counts in [plain_counts(text, model.dimensions)] for c in counts]
    score = [sum(a * w for a, w in zip(x, model.weights[:, k])) + model.offsets[k] for k in range(model.weights.shape[1])]
    n = len(model.families)
    family = max(range(n), key=lambda k: score[k])
    share = 1 / sum(math.exp(s - score[family]) for s in score[:n])
    wins, sums, chances = Counter(), Counter(), {m: [] for m in model.families[family][1]}
    for (a, b), margin in zip(model.pairs, score[n:]):
        if a in chances:
            wins[a if margin > 0 else b] += margin != 0
            sums[a] += margin
            sums[b] -= margin
            chances[a].append(1 / (1 + math.exp(-2 * margin)))
            chances[b].append(1 / (1 + math.exp(2 * margin)))
    best = min(chances, key=lambda m: (-wins[m], -sums[m], m))
    return best, share * (sum(chances[best]) / len(chances[best]) if chances[best] else 1)


def test_decisions():
    r = np.random.default_rng(1)
    families = [("germanic", ["de", "en", "nl"]), ("romance", ["es", "fr"]), ("tlh", ["tlh"])]
    pairs = [("de", "en"), ("de", "nl"), ("en", "nl"), ("es", "fr")]
    model = language.LanguageModel(families, pairs, r.normal(size=(512, 7)), r.normal(size=7), 512)
    seen = set()
    for i in range(60):
        text = "".join(r.choice(list("abcdefgh  éü"), 40))
        got, expected = model.predict(text), plain_decision(model, text)
        assert got[0] == expected[0] and abs(got[1] - expected[1]) < 1e-9 and 0 <= got[1] <= 1
        seen.add(got[0])
    assert len(seen) > 2


def test_ties_go_to_the_first_name():
    model = language.LanguageModel([("germanic", ["en", "de"])], [("en", "de")], np.zeros((512, 2)), np.zeros(2), 512)
    assert model.predict("text") == ("de", 0.5)


def test_fitted_weights_rank_their_own_texts(spark):
    """The written-out decision with the fitted model gives the query's predictions."""
    rows = [(i, t * 5, lang) for i, (t, lang) in enumerate([("the and of ", "en"), ("der und die ", "de"), ("le et les ", "fr"), ("el los y ", "es")] * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.select("lang", "text"), SMALL)
    got = {r["carried"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(df, F.lit(True), settings=SMALL).collect()}
    for doc, text, lang in rows:
        expected = plain_decision(model, text)
        assert got[doc][0] == expected[0] == lang and abs(got[doc][1] - expected[1]) < 1e-6


def test_awkward_rows(awkward, awkward_rows, nothing):
    """Nulls, texts without letters, a very long text, repeated rows, columns named as results."""
    rows = awkward.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = language.predict_language(rows, F.lit(True), settings=SMALL).collect()
    assert len(got) == len(awkward_rows)
    texts = {}
    for doc, text, *_ in awkward_rows:
        texts.setdefault(doc, []).append(text)
    for r in got:
        assert 0 <= r["score"] <= 1
        own = texts[r["carried"]["doc_id"]]
        assert r["lang_pred"] in {"und" if not any(c.isalpha() for c in t or "") else "en" for t in own}
    assert language.predict_language(nothing, F.lit(True), settings=SMALL).count() == 0
    alone = language.predict_language(rows, F.lit(False), settings=SMALL).collect()
    assert {(r["lang_pred"], r["score"]) for r in alone} == {("und", 0.0)} and len(alone) == len(awkward_rows)


def test_too_many_languages(spark):
    df = spark.createDataFrame([(i, "text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.predict_language(df, F.lit(True), settings=language.Settings(languages=3))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    from panelwise.llm.queries import QUERIES

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op12_language_id"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert len(held) > 200 and right >= 0.98 * len(held)
