"""Near duplicates, mixtures, top-k, archives and toxicity beside plain Python."""

from __future__ import annotations

import heapq
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwise.llm import minhash, mixing, topk, toxicity, warc
from panelwise.llm.common import filesystem, new_folder

SPACE = " \t\n\x0b\x0c\r"


# --------------------------------------------------------------------------------------------
# near duplicates


def plain_components(rows, words, percent):
    sets = []
    for _, text, *_ in rows:
        tokens = (text or "").encode().lower().split()
        runs = {tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} if len(tokens) >= words else {tuple(tokens)} if tokens else set()
        sets.append(runs)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, *_) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key, key=lambda k: (k is None, k))
    return [(rows[i][0], len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(awkward, awkward_rows, words, percent):
    got = minhash.near_duplicates(awkward, minhash.Settings(words=words, percent=percent)).collect()
    expected = plain_components(awkward_rows, words, percent)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == sorted(map(repr, expected))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.fixture(scope="module")
def drifting():
    """Groups in which each text differs a little from the one before: links make long chains."""
    pick = random.Random(9)
    rows = []
    for group in range(6):
        words = [f"g{group}w{pick.randrange(500)}" for _ in range(120)]
        for step in range(40):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[pick.randrange(len(words))] = f"new{len(rows)}"
    passage = [f"shared{i}" for i in range(60)]
    for i in range(60):
        rows.append((2000 + i, " ".join(passage + [f"own{i}x{j}" for j in range(pick.randrange(5, 80))])))
    return rows


def test_chains_and_shared_passages(spark, drifting):
    docs = spark.createDataFrame(drifting, "doc_id long, text string")
    got = minhash.near_duplicates(docs, minhash.Settings(words=3, percent=85)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(drifting, 3, 85))


def test_blocks_find_what_pivots_miss(spark, drifting, monkeypatch):
    """With few rows to a band, buckets hold many unlinked nodes."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    docs = spark.createDataFrame(drifting, "doc_id long, text string")
    got = minhash.near_duplicates(docs, minhash.Settings(words=3, percent=85, rows=1)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(drifting, 3, 85))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1100)}}


def test_bounds_keep_similar_pairs():
    settings = minhash.Settings(words=3, percent=85)
    draw = np.random.default_rng(3)
    b = draw.integers(0, 256, (200_000, settings.sketch)).astype(np.uint8)
    a = np.where(draw.random(b.shape) < 0.85, b, draw.integers(0, 256, b.shape)).astype(np.uint8)
    assert minhash.may_link(a, b, settings).mean() > 0.9999
    far = np.where(draw.random(b.shape) < 0.4, b, draw.integers(0, 256, b.shape)).astype(np.uint8)
    assert minhash.may_link(far, b, settings).mean() < 0.001


def test_near_duplicates_of_nothing(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


# --------------------------------------------------------------------------------------------
# mixing


def highest_quotients(weights, most, seats):
    won = [0] * len(weights)
    queue = [(-w, i) for i, w in enumerate(weights) if most[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * won[i] + 1), i))
    return won


@pytest.mark.parametrize("seed", range(4))
def test_apportion(spark, seed):
    pick = random.Random(seed)
    weights = [pick.choice([1, 5, 30, 1000, 20_000]) * pick.random() for _ in range(25)]
    seats, most = pick.choice([3, 40, 1777]), [10_000] * 25
    units = spark.createDataFrame([("g", i, w, seats, m) for i, (w, m) in enumerate(zip(weights, most))], "g string, i long, w double, seats long, most long")
    expected = highest_quotients(weights, most, seats)
    for group in (None, "g"):
        got = mixing.apportion(units, group, "seats", "w", "most", "i").orderBy("i").collect()
        assert [r["quota"] for r in got] == expected


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    closed, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(repeats * sizes[s] for s in closed)
        level = left / max(1e-9, sum(weight[s] for s in order if s not in closed))
        more = {s for s in order if s not in closed and repeats * sizes[s] < level * weight[s]}
        if not more:
            return {s: repeats * sizes[s] if s in closed else level * weight[s] for s in order}
        closed |= more


def test_mix(awkward, awkward_rows):
    got = mixing.mix(awkward).collect()
    assert len(got) == len(awkward_rows)
    sizes, taken, target = {}, {}, {}
    count = lambda t: len(re.findall(f"[^{SPACE}]+", t or ""))
    for _, text, _, source, *_ in awkward_rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    assert sorted(r["size"] for r in got) == sorted(count(r[1]) for r in awkward_rows)
    by_size = plain_targets(sizes)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        source = min(sizes, key=lambda s: abs(sizes[s] - r["source_size"]))
        assert sizes[source] == r["source_size"] and abs(by_size[source] - r["target"]) < 1e-6 * max(1, r["target"])
        taken[source], target[source] = taken.get(source, 0) + r["taken"], r["target"]
    for source in taken:
        assert abs(taken[source] - target[source]) <= 0.01 * target[source] + 4
    again = mixing.mix(awkward.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_documents(awkward):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    assert out.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6  # three equal rows, twice each


def test_long_documents_of_sources_taken_at_a_low_rate(spark):
    """Each of 40 sources has one document with most of its words, and a third of them is to be taken."""
    rows = [(100 * s, "long " * 800, f"s{s}") for s in range(40)] + [(100 * s + i, "a b c d e", f"s{s}") for s in range(40) for i in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    out = [r["doc_id"] for r in mixing.mixed_documents(docs, weights=(1,), share=0.35).collect()]
    long = sum(i % 100 == 0 for i in out)
    words, target = 800 * long + 5 * (len(out) - long), 0.35 * 40 * 1000
    assert 5 <= long <= 20 and abs(words - target) < 0.3 * target


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(docs).collect()] == [0, 0]


# --------------------------------------------------------------------------------------------
# top k


def test_top_k(spark):
    draw = np.random.default_rng(4)
    data = [(int(i), np.floor(draw.normal(size=12) * 9).tolist()) for i in range(700)]
    data += [(i + 1000, data[7][1]) for i in range(40)]  # ties
    data += [(2000, None), (2002, [float("nan")] * 12), (2004, [1.0, None] * 6), (2006, []), (2008, [3.0] * 4), (None, [1.0] * 12), data[3], (data[5][0], [50.0] * 12)]
    rows = [(*r, "x", 1.0, 3) for r in data]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>, query string, score double, rank int").repartition(3)
    for lists in (1, 2, 3):
        got = topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, 5, lists=lists).collect()
        used = [(k, np.array((v + [0.0] * 12)[:12])) for k, v in data if k is not None and v is not None and None not in v and np.isfinite(v).all()]
        expected = {}
        for q, asking in used:
            if q % 50 == 0:
                for k, v in used:
                    if k != q:
                        expected.setdefault(q, {})[k] = max(expected.get(q, {}).get(k, -1e18), float(asking @ v))
        expected = {(q, i + 1, k, s) for q, found in expected.items() for i, (k, s) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:5])}
        assert {tuple(r) for r in got} == expected


def test_top_k_of_few_and_nothing(spark):
    one = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, vector array<double>")
    assert [tuple(r) for r in topk.exact_top_k(one, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1, 2.0)]
    assert topk.exact_top_k(one.limit(0), F.col("vec_id") == 0, 5).count() == 0
    assert topk.exact_top_k(one, F.lit(False), 5).count() == 0


def test_top_k_sends_few_entries(spark, monkeypatch):
    """What leaves the meetings are k entries per query and block, not a share of all pairs."""
    draw = np.random.default_rng(6)
    rows = [(int(i), draw.normal(size=12).tolist()) for i in range(3000)]
    tables, real = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    assert topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(2), F.col("vec_id") % 50 == 0, 5).count() == 300
    blocks = tables["candidate-blocks"].count()
    assert tables["local-lists"].select(F.sum(F.size("ids"))).first()[0] <= 5 * 60 * blocks
    assert tables["entries"].count() <= 5 * 60 * blocks


@pytest.mark.parametrize("lists", [1, 2, 3])
def test_top_k_tiles(monkeypatch, lists):
    """A meeting of many tiles, with ties, keys that repeat and queries among the candidates."""
    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_CANDIDATES", 11)
    draw = np.random.default_rng(lists)
    ids, rows = draw.integers(0, 60, 100), np.floor(draw.normal(size=(100, 6)) * 3)
    asking, vectors = np.append(draw.integers(0, 60, 20), [1000, 1000]), np.floor(draw.normal(size=(22, 6)) * 3)
    queries = pa.array([[{"id": int(i), "vector": v.tolist()} for i, v in zip(asking, vectors)]])
    m = topk._Meeting(pa.scalar(ids.astype(np.int64).tobytes()), pa.scalar(rows.tobytes()), queries[0], 6, lists)
    cuts = np.linspace(0, 6, lists + 1).astype(int)
    lowest, of, found, scores = m.best_of_lists(5)
    assert np.array_equal(lowest, np.stack([(vectors[:, a:b] @ rows[:, a:b].T).min(axis=1) for a, b in zip(cuts, cuts[1:])], axis=1))
    for cutoff in (-np.inf, 4.0):
        row, key, total = m.reaching(5, lowest, np.full(22, cutoff))
        for q in range(22):
            best = {}
            for i, v in zip(ids, rows):
                if i != asking[q] and vectors[q] @ v >= cutoff:
                    best[int(i)] = max(best.get(int(i), -np.inf), float(vectors[q] @ v))
            assert sorted(zip(key[row == q].tolist(), total[row == q].tolist())) == sorted(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])
            if cutoff == -np.inf:
                assert all(s <= best[i] for i, s in zip(found[of == q].tolist(), scores[of == q]))
                assert 0 < (of == q).sum() <= 5 and len(set(found[of == q])) == (of == q).sum()


# --------------------------------------------------------------------------------------------
# archives


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 200, "é" * 99
    rows = [(9, "http://a/9", big), (3, None, big), (3, "again", big), (5, "u", None), (6, "u", None), (7, "line\r\nbreak", other), (8, "u", other), (1, "u", "short"), (2, "u", "short"), (None, "u", big), (None, "u", "y" * 150), (4, "long", "word " * 60_000)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, first string").repartition(4), rows


def test_archive(spark, pages):
    table, rows = pages
    folder = new_folder(spark, "warc")
    manifest = warc.write_archive(table, folder, roll_bytes=2000)
    got = warc.read_archive(spark, folder, manifest, table.schema["page_id"].dataType).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    found = sorted(repr((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"])) for r in got)
    expected = [
        (9, 203, "revisit", 3), (3, 203, "response", None), (3, 203, "revisit", 3), (5, 0, "response", None), (6, 0, "response", None), (7, 198, "response", None), (8, 198, "revisit", 7),
        (1, 5, "response", None), (2, 5, "response", None), (None, 203, "revisit", 3), (None, 150, "response", None), (4, 300_000, "response", None),
    ]
    assert found == sorted(map(repr, expected))
    assert sum(f["records"] for f in manifest) == len(rows)
    again = warc.write_archive(table.repartition(2), new_folder(spark, "warc"), roll_bytes=2000)
    assert again == manifest
    store, base = filesystem(folder)
    from pyarrow import fs

    assert not any(f.base_name.endswith(".tmp") for f in store.get_file_info(fs.FileSelector(base)))


def test_archive_of_nothing(spark, pages):
    empty, folder = pages[0].limit(0), new_folder(spark, "warc")
    assert warc.write_archive(empty, folder) == []
    assert warc.read_archive(spark, folder, [], empty.schema["page_id"].dataType).count() == 0


# --------------------------------------------------------------------------------------------
# toxicity


def plain_segments(scores):
    """Maximal runs by their definition: the best run, then the best on either side of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    return plain_segments(scores[: at[0]]) + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in plain_segments(scores[at[1] :])]


def test_maximal_segments():
    pick = random.Random(2)
    for _ in range(300):
        scores = np.array([pick.choice([-3, -2, -1, 1, 2, 4]) + pick.random() / 100 for _ in range(pick.randrange(0, 30))], dtype=np.float32)
        got = toxicity.maximal_segments(scores)
        expected = plain_segments(scores.astype(float).tolist())
        assert [g[:2] for g in got] == [e[:2] for e in expected]


def test_decay():
    scores, counts = np.array([1.0, -1.0]), np.array([1.0, 3.0])
    assert abs(toxicity.decay_of(scores, counts) - np.log(3)) < 1e-9


@pytest.fixture(scope="module")
def spoken(spark):
    pick = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = [pick.choice(plain) for _ in range(80)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words[30 + pick.randrange(20)] = pick.choice(["awful!", "Rotten", "vile"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "vile vile vile"), (1002, "vile " * 20_000), docs[0], docs[0]]
    labels += [(None, 1), (3, None), (5000, 1), labels[0]]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spoken):
    docs, labels = spoken
    got = toxicity.score_toxicity(docs, labels, F.col("doc_id") % 3 != 0).collect()
    assert len(got) == docs.count()
    score = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(0, 600, 3)]
    assert all((score[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert score[1002] >= 0.3 and score[None] >= 0.3 and score[1000] < 0.3 and score[1001] == score[1000]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    row = next(r for r in got if r["doc_id"] == 300)
    passage = max(row["passages"], key=lambda p: p["total"])
    assert passage["significant"] and re.search("awful|Rotten|vile", texts[300][passage["start"] : passage["end"]])


def test_words_share_no_counts(spark):
    """Two words whose hashes agree in their last 22 bits, one in toxic texts, one in unlabelled ones."""
    seen: dict[int, str] = {}
    for i in range(100_000):
        place = xxhash.xxh3_64_intdigest(f"x{i}".encode()) % (1 << 22)
        if place in seen:
            break
        seen[place] = f"x{i}"
    toxic, other = seen[place], f"x{i}"
    pick = random.Random(4)
    plain = lambda: [f"w{pick.randrange(200)}" for _ in range(60)]
    docs = [(i, " ".join(plain() + [toxic] * 5 * (i % 5 == 0))) for i in range(300)] + [(1000, " ".join(plain() + [other] * 5)), (1001, " ".join(plain() + [toxic] * 5))]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    assert score[1000] < 0.3 <= score[1001]


def test_toxicity_without_labels(spoken, nothing):
    docs, labels = spoken
    for share, some in ((0.5, labels.limit(0)), (1.0, labels.where("toxic = 1")), (0.0, labels.where("toxic = 0"))):
        assert {r["score"] for r in toxicity.score_toxicity(docs, some, F.lit(True)).collect()} == {share}
    assert toxicity.score_toxicity(nothing, labels, F.lit(True)).count() == 0
