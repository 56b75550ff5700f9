"""Periodic runs beside plain Python."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwise.llm import periodic


def plain_runs(words):
    """Every maximal stretch at every lag; the smallest lag of a stretch is its period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


repeated = st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 8)), max_size=5).map(lambda parts: [w for part, n in parts for w in part * n])


@settings(max_examples=400, deadline=None)
@given(repeated)
def test_scans_agree(words):
    expected = plain_runs(words)
    found = lambda scan: sorted(((s, e - s, q) for (s, e), q in scan(np.array(words, dtype=np.int64)).items()), key=lambda r: (r[0], r[2]))
    assert found(periodic.scan_lags) == expected
    if words:
        assert found(periodic.scan_blocks) == expected
    assert periodic.find_runs(words) == expected


def test_long_segments():
    """Long segments: random words, nested periods, one word, a period of thousands of words."""
    r = random.Random(3)
    texts = [
        [r.randrange(20) for _ in range(3000)],
        ([0] * 50 + [1]) * 40 + [2] * 700,
        [0] * 5000,
        [r.randrange(30) for _ in range(600)] * 4 + [7] * 9,
        ([1, 2] * 5 + [3]) * 100,
    ]
    for words in texts:
        assert periodic.find_runs(words) == plain_runs(words)


def test_very_long_texts_stay_cheap():
    for words in ([0] * 200_000, ([0] * 1000 + [1]) * 200, list(range(50_000)) * 4):
        assert len(periodic.find_runs(words)) in (1, 201)


def test_awkward_rows(awkward, awkward_rows, nothing):
    """Nulls, empty and very long texts, repeated rows and ids, columns named as the results."""
    rows = awkward.withColumnRenamed("ids", "runs").withColumnRenamed("key", "collapsed")
    got = [(r["carried"]["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(rows).collect()]
    expected = []
    for doc, text, *_ in awkward_rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = plain_runs(words) if len(words) < 5000 else periodic.find_runs(words)
        expected.append((doc, runs, plain_collapse(words, runs)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(runs for _, runs, _ in got)
    assert periodic.periodic_runs(nothing).count() == 0


def test_ties_and_overlaps():
    """Two runs that share words: a word goes if either run repeats it."""
    words = list("aaaaaa" + "baaaaaa" * 4)
    runs = periodic.find_runs(words)
    assert runs == plain_runs(words) and len({q for _, _, q in runs}) == 2
    assert " ".join(periodic.without_repetitions(words, runs)) == plain_collapse(words, runs)
