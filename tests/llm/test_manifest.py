"""Merkle manifests beside plain Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves, fanout):
    """Root and the proof of every leaf."""
    level, proofs, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, place in enumerate(at):
            run = level[place // fanout * fanout :][:fanout]
            proofs[i].append((place % fanout, "".join(x for j, x in enumerate(run) if j != place % fanout)))
        at = [place // fanout for place in at]
        level = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], proofs


def plain_manifest(rows, fanout):
    trees = defaultdict(list)
    for row in rows:
        trees[row["lang"]].append((row["doc_id"], sha(*[field(row[f]) for f in FIELDS])))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    found = {t: plain_tree([leaf for _, leaf in sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for t in order}
    root, above = plain_tree([found[t][0] for t in order], fanout)
    out = []
    for i, t in enumerate(order):
        leaves = sorted(trees[t], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        out += [(key, leaf, found[t][0], root, tuple(proof + above[i])) for (key, leaf), proof in zip(leaves, found[t][1])]
    return out


def built(df, fanout=8, **options):
    proofs = merkle.build_manifest(df, FIELDS, "lang", "doc_id", fanout=fanout, **options).proofs()
    return [(r["key"], r["digest"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in proofs.collect()]


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fanout", [2, 8])
def test_awkward_rows(awkward, fanout):
    """Nulls in every column, repeated rows, ties, a very long text, clashing columns."""
    expected = plain_manifest([r.asDict() for r in awkward.collect()], fanout)
    assert by_text(built(awkward, fanout)) == by_text(expected)


def test_several_blocks(spark):
    """Trees of very different size; the largest is folded in three rounds."""
    rows = [(i, None, None if i % 3 == 0 else "de" if i > 20 else f"l{i}", i, f"text {i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    expected = plain_manifest([r.asDict() for r in df.collect()], 2)
    assert by_text(built(df, 2)) == by_text(expected)


def test_one_row_and_none(spark, awkward, nothing):
    one = awkward.limit(1)
    row = one.first()
    leaf = sha(*[field(row[f]) for f in FIELDS])
    assert built(one) == [(row["doc_id"], leaf, leaf, leaf, ())]
    assert built(nothing) == []


def test_equal_rows(spark):
    """Equal rows are leaves each, and do not need one task."""
    df = spark.range(700).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    assert by_text(built(df)) == by_text(plain_manifest([r.asDict() for r in df.collect()], 8))


def test_fold_and_tampering(awkward):
    proofs = merkle.build_manifest(awkward, FIELDS, "lang", "doc_id", {"other": F.sha2(F.lit("other").cast("binary"), 256)}).proofs()
    folded = proofs.select("root", merkle.fold_proof(F.col("digest"), F.col("proof")).alias("own"), merkle.fold_proof(F.col("carried.other"), F.col("proof")).alias("other"))
    rows = folded.collect()
    assert rows and all(r["own"] == r["root"] != r["other"] for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.integers(2, 5))
def test_sweeps(n, fanout):
    leaves = [sha(str(i)) for i in range(n)]
    nodes = merkle.sweep_up(leaves, merkle.depth(n, fanout), fanout)
    root, proofs = plain_tree(leaves, fanout)
    assert nodes[-1] == [root]
    assert [list(p) for p in merkle.sweep_down(nodes, (), fanout)] == proofs
