"""The mixture and the whole pipeline beside plain Python, row for row."""

from __future__ import annotations

import base64
import math
import random
import re
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from compare import difference
from panelwise.llm import mixing
from panelwise.llm.queries import QUERIES, SQL

from .test_groups import highest_quotients, plain_components, plain_targets
from .test_lines import SPACE, ascii_lower, null_last, plain_counts, plain_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def spark_hash(number, *longs):
    """``xxhash64`` of an int and longs; a null leaves the hash as it is."""
    value = xxhash.xxh64_intdigest(struct.pack("<i", number), 42)
    for x in longs:
        if x is not None:
            value = xxhash.xxh64_intdigest(struct.pack("<q", x), value)
    return signed(value)


def content(text):
    return signed(xxhash.xxh64_intdigest((text or "").encode(), 42))


def plain_taken(rows, seed=mixing.SEED):
    """``taken`` of each row (id, text, source)."""
    size = [len(words_of(text)) for _, text, _ in rows]
    of, total = defaultdict(list), len(rows)
    for i, (_, _, source) in enumerate(rows):
        of[source].append(i)
    sizes = {s: sum(size[i] for i in where) for s, where in of.items()}
    target = plain_targets(sizes)
    least = min((t for t in target.values() if t > 0), default=0)
    block = min(mixing.MOST_BLOCK_WORDS, 1 << max(0, int(least / mixing.LEAST_BLOCKS).bit_length() - 1))
    order = sorted(of, key=null_last)
    seats = highest_quotients([target[s] for s in order], [math.ceil(2 * sizes[s] / block) for s in order], round(sum(target.values()) / block))
    taken = [0] * total
    for source, won in zip(order, seats):
        shards = math.ceil(len(of[source]) * min(1 / mixing.SHARD_ROWS, mixing.MOST_SHARDS / total))
        dealt = defaultdict(list)
        for i in of[source]:
            mixed = spark_hash(seed, rows[i][0], content(rows[i][1]))
            dealt[mixed % shards].append((spark_hash(seed + 1, mixed), null_last(rows[i][0]), i))
        words = [sum(size[i] for *_, i in dealt[s]) for s in sorted(dealt)]
        quotas = highest_quotients(words, [math.ceil(2 * w / block) for w in words], won)
        for shard, total_words, quota in zip(sorted(dealt), words, quotas):
            here, end = min(quota * block, 2 * total_words), 0
            rounds, rest = divmod(here, total_words) if total_words else (0, here)
            for *_, i in sorted(dealt[shard]):
                end += size[i]
                taken[i] = rounds * size[i] + max(0, min(end, rest) - (end - size[i]))
    return taken


def plain_run(rows, ids_of):
    """The rows (id, token ids) of the five stages over (doc_id, text, source)."""
    # lines that more than 20 texts of a source hold go, except from its first document
    key = lambda line: ascii_lower(line.strip(SPACE))
    held, first, kept = defaultdict(set), {}, []
    for doc, text, host in rows:
        for line in filter(None, map(key, (text or "").split("\n"))):
            held[host, line].add(text)
            first[host, line] = min(first.get((host, line), doc), doc, key=null_last)
    for doc, text, host in rows:
        lines = (text or "").split("\n")
        gone = [len(held[host, key(x)]) > 20 and first[host, key(x)] != doc for x in lines]
        n, *_, repeated = plain_counts(text or "")
        left = n - sum(len(words_of(x)) for x, g in zip(lines, gone) if g)
        if n >= 50 and 100 * repeated <= 50 * n and left >= 0.2 * n:
            kept.append((doc, "\n".join(x for x, g in zip(lines, gone) if not g), host))
    rows = [(doc, text, host) for (doc, *_, text), (*_, host) in zip(plain_dedup(kept), kept)]
    # one row of each group of near copies: the smallest id, then the smallest hash of its text
    linked = plain_components([(i, text) for i, (_, text, _) in enumerate(rows)], 5, 80)
    groups = defaultdict(list)
    for i, n, root in linked:
        groups[root if n else ("alone", i)].append(i)
    chosen = [min(g, key=lambda i: (null_last(rows[i][0]), content(rows[i][1]))) for g in groups.values()]
    rows = [rows[i] for i in sorted(chosen)]
    out = Counter()
    for (doc, text, _), taken in zip(rows, plain_taken(rows)):
        size = len(words_of(text))
        draw = spark_hash(mixing.SEED + 2, doc, content(text)) % (1 << 30) / (1 << 30)
        times = math.floor(taken / size + draw) if size else 0
        out[doc, tuple(ids_of(text))] += times
    return +out


@pytest.fixture(scope="module")
def corpus():
    """Several sources, one of them hot; boilerplate, copies, near copies, nulls, a long text."""
    pick = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Ünï", "日本", "🙂", "don't"]
    prose = lambda n: "".join(pick.choice(vocabulary) + pick.choice("     \n") for _ in range(n))
    common = " ".join(f"common{i}" for i in range(70))
    rows = []
    for i in range(240):
        source = pick.choice(["hot"] * 4 + ["b", "c", "", None])
        rows.append((1000 - i, prose(pick.randint(20, 200)), source))
    rows += [(2000 + i, f"{common}\n{prose(60)}", "hot") for i in range(30)] + [(2100, f"{common}\nfew words", "hot")]
    rows += [(2200 + i, f"{common}\n{prose(60)}", "b") for i in range(3)]
    passage = " ".join(f"passage{i}" for i in range(60))
    rows += [(2300 + i, f"{prose(55)}\n{passage}", "c") for i in range(4)]
    for i in range(12):  # near copies of each other, across sources
        near = rows[i][1].split(" ")
        near[pick.randrange(len(near))] = "changed"
        rows.append((3000 + i, " ".join(near), pick.choice(["b", "c"])))
    rows += [(4000 + i, rows[20][1], "c") for i in range(8)] + [rows[25]] * 3
    rows += [(5000, prose(25_000), "b"), (None, prose(90), "c"), (None, rows[30][1], None), (5001, None, "b"), (5002, "", None), (5003, "a b c " * 50, "hot")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(doc, text, None, source, None) for doc, text, source in rows], SCHEMA).repartition(4)


def test_taken_of_every_document(spark, corpus):
    expected = Counter(zip(((doc, content(text)) for doc, text, _ in corpus), plain_taken(corpus)))
    got = Counter(((r["doc_id"], r["content"]), r["taken"]) for r in mixing.mix(table(spark, corpus)).collect())
    assert got == expected


def test_taken_in_several_shards(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 16)
    test_taken_of_every_document(spark, corpus)


def test_run_is_the_plain_pipeline(spark, corpus, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in got)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == plain_run(corpus, library.encode_ordinary)


def test_quality_query_rejects_the_depleted(spark, tmp_path):
    """A line in 2 % of a hot source, below any share of it but over the limit."""
    import duckdb

    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    common = " ".join(f"common{j}" for j in range(70))
    rows = [(i, f"{common}\n{own(i, 60)}", "hot") for i in range(30)] + [(i, f"{common}\nfew words {i}", "hot") for i in range(30, 34)]
    rows += [(i, own(i, 60), "hot") for i in range(100, 1700)] + [(i, f"{common}\n{own(i, 60)}", None) for i in range(2000, 2020)] + [(3000, None, None)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["op10_quality_rules"](spark, str(tmp_path)).toPandas()
    assert difference(got, database.execute(SQL["op10_quality_rules"]).df()) is None
    assert set(got[~got["base_failed"] & ~got["kept"]]["doc_id"]) == {30, 31, 32, 33}
