"""Near duplicates by MinHash: banded candidates, Bayesian pruning, exact confirmation.

Documents with the same set of shingles are one node from the start, so copies cost nothing
further. In each bucket of a band every node is compared with the one that meets most others; what
that leaves unlinked is compared across the components so far, block by block. A comparison reads
a small sketch in batches and stops as soon as the posterior probability of enough similarity falls
under a chosen miss probability; survivors are confirmed on the full sets of their texts. Links are
joined to components by passing on the smallest label. No step lists all pairs of a group, gathers
a bucket in one row, or leaves out a candidate.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.llm.common import prepare, text_or_empty
from panelwise.session import written

REMEMBERED = 150_000
#: Nodes per block when nodes of a bucket are compared with each other.
BLOCK = 64
#: Nodes up to which the documents to confirm are named to every task (8 bytes each); beyond that
#: texts are shuffled to find them.
SMALL = 400_000
#: Nodes up to which a component is looked up by a shuffle in any case.
LARGE = 1000


@dataclass(frozen=True)
class Settings:
    """``words`` to a shingle; links have ``100 * intersection >= percent * union``; bands and
    pruning each miss a pair at that similarity with at most ``miss`` probability."""

    words: int = 5
    percent: int = 80
    rows: int = 8
    sketch: int = 128
    batch: int = 32
    miss: float = 1e-6
    seed: int = 11

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @cache
    def bounds(self) -> list[tuple[int, int]]:
        """After so many values of the sketch, the least number of equal ones with which a pair may
        still be similar: the posterior, from a uniform prior, gives it ``miss`` or more.

        Values have one byte, so unequal ones agree once in 256.
        """
        s = (np.arange(20_000) + 0.5) / 20_000
        equal = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
        found = []
        for n in range(self.batch, self.sketch + 1, self.batch):
            for m in range(n + 1):
                weight = m * equal[0] + (n - m) * equal[1]
                weight = np.exp(weight - weight.max())
                if weight[s >= self.percent / 100].sum() >= self.miss * weight.sum():
                    break
            found.append((n, m))
        return found


# --------------------------------------------------------------------------------------------
# shingles and signatures


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()  # of this worker


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's runs of words, A-Z lower-cased; a shorter text
    is one run, one without words has none."""
    tokens = text.encode().lower().split()
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))] if tokens else [], dtype=np.uint64)
    each = np.fromiter(map(_words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    runs = np.zeros(len(tokens) - words + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):
            runs = _mix(runs + each[i : len(tokens) - words + 1 + i])
    return np.unique(runs)


class _Signer:
    def __init__(self, settings: Settings):
        self.settings = settings
        random = np.random.default_rng(settings.seed)
        n = settings.rows * settings.bands + settings.sketch
        self.a = random.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, n, dtype=np.uint32)
        self.fold = random.integers(0, 1 << 63, settings.rows, dtype=np.uint64) | np.uint64(1)
        self.band = random.integers(0, 1 << 63, settings.bands, dtype=np.uint64)

    def sign(self, runs: np.ndarray) -> tuple[np.ndarray, bytes]:
        """A bucket for each band, and the sketch; hashes of one do not serve the other."""
        short = (runs ^ (runs >> np.uint64(32))).astype(np.uint32)[:, None]
        least = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(short), 256):
            np.minimum(least, (short[i : i + 256] * self.a + self.b).min(axis=0), out=least)
        split = self.settings.rows * self.settings.bands
        rows = least[:split].reshape(self.settings.bands, -1).astype(np.uint64)
        buckets = _mix((rows * self.fold).sum(axis=1) + self.band)
        return buckets.view(np.int64), ((least[split:] * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def sign(docs: DataFrame, settings: Settings, key: str, text: str) -> DataFrame:
    """``key``, ``content`` (hash of the text), ``digest`` of the set, ``n_shingles``, ``buckets``
    and ``sketch`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = _Signer(settings)
        for batch in batches:
            digests, sizes, buckets, sketches = [], [], [], []
            for value in batch.column(2).to_pylist():
                runs = shingles(value, settings.words)
                digests.append(xxhash.xxh3_128_digest(runs.tobytes()))
                sizes.append(len(runs))
                own, sketch = signer.sign(runs) if len(runs) else ([], b"")
                buckets.append(own)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["key", "content", "digest", "n_shingles", "buckets", "sketch"],
            )

    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType),
        T.StructField("content", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("buckets", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ])
    value = text_or_empty(text)
    return docs.select(F.col(key).alias("key"), F.xxhash64(value).alias("content"), value.alias("text")).mapInArrow(run, schema)


# --------------------------------------------------------------------------------------------
# comparing


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def may_link(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Which rows of two arrays of sketches are not ruled out, batch after batch."""
    left, before = np.arange(len(a)), 0
    equal = np.zeros(len(a), dtype=np.int64)
    for n, least in settings.bounds():
        equal[left] += (a[left, before:n] == b[left, before:n]).sum(axis=1)
        left, before = left[equal[left] >= least], n
    kept = np.zeros(len(a), dtype=bool)
    kept[left] = True
    return kept


def _size_allows(settings: Settings, a: str, b: str):
    """No two sets overlap by more than the smaller one."""
    return 100 * F.least(a, b) >= settings.percent * F.greatest(a, b)


def _pruned(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches do not rule a link out, with the number of equal
    values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_matrix(batch.column(i), settings.sketch) for i in (2, 3))
            kept = pa.array(may_link(a, b, settings))
            equal = pa.array((a == b).sum(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in (batch.column(0), batch.column(1), equal)], names=["a", "b", "equal"])

    sketch = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"sketch_{name}"))
    both = pairs.join(sketch("a"), "a").join(sketch("b"), "b").select("a", "b", "sketch_a", "sketch_b")
    return both.mapInArrow(run, "a long, b long, equal int")


def _is_link(x: np.ndarray, y: np.ndarray, settings: Settings) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= settings.percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs that are links, on the full sets of their (packed) texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict[bytes, np.ndarray] = {}  # of this batch

            def of(packed: bytes) -> np.ndarray:
                if packed not in sets:
                    sets[packed] = shingles(zlib.decompress(packed).decode(), settings.words)
                return sets[packed]

            linked = [_is_link(of(x), of(y), settings) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            kept = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(kept) for i in (0, 1)], names=["a", "b"])

    packed = lambda name: texts.select(F.col("node").alias(name), F.col("packed").alias(f"packed_{name}"))
    both = pairs.select("a", "b").join(packed("a"), "a").join(packed("b"), "b").select("a", "b", "packed_a", "packed_b")
    return both.mapInArrow(run, "a long, b long")


def _packed_texts(docs: DataFrame, signed: DataFrame, wanted: DataFrame, settings: Settings, text: str) -> DataFrame:
    """``node`` and its text, compressed, for one text of each wanted node."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: set[int] = set()  # nodes of this task: copies of their texts need no work
        for batch in batches:
            nodes, texts = [], []
            for node, digest, value in zip(*(c.to_pylist() for c in batch.columns)):
                # The row was found by a hash of its text; the digest says whether it is that set.
                if node not in packed and xxhash.xxh3_128_digest(shingles(value, settings.words).tobytes()) == digest:
                    packed.add(node)
                    nodes.append(node)
                    texts.append(zlib.compress(value.encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary())], names=["node", "packed"])

    one = signed.join(wanted, "node").groupBy("node").agg(F.min(F.struct("content", "digest")).alias("one")).select("node", "one.*")
    named = written(one, "near-texts")
    named = F.broadcast(named) if named.count() <= SMALL else named
    rows = docs.select(text_or_empty(text).alias("text")).withColumn("content", F.xxhash64("text"))
    packed = rows.join(named, "content").select("node", "digest", "text").mapInArrow(pack, "node long, packed binary")
    return packed.distinct()  # copies of the text came along


# --------------------------------------------------------------------------------------------
# components


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with over any number of links.

    Each round passes the smallest label to neighbours and then takes the label of the label, so
    long chains halve; sums and joins are spread over nodes however many links one has.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("of")).agg(F.min("component").alias("least"))
        lower = labels.join(near, labels["node"] == near["of"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        root = labels.select(F.col("node").alias("at"), F.col("component").alias("over"))
        moved = lower.join(root, lower["component"] == root["at"], "left")
        moved = written(moved.select("node", "old", F.least("component", F.coalesce("over", "component")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("old <> component").isEmpty():
            return labels


def _labelled(rows: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    named = labels.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    joined = rows.join(named, F.col(node) == F.col("__node"), "left")
    return joined.withColumn(out, F.coalesce("__component", node)).drop("__node", "__component")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    both = _labelled(_labelled(pairs, labels, "a", "__a"), labels, "b", "__b")
    return both.where("__a <> __b").drop("__a", "__b")


class _Parts:
    """Which components of a meeting have been linked in it."""

    def __init__(self):
        self.over: dict[int, int] = {}

    def of(self, part: int) -> int:
        while part in self.over:
            part = self.over[part]
        return part

    def join(self, a: int, b: int) -> None:
        self.over[self.of(a)] = self.of(b)


def _placed(own: DataFrame, row: Column) -> DataFrame:
    """``row`` of the nodes of each bucket (``size`` of them, ``most`` in the component ``major``)
    in blocks of bounded size: all nodes on the right, those of other components on the left too."""
    place = F.xxhash64(F.lit(3), "node")
    side = lambda left, n: F.struct(F.lit(left).alias("left"), F.pmod(place, F.greatest(F.ceil(n / BLOCK), F.lit(1))).alias("block"))
    right, left = side(False, F.col("size")), side(True, F.col("size") - F.col("most"))
    sides = F.when(F.col("component") != F.col("major"), F.array(right, left)).otherwise(F.array(right))
    rows = own.select("bucket", F.ceil(F.col("size") / BLOCK).alias("blocks"), F.explode(sides).alias("side"), row.alias("row"))
    return rows.groupBy("bucket", "blocks", "side").agg(F.collect_list("row").alias("rows"))


def _meetings(placed: DataFrame) -> DataFrame:
    """Every block on the left beside every block on the right of its bucket, one meeting a row."""
    right = placed.where("not side.left").select("bucket", F.col("side.block").alias("right"), F.col("rows").alias("others"))
    left = placed.where("side.left").select("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("right"), F.col("rows").alias("these"))
    return left.join(right, ["bucket", "right"]).select("bucket", "these", "others")


def _not_ruled_out(bucket: int, x: pa.StructArray, y: pa.StructArray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks of the pairs across components that size and sketch allow, the most
    alike first. A pair that meets in several buckets is looked at in the first."""
    size, part = ([np.asarray(s.field(f)) for s in (x, y)] for f in ("n_shingles", "component"))
    a, b = (_matrix(s.field("sketch"), settings.sketch) for s in (x, y))
    where = [np.asarray(s.field("buckets").flatten()).reshape(len(s), -1) for s in (x, y)]
    low, high = np.minimum.outer(size[0], size[1]), np.maximum.outer(size[0], size[1])
    i, j = np.nonzero((part[0][:, None] != part[1][None, :]) & (100 * low >= settings.percent * high))
    kept = may_link(a[i], b[j], settings)
    i, j = i[kept], j[kept]
    same = where[0][i] == where[1][j]
    kept = where[0][i, same.argmax(axis=1)] == bucket
    i, j = i[kept], j[kept]
    order = np.argsort(-(a[i] == b[j]).sum(axis=1), kind="stable")
    return i[order], j[order]


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links of nodes that share a bucket of three or more but no component.

    In each bucket, nodes outside the commonest component (the minor ones) are compared with all
    nodes of other components. Blocks of bounded size meet block by block, each meeting is one row.
    Sketches meet first, and what leaves is the nodes of pairs that are not ruled out; only these
    meet again with their texts. Only links leave that: pairs are confirmed there, the most alike
    first, unless the meeting has linked their components by then.
    """
    named = written(_labelled(members, labels, "node", "component"), "bucket-members")
    per = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"), F.sum("n").alias("size"), F.max("n").alias("most"))
    mixed = written(mixed.where("parts > 1 and size > 2"), "mixed-buckets")
    own = named.select("node", "component", "bucket").join(mixed, "bucket")
    fields = ("node", "n_shingles", "component", "buckets", "sketch")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bucket, these, others in zip(*batch.columns):
                x, y = these.values, others.values
                i, j = _not_ruled_out(bucket.as_py(), x, y, settings)
                seen = np.unique(np.concatenate([np.asarray(x.field("node"))[i], np.asarray(y.field("node"))[j]]))
                found.append((bucket.as_py(), seen))
            buckets = np.repeat(np.array([b for b, _ in found], dtype=np.int64), [len(n) for _, n in found])
            seen = np.concatenate([n for _, n in found]) if found else np.array([], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(seen, pa.int64())], names=["bucket", "node"])

    met = _meetings(written(_placed(own.join(nodes, "node"), F.struct(*fields)), "sketch-blocks"))
    left = written(met.mapInArrow(sketches, "bucket long, node long").distinct(), "not-ruled-out")
    again = written(own.drop("size", "most", "parts").join(left, ["bucket", "node"]), "to-confirm")
    sizes = again.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if(F.col("component") == F.col("major")).alias("most"))
    whole = nodes.join(again.select("node").distinct(), "node", "left_semi").join(texts, "node")
    whole = again.join(sizes, "bucket").join(whole, "node")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [link for bucket, these, others in zip(*batch.columns) for link in links(bucket.as_py(), these.values, others.values)]
            yield pa.RecordBatch.from_arrays([pa.array([link[i] for link in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def links(bucket: int, x: pa.StructArray, y: pa.StructArray) -> list[tuple[int, int]]:
        node, part = ([np.asarray(s.field(f)) for s in (x, y)] for f in ("node", "component"))
        sets: dict[tuple[int, int], np.ndarray] = {}

        def of(side: int, at: int) -> np.ndarray:
            if (side, at) not in sets:
                sets[side, at] = shingles(zlib.decompress((x, y)[side].field("packed")[at].as_py()).decode(), settings.words)
            return sets[side, at]

        linked, parts = [], _Parts()
        i, j = _not_ruled_out(bucket, x, y, settings)
        for p, q in zip(i.tolist(), j.tolist()):
            one, other = int(part[0][p]), int(part[1][q])
            if parts.of(one) != parts.of(other) and _is_link(of(0, p), of(1, q), settings):
                parts.join(one, other)
                linked.append((int(node[0][p]), int(node[1][q])))
        return linked

    placed = written(_placed(whole, F.struct(*fields, "packed")), "text-blocks")
    return _meetings(placed).mapInArrow(confirm, "a long, b long").distinct()


def _smallest_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``node`` and the ``least`` row of its component, for nodes with links; ``rows`` holds
    ``node`` and its ``row``.

    Components with more than a thousandth of these nodes, fewer than a thousand, are sent to every
    task; the others are joined by component.
    """
    linked = written(rows.join(labels, "node"), "linked-nodes")
    roots = written(linked.groupBy("component").agg(F.min("row").alias("least"), F.count("*").alias("n")), "component-rows")
    many = max(LARGE, linked.count() // 1000)
    large = roots.where(F.col("n") > many).select("component", F.col("least").alias("known"))
    told = linked.join(F.broadcast(large), "component", "left")
    others = told.where("known is null").join(roots.where(F.col("n") <= many), "component")
    return told.where("known is not null").select("node", F.col("known").alias("least")).unionByName(others.select("node", "least"))


# --------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``content`` (hash of its text), ``n_shingles``,
    ``component_id``, the smallest key reachable over links, ``kept``: whether that is its own, and
    ``first``: whether it has the smallest key and content of its component.

    Null and empty texts, and texts of white space, have no shingle, are linked with nothing and
    kept and first. Keys may repeat, so several texts of a component may be kept; only repeats of one
    row are first together. Rows with the same set are linked, whatever their keys. A null key is larger than any
    other: such a row is kept only if no row with a key is in its component. Other columns are not
    read.
    """
    spark = prepare(docs.sparkSession)
    signed = written(sign(docs, settings, key, text), "signatures")
    # A node is known by 64 bits of its digest, dealt anew should two digests ever share them.
    for salt in range(100):
        node = F.xxhash64(F.lit(salt), "digest")
        clash = signed.where("n_shingles > 0").groupBy(node.alias("node")).agg(F.min("digest").alias("x"), F.max("digest").alias("y"))
        if clash.where("x <> y").isEmpty():
            break
    signed = signed.withColumn("node", node)
    facts = signed.select("node", "content", "digest")
    nodes = written(signed.where("n_shingles > 0").dropDuplicates(["node"]).select("node", "n_shingles", "buckets", "sketch"), "nodes")

    rows = nodes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1")
    members = written(rows.join(shared, "bucket"), "shared-buckets")
    # A text that others were made from shares buckets with more of them than they do with each
    # other, so the node that meets most others is the one to compare a bucket with.
    met = members.groupBy("node").agg(F.sum("held").alias("met"))
    pivots = members.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    members = members.join(written(pivots, "pivots"), "bucket")
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("n_shingles").alias("n_pivot"))
    pairs = members.where("node <> pivot").select("node", "pivot", "n_shingles").distinct().join(sizes, "pivot")
    pairs = pairs.where(_size_allows(settings, "n_shingles", "n_pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    candidates = written(_pruned(pairs, nodes, settings), "near-candidates")

    # Of each node's candidates the likeliest is confirmed first; most others then lie in the same
    # component and need no look.
    texts = written(_packed_texts(docs, facts, members.select("node").distinct(), settings, text), "packed-texts")
    best = candidates.groupBy("b").agg(F.max_by("a", F.struct("equal", "a")).alias("a"))
    links = written(_confirmed(best, texts, settings), "near-links")
    labels = components(links)
    rest = candidates.join(best, ["a", "b"], "left_anti")
    links = written(links.unionByName(_confirmed(_apart(rest, labels), texts, settings)), "near-links")
    labels = components(links)

    across = written(_across(members, labels, nodes, texts, settings), "across-links")
    if not across.isEmpty():
        labels = components(links.unionByName(across))

    rows = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.isnull("key").alias("last"), "key", "content")).alias("row"))
    rows = written(rows, "node-rows")
    least = rows.join(_smallest_rows(rows, labels), "node", "left").select("node", F.coalesce("least", "row").alias("least"))
    least = least.select(F.col("node").alias("of_node"), F.col("least.key").alias("component_id"), F.col("least.content").alias("first_content"))
    joined = signed.select("key", "content", "n_shingles", "node").join(least, (F.col("node") == F.col("of_node")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    kept = F.col("key").eqNullSafe(component)
    first = kept & ((F.col("n_shingles") == 0) | (F.col("content") == F.col("first_content")))
    return joined.select(F.col("key").alias(key), "content", "n_shingles", component.alias("component_id"), kept.alias("kept"), first.alias("first"))
