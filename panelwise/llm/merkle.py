"""Merkle trees over a table, with a proof for every row, by time-forward processing.

A node sends its digest as a message to its parent, and messages are worked off in the order of the
receiving node's label (level, then index). Labels ascend from the leaves to the root, so that all
messages of a node are there when its turn comes. A second sweep runs the labels backwards: a node
sends each child the part of the proof above it.

The queue has two parts. Between blocks of nodes it is a table: its rows are shuffled and sorted by
the block that receives them, which spills to disk as need be. Inside a block of ``fanout ** LEVELS``
nodes it is a heap, whose size that number bounds. A tree of a billion leaves takes four blocks on
the way up; nothing of the table passes through the driver but the size of the largest tree.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from panelwise.llm.common import partitions, prepare
from panelwise.session import written

#: Levels of a tree that one block of nodes folds at a time.
LEVELS = 3
#: Characters of a digest.
WIDTH = 64

STEPS = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("siblings", T.StringType())]))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, as lowercase hexadecimal text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    return digest(*[field(F.col(f) if isinstance(f, str) else f) for f in fields])


def fold_proof(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    step = lambda own, s: digest(
        F.substr(s["siblings"], F.lit(1), s["slot"] * WIDTH), own, F.substr(s["siblings"], s["slot"] * WIDTH + 1)
    )
    return F.aggregate(proof, leaf, step)


def proof_text(proof: Column) -> Column:
    """All siblings of a proof, from the leaf's to the root's children."""
    return F.array_join(F.transform(proof, lambda s: s["siblings"]), "")


# --------------------------------------------------------------------------------------------
# one block of nodes


def depth(nodes: int, fanout: int) -> int:
    """Levels until one node is left."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Digests of a block's nodes, level by level from the given ones. Nodes take their turns in
    the order of (level, index); a node's inbox are the messages with its label."""
    done: list[list[str]] = [list(digests)] + [[] for _ in range(levels)]
    queue = [(1, i // fanout, i % fanout, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    while queue:
        level, index, _, first = heapq.heappop(queue)
        inbox = [first]
        while queue and queue[0][:2] == (level, index):
            inbox.append(heapq.heappop(queue)[3])
        own = hashlib.sha256("".join(inbox).encode()).hexdigest()
        done[level].append(own)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // fanout, index % fanout, own))
    return done


def sweep_down(nodes: list[list[str]], suffix: tuple, fanout: int) -> list[tuple]:
    """The proof of each node of a block's lowest level: its steps in the block, then ``suffix``.
    Labels descend; a node sends each child that child's step before its own proof."""
    queue: list[tuple] = [(1 - len(nodes), 0, suffix)]
    proofs: list[tuple] = [()] * len(nodes[0])
    while queue:
        level, index, above = heapq.heappop(queue)
        if level == 0:
            proofs[-index] = above
            continue
        first = -index * fanout
        run = nodes[-level - 1][first : first + fanout]
        for slot in range(len(run)):
            step = (slot, "".join(run[:slot] + run[slot + 1 :]))
            heapq.heappush(queue, (level + 1, -(first + slot), (step, *above)))
    return proofs


def _levels(n: int, fanout: int) -> int:
    """Levels that a block folds in a tree that has n nodes left."""
    return min(LEVELS, depth(n, fanout))


# --------------------------------------------------------------------------------------------
# trees


def place(rows: DataFrame, order: Sequence[str], partitions_: int) -> DataFrame:
    """``rows`` (column ``tree`` and others, written) with ``pos``, a row's number in its tree by
    ``order``, and ``n``, the tree's size.

    Rows are sorted over the cluster; the offset of a tree in a range of rows follows from counts.
    Equal rows may lie in any order, so they are spread by where they were read.
    """
    spread = rows.withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    by = ["tree", *order]
    ranged = spread.repartitionByRange(partitions_, *by, "spread").sortWithinPartitions(*by).drop("spread")
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33)
    heads = numbered.groupBy("tree", part.alias("part")).agg(F.min("at").alias("head"), F.count("*").alias("rows"))
    # One row of ``heads`` per tree and range: a window over a tree has at most as many as ranges.
    earlier = W.Window.partitionBy("tree").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = heads.select(
        "tree", "part", "head", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(W.Window.partitionBy("tree")).alias("n")
    )
    joined = numbered.withColumn("part", part).join(offsets, ["tree", "part"])
    return joined.withColumn("pos", F.col("at") - F.col("head") + F.col("before")).drop("at", "part", "head", "before")


def _fold_blocks(nodes: DataFrame, fanout: int) -> DataFrame:
    """One block of levels up: (tree, pos, n, digest) of the nodes that remain."""
    size = fanout**LEVELS

    def fold(key: tuple, block: pa.Table) -> pa.Table:
        order = block.sort_by("pos")
        n = order["n"][0].as_py()
        top = sweep_up(order["digest"].to_pylist(), _levels(n, fanout), fanout)[-1]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // size)], "digest": top}, schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    block = F.floor(F.col("pos") / size).cast("bigint").alias("block")
    keyed = nodes.select("tree", block, "pos", "n", "digest")
    return keyed.groupBy("tree", "block").applyInArrow(fold, "tree string, pos bigint, n bigint, digest string")


def _deliver(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """One block of levels down: ``nodes`` with ``proof`` and ``ends``, from the rows of the nodes
    that their blocks were folded into."""
    size = fanout**LEVELS
    schema = T.StructType([*nodes.schema.fields, T.StructField("proof", STEPS), T.StructField("ends", above.schema["ends"].dataType)])

    def deliver(block: pa.Table, top: pa.Table) -> pa.Table:
        order = block.drop_columns("block").sort_by("pos")
        suffix = tuple((s["slot"], s["siblings"]) for s in top["proof"][0].as_py())
        up = sweep_up(order["digest"].to_pylist(), _levels(order["n"][0].as_py(), fanout), fanout)
        proofs = sweep_down(up, suffix, fanout)
        steps = [s for p in proofs for s in p]
        ends = [0]
        for p in proofs:
            ends.append(ends[-1] + len(p))
        flat = pa.StructArray.from_arrays([pa.array([s for s, _ in steps], pa.int32()), pa.array([x for _, x in steps], pa.string())], ["slot", "siblings"])
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        same = pa.chunked_array([top["ends"].combine_chunks().take(pa.array([0] * len(order), pa.int32()))])
        return order.append_column("proof", proof).append_column("ends", same)

    block = F.floor(F.col("pos") / size).cast("bigint").alias("block")
    left = nodes.select("*", block).groupBy("tree", "block")
    right = above.select("tree", F.col("pos").alias("block"), "proof", "ends").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(deliver, schema)


def _climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The nodes at every block boundary, from the leaves to one node per tree; each written."""
    stages, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        stages.append(written(_fold_blocks(stages[-1].select("tree", "pos", "n", "digest"), fanout), "merkle-nodes"))
        most = -(-most // fanout**LEVELS)
    return stages


def _descend(stages: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Proofs of the lowest stage's nodes, from the proofs of the highest (tree, pos, proof, ends)."""
    for i, nodes in enumerate(reversed(stages[:-1])):
        lower = _deliver(nodes, tops, fanout)
        tops = lower if i == len(stages) - 2 else written(lower.select("tree", "pos", "proof", "ends"), "merkle-proofs")
    return tops


@dataclass
class Manifest:
    """Trees of a table: ``stages`` hold the nodes at block boundaries (tree, pos, n, digest; the
    lowest also the rows' own columns), ``roots`` the same for the tree over the trees' roots."""

    stages: list[DataFrame]
    roots: list[DataFrame]
    fanout: int

    def proofs(self) -> DataFrame:
        """Every row with ``subroot``, ``root`` and ``proof``, its steps from the leaf to the root."""
        # The highest root stage has one row: the root, proved by nothing.
        ends = F.struct(F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        root = self.roots[-1].select("tree", "pos", F.array().cast(STEPS).alias("proof"), ends.alias("ends"))
        if len(self.roots) > 1:
            proved = _descend(self.roots, root, self.fanout)
        else:  # one tree at most: its root is the root
            proved = self.roots[0].withColumns({"proof": F.array().cast(STEPS), "ends": ends})
        subroots = proved.select(
            F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "proof", F.struct(F.col("digest").alias("subroot"), "ends.root").alias("ends")
        )
        leaves = self.stages[0]
        if len(self.stages) > 1:
            found = _descend(self.stages, written(subroots, "merkle-proofs"), self.fanout)
        else:  # every tree is one leaf
            found = leaves.join(subroots.drop("pos"), "tree")
        return found.select("*", "ends.subroot", "ends.root").drop("ends", "pos", "n", "tree")


def build_manifest(rows: DataFrame, fields: Sequence[str], tree: str, key: str, carry: dict[str, Column] | None = None, fanout: int = 8) -> Manifest:
    """Trees over ``rows``: one per value of ``tree``, its leaves in ascending order of ``key``, and
    one over their roots in order of ``tree``.

    A leaf is the digest of ``fields``, null or not. A null ``tree`` is a tree of its own and comes
    first, as a null ``key`` does among its leaves. Rows with the same key follow each other by
    leaf; equal rows are leaves each. Of other columns, however named, only ``carry`` (name to
    expression) is kept, as the struct ``carried``. An empty table gives a manifest without nodes
    and proofs without rows.
    """
    spark = prepare(rows.sparkSession)
    # Text whose order in bytes is that of the values, null first, and that is never null.
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    kept = {"none": F.lit(0)} | (carry or {})
    leaves = rows.select(
        name.alias("tree"), F.col(key).alias("key"), leaf_digest(fields).alias("digest"), F.struct(*[c.alias(n) for n, c in kept.items()]).alias("carried")
    )
    placed = written(place(leaves, ["key", "digest"], partitions(spark)), "merkle-leaves")
    stages = _climb(placed, fanout)
    tops = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    roots = _climb(written(place(tops, ["of"], partitions(spark)), "merkle-roots"), fanout)
    return Manifest(stages, roots, fanout)
