"""Mix sources to target weights by apportionment.

A mixture is a number of blocks of equal size in words. Sainte-Laguë gives the blocks to sources,
and each source's blocks to its shards, one after another to the highest quotient
``weight / (2 * seats + 1)``. In a shard, documents lie end to end in a seeded order and are cut
into blocks; the shard's quota is its first blocks, round after round.

Documents, hosts of sources and shards are only ever summed; a source with a third of all rows has
as many shards as its share asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwise.llm.common import partitions, prepare, text_or_empty, word_count
from panelwise.operators.ranking import small_table
from panelwise.session import written

#: Rows of a shard, and the most shards of all sources; set by the rows alone, so that the mixture
#: is the same whatever the session's number of partitions.
SHARD_ROWS, MOST_SHARDS = 512, 1 << 16
#: The smallest target holds at least so many blocks, where words are the limit.
LEAST_BLOCKS = 1024
MOST_BLOCK_WORDS = 1024
SEED = 17


def apportion(units: DataFrame, group: str | None, seats: str, weight: str, most: str, order: str) -> DataFrame:
    """Add ``quota``: the Sainte-Laguë share of each row in its group's ``seats``.

    ``seats`` and ``group`` name columns (one group of all rows if None), ``most`` a column with
    the most seats a row can get; equal quotients go to the smaller ``order``.

    Every row's number of seats lies within half a seat per row of the group, shared by weight,
    of its exact share, and one more. What is below is given at once, and only the few quotients
    in between are ordered.
    """
    together = Window.partitionBy(group) if group else None
    if together is not None:
        total, rows = F.sum(weight).over(together), F.count("*").over(together)
        units = units.withColumn("__total", total).withColumn("__rows", rows)
    else:
        all_rows = units.agg(F.sum(weight).alias("t"), F.count("*").alias("n")).first()
        units = units.withColumn("__total", F.lit(float(all_rows["t"] or 0))).withColumn("__rows", F.lit(all_rows["n"]))
    share = F.when(F.col("__total") > 0, F.col(weight) / F.col("__total")).otherwise(0.0)
    exact, slack = F.col(seats) * share, F.col("__rows") * share / 2
    units = units.withColumn("__low", F.least(F.greatest(F.floor(exact - slack) - 1, F.lit(0)), F.col(most)))
    units = units.withColumn("__high", F.least(F.ceil(exact + slack) + 1, F.col(most)))
    wanted = units.where(F.col("__high") > F.col("__low")).select(
        *([group] if group else []), order, (F.col(weight) * 1.0).alias("__w"), F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k"), F.col(seats).alias("__seats")
    )
    quotient = wanted.withColumn("__q", F.col("__w") / (2 * F.col("__k") + 1))
    by = [F.desc("__q"), order, "__k"]
    if together is not None:
        given = units.groupBy(group).agg(F.sum("__low").alias("__given"))
        ranked = quotient.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*by)))
        won = ranked.join(given, group).where(F.col("__place") <= F.col("__seats") - F.col("__given"))
        keys = [group, order]
    else:
        row = units.agg((F.max(seats) - F.sum("__low")).alias("left")).first()
        won = quotient.orderBy(*by).limit(max(0, int(row["left"] or 0)))
        keys = [order]
    extra = won.groupBy(*keys).agg(F.count("*").alias("__extra"))
    quota = (F.col("__low") + F.coalesce("__extra", F.lit(0))).cast("bigint")
    return units.join(extra, keys, "left").withColumn("quota", quota).drop("__total", "__rows", "__low", "__high", "__extra")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``number``: 0, 1, 2, ... by code point, null last, from ranges of sources."""
    last = F.isnull("source")
    parts = sources.repartitionByRange(partitions(sources.sparkSession), last, "source")
    parts = written(parts.withColumn("part", F.spark_partition_id()), "sources")
    offsets, before = {}, 0
    for row in parts.groupBy("part").count().orderBy("part").collect():  # one row per partition
        offsets[row["part"]] = before
        before += row["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("part")) if offsets else F.lit(0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(last, "source"))
    return parts.withColumn("number", (start + place - 1).cast("bigint")).drop("part")


def _with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, repeats: float) -> DataFrame:
    """Add ``target``: weighted shares, none above ``repeats`` times its source's size.

    A source is closed at its limit while the level (words per weight) is above that; what closed
    sources leave over raises the level of the others. The level only rises, so each round is one
    sum over the sources.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights)).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("most", repeats * F.col("source_size")), "source-weights")
    total, level, closed = share * (sources.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:
        at_limit = F.col("most") < level * F.col("weight")
        row = sources.agg(
            F.sum(F.when(at_limit, F.col("most")).otherwise(0.0)).alias("taken"), F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(at_limit).alias("closed")
        ).first()
        if row["closed"] == closed or not row["open"]:
            break
        closed, level = row["closed"], (total - row["taken"]) / row["open"]
    return sources.withColumn("target", F.least(F.col("most"), level * F.col("weight")))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``key``, ``content`` (hash of its text), ``size`` in words,
    ``source_size``, ``target`` of its source, and ``taken``, the words the mixture takes.

    Sources in code point order, null last, have the ``weights`` in turn and share ``share`` times
    all words; no source's target is above ``repeats`` times its words, and no document is taken
    more often. A null or empty text has no words and none are taken. A rerun takes the same words;
    of repeated rows it may take more from one than from another, but always as much in all. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    value = text_or_empty(text)
    sized = written(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(value).alias("size"), F.xxhash64(value).alias("content")), "sizes")
    sources = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    sources = _with_targets(sources, weights, share, repeats)
    facts = sources.agg(F.sum("rows").alias("rows"), F.sum("target").alias("target"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    least = facts["least"] or 0.0
    block = min(MOST_BLOCK_WORDS, 1 << max(0, int(least / LEAST_BLOCKS).bit_length() - 1))
    blocks = lambda size: F.ceil(repeats * F.col(size) / block)
    sources = sources.withColumn("seats", F.lit(round((facts["target"] or 0.0) / block))).withColumn("most", blocks("source_size"))
    sources = apportion(sources, None, "seats", "target", "most", "number")
    shards = F.ceil(F.col("rows") * min(1 / SHARD_ROWS, MOST_SHARDS / max(1, facts["rows"] or 0)))
    sources = small_table(written(sources.select(F.col("source").alias("of"), "number", "source_size", "target", F.col("quota").alias("seats"), shards.alias("shards")), "source-quotas"))

    dealt = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    dealt = dealt.withColumn("mixed", F.xxhash64(F.lit(seed), "id", "content")).withColumn("shard", F.pmod(F.col("mixed"), F.col("shards")))
    per_shard = dealt.groupBy("number", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats")).withColumn("most", blocks("words"))
    quotas = apportion(per_shard, "number", "seats", "words", "most", "shard")
    quotas = quotas.select("number", "shard", "words", F.least(F.col("quota") * block, repeats * F.col("words")).alias("taken_here"))

    order = Window.partitionBy("number", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mixed"), "id", "content", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["number", "shard"])
    rounds = F.when(F.col("words") > 0, F.floor(F.col("taken_here") / F.col("words"))).otherwise(0)
    rest = F.col("taken_here") - rounds * F.col("words")
    more = F.greatest(F.least("end", rest) - (F.col("end") - F.col("size")), F.lit(0))
    return placed.select(F.col("id").alias(key), "content", "size", "source_size", "target", (rounds * F.col("size") + more).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes its words. What is over
    whole times counts as one more with its share of the document as the probability, by a seeded
    hash, so that documents of every length come as often as the mixture asks on average; one
    without words is left out."""
    taken = mix(docs, key, text, source, **options).groupBy(key, "content").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    draw = F.pmod(F.xxhash64(F.lit(options.get("seed", SEED) + 2), key, "content"), F.lit(1 << 30)) / (1 << 30)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(0).cast("int")
    taken = taken.select(F.col(key).alias("__id"), F.col("content").alias("__content"), times.alias("__times"))
    own = docs.select("*", F.xxhash64(text_or_empty(text)).alias("__own"))
    joined = own.join(taken.where("__times > 0"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__content")))
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__time")).drop("__time")
