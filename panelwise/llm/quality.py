"""Quality rules: counts within each text, and lines that too many documents of a host share.

Only DataFrame functions. A line is known by its hash within its host; hosts and lines are counted
in partial sums before anything is shuffled, so a host with a third of all rows, or a line that
half of them hold, is no larger than any other when it arrives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import SPACE, SPACE_CHARS, prepare, text_or_empty
from panelwise.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = "#*$%&|<>"
#: Lines over the limits, over all hosts, up to which they are sent to every task (about 5 MB);
#: beyond that the join shuffles both sides. A limit of a share of a host's texts allows at most
#: (lines per text / share) such lines per host; a limit in texts alone lets them grow with the host.
SMALL = 100_000


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), 0)


def words_of(text: Column) -> Column:
    """The words of a text; a text without any gives one empty string."""
    return F.split(F.btrim(text, F.lit(SPACE_CHARS)), f"[{SPACE}]+")


def _windows(words: Column) -> Column:
    """A hash of each run of three words."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.slice(h, 3, F.greatest(F.size(h) - 2, F.lit(0))), lambda last, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), last))
    return _bound(each, runs)


def repeated_words(words: Column) -> Column:
    """Number of words inside runs of three that a text holds twice or more."""

    def covered(windows: Column) -> Column:
        # Equal hashes meet when sorted; the places of those with an equal neighbour, in order,
        # each cover the three words from there that the place before does not.
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
            return F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"])

        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("bigint").alias("n"))
        step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(i - a["at"], F.lit(3))).alias("n"))
        count = lambda at: F.aggregate(F.sort_array(at), start, step, lambda a: a["n"])
        return _bound(_bound(ordered, places), count)

    none = F.lit(0).cast("bigint")
    return _bound(_windows(words), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(covered(w)))


def with_counts(docs: DataFrame, text: str) -> DataFrame:
    """Add the counts of the base rules; a null text counts as empty."""
    value = text_or_empty(text)
    solid = F.filter(F.split(value, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    empty = F.btrim(value, F.lit(SPACE_CHARS)) == ""
    counts = _bound(
        words_of(value),
        lambda w: F.struct(F.when(empty, 0).otherwise(F.size(w)).cast("bigint").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    return (
        docs.withColumn("counts", counts)
        .withColumn("word_chars", F.length(F.translate(value, SPACE_CHARS, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_dup_lines", _bound(solid, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("bigint"))
    )


def line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(F.translate(line, UPPER, LOWER), F.lit(SPACE_CHARS)))


def shared_lines(docs: DataFrame, least_texts: int, share: float) -> DataFrame:
    """``host``, ``line`` and ``first`` of the lines that more than ``share`` of a host's different
    texts, and more than ``least_texts``, hold; ``first`` is the smallest id with the line.

    Different documents are different texts: a text that was copied is one document here, so
    copies do not make their own lines suspicious.
    """
    keys = F.array_distinct(F.transform(F.split("text", "\n"), line_key))
    # The same text gives the same rows here, so they merge before the shuffle where they can.
    lines = docs.select("host", "content", "id", F.explode(keys).alias("line")).where(F.col("line") != line_key(F.lit("")))
    per_text = lines.groupBy("host", "line", "content").agg(F.min("id").alias("id"))
    counted = per_text.groupBy("host", "line").agg(F.count("*").alias("held"), F.min("id").alias("first")).where(F.col("held") > least_texts)
    if share:
        texts = docs.groupBy("host", "content").agg(F.min("id").alias("id"))
        per_host = texts.groupBy("host").agg(F.count("*").alias("texts")).select(F.col("host").alias("of_host"), "texts")
        counted = counted.join(per_host, F.col("host").eqNullSafe(F.col("of_host"))).where(F.col("held") > share * F.col("texts"))
    return counted.select("host", "line", "first")


def apply_rules(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    least_words: int = 50,
    most_repeated: int = 50,
    least_texts: int = 20,
    share: float = 0.1,
    depleted: float = 0.2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: the columns ``carry`` in the struct ``carried``, ``key``, the counts, ``base_failed``,
    ``n_removed_words``, ``kept`` and ``cleaned``, the text without the host's shared lines.

    The base rules fail a text of fewer than ``least_words`` words, or with more than
    ``most_repeated`` percent of them inside repeated runs of three. A line is shared if more than
    ``least_texts`` different texts of its host, and more than ``share`` of them, hold it (A-Z
    lower-cased, white space at the ends left off, lines without text apart); a ``share`` of 0
    leaves the number alone as the limit, whatever the size of the host. It is removed
    everywhere but from the document with the smallest key, so nothing is lost altogether. A
    document is rejected if the base rules fail it or less than ``depleted`` of its words is left.

    A null or empty text has no words and fails. Null hosts are one host, a null key comes after
    all others. Repeated rows are judged alike, each returned; other columns are not read.
    """
    prepare(docs.sparkSession)
    lines = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), text_or_empty(text).alias("text"))
    lines = lines.withColumn("content", F.xxhash64("text"))
    shared = written(shared_lines(lines, least_texts, share), "shared-lines")
    if shared.count() <= SMALL:
        shared = F.broadcast(shared)
    shared = shared.select(F.col("host").alias("of_host"), F.col("line").alias("known"), "first")
    found = (
        lines.select("id", "host", "content", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("known", line_key(F.col("line")))
        .join(shared, ["known"])
        .where(F.col("host").eqNullSafe(F.col("of_host")) & ~F.col("id").eqNullSafe(F.col("first")))
        .withColumn("words", F.regexp_count("line", F.lit(f"[^{SPACE}]+")).cast("bigint"))
        .groupBy("id", "content", "at")  # repeated rows find their lines more than once
        .agg(F.max("words").alias("words"))
        .groupBy("id", "content")
        .agg(F.sum("words").alias("removed"), F.collect_list("at").alias("places"))
        .select(F.col("id").alias("of_id"), F.col("content").alias("of_content"), "removed", "places")
    )
    value = text_or_empty(text)
    base = docs.select(F.struct(*carry, F.lit(None).cast("int").alias("_")).alias("carried"), F.col(key).alias("id"), value.alias("text"))
    base = with_counts(base.withColumn("content", F.xxhash64("text")), "text")
    # Only documents with shared lines have a partner; the others' rows are few columns wide
    # unless the text is asked for.
    joined = base.join(found, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("content") == F.col("of_content")), "left")
    n, again = F.col("counts.n_words"), F.col("counts.n_repeat_words")
    removed = F.coalesce("removed", F.lit(0).cast("bigint"))
    failed = (n < least_words) | (100 * again > most_repeated * n)
    stay = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("places", i))
    return joined.select(
        *(["carried"] if carry else []),
        F.col("id").alias(key),
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        again.alias("n_repeat_words"),
        failed.alias("base_failed"),
        removed.alias("n_removed_words"),
        (~failed & (n - removed >= depleted * n)).alias("kept"),
        F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("cleaned"),
    )
