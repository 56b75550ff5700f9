"""Find secrets in texts by an inverted index of trigrams.

Each rule is a regular expression. What it cannot match without is derived as a Boolean query over
trigrams; posting lists are intersected and united as the query says, and only the texts that are
left are searched with the expression itself. A rule that needs no trigram searches every text.

Only DataFrame functions touch the data. A text is known by its hash: copies share their postings
and are searched once, and texts with the same hash are both searched, so no hit depends on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwise.llm.common import prepare, text_or_empty
from panelwise.session import written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run is matched whole or not at all, so its length can stand in the expression.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Candidate texts up to which their hashes are sent to every task (8 bytes each).
SMALL = 200_000
#: Texts per block of a posting list.
BLOCK = 8192
_MOST_STRINGS, _MOST_CLASS = 64, 8


# --------------------------------------------------------------------------------------------
# from an expression to a query over trigrams: True (anything), a trigram, or ("and" | "or", parts)


def trigram_query(pattern: str):
    """A query that every text with a match fulfils, over trigrams in lower case."""
    exact, query = _needs(parser.parse(pattern))
    return _both(query, _of_strings(exact))


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _both(a, b):
    parts = [x for x in (a, b) if x is not True]
    return True if not parts else parts[0] if len(parts) == 1 or parts[0] == parts[1] else ("and", tuple(parts))


def _of_strings(strings: set[str] | None):
    """One of the strings is there."""
    if strings is None or any(len(s) < 3 for s in strings):
        return True
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(other < s for other in sets)]
    alternatives = sorted(("and", tuple(sorted(s))) if len(s) > 1 else next(iter(s)) for s in least)
    return alternatives[0] if len(alternatives) == 1 else ("or", tuple(alternatives))


def _needs(items) -> tuple[set[str] | None, object]:
    """The strings a part stands for if they are few, else None; and what it needs besides."""
    exact: set[str] | None = {""}
    run: set[str] = {""}  # the strings since something was not exact
    query: object = True
    for op, value in items:
        strings, more = _needs_one(op, value)
        query = _both(query, more)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            query, exact = _both(query, _of_strings(run)), None
            run = strings or {""}
    if exact is None:
        return None, _both(query, _of_strings(run))
    return run, query


def _needs_one(op, value) -> tuple[set[str] | None, object]:
    if op is code.LITERAL:
        return {chr(value).lower()}, True
    if op is code.IN:
        members: set[str] = set()
        for kind, v in value:
            if kind is code.LITERAL:
                members.add(chr(v).lower())
            elif kind is code.RANGE and v[1] - v[0] < _MOST_CLASS:
                members |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, True
        return (members, True) if len(members) <= _MOST_CLASS else (None, True)
    if op is code.SUBPATTERN:
        return _needs(value[-1])
    if op is code.BRANCH:
        found = [_needs(branch) for branch in value[1]]
        if all(strings is not None and more is True for strings, more in found):
            return set().union(*(strings for strings, _ in found)), True
        queries = [_both(more, _of_strings(strings)) for strings, more in found]
        return None, True if True in queries else ("or", tuple(queries))
    if op in (code.MAX_REPEAT, code.MIN_REPEAT):
        least, most, part = value
        strings, more = _needs(part)
        if strings is not None and more is True and most == 1:
            return strings | ({""} if least == 0 else set()), True
        return None, True if least == 0 else _both(more, _of_strings(strings))
    if op is code.AT:
        return {""}, True
    return None, True


# --------------------------------------------------------------------------------------------
# index


def build_index(docs: DataFrame, trigrams: set[str], text: str = "text") -> DataFrame:
    """Posting lists: ``trigram``, ``block``, ``texts`` (hashes), for the given trigrams.

    Lists are cut into blocks of texts, so that of a trigram that most texts hold is not one row.
    """
    rows = docs.count()
    value = text_or_empty(text)
    low = F.lower(value)
    present = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in sorted(trigrams)]))
    content = F.xxhash64(value)
    postings = docs.select(content.alias("content"), F.explode(present).alias("trigram"))
    block = F.pmod(F.xxhash64("content"), F.lit(rows // BLOCK + 1))
    return postings.groupBy("trigram", block.alias("block")).agg(F.collect_set("content").alias("texts"))


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """``content`` and ``kinds``: the texts that fulfil each query, block by block."""
    needed = sorted(set().union(*map(trigrams_of, queries.values())))
    lists = [F.coalesce(F.first(F.when(F.col("trigram") == t, F.col("texts")), ignorenulls=True), F.array().cast("array<bigint>")).alias(t) for t in needed]
    blocks = index.groupBy("block").agg(*lists)

    def evaluate(query) -> Column:
        if isinstance(query, str):
            return F.col(f"`{query}`")
        return reduce(F.array_intersect if query[0] == "and" else F.array_union, map(evaluate, query[1]))

    def labelled(kind: str) -> Column:
        return F.transform(evaluate(queries[kind]), lambda c: F.struct(c.alias("content"), F.lit(kind).alias("kind")))

    each = blocks.select(F.inline(F.concat(*map(labelled, queries))))
    return each.groupBy("content").agg(F.collect_set("kind").alias("kinds"))


# --------------------------------------------------------------------------------------------
# search


def _hits(rule: Rule, number: int, text: Column) -> Column:
    """All matches of one rule in a text: length of what lies before each since the last, its own
    length, and whether it is long enough."""
    of = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    parts = F.struct(F.split(text, rule.pattern).alias("gaps"), of(0).alias("found"), of(rule.group).alias("secrets"))
    each = lambda p: F.transform(
        p["found"],
        lambda m, i: F.struct(
            F.lit(number).alias("rule"), i.alias("at"), F.length(F.get(p["gaps"], i)).alias("gap"), F.length(m).alias("size"), (F.length(F.get(p["secrets"], i)) >= rule.least).alias("good")
        ),
    )
    return F.get(F.transform(F.array(parts), each), 0)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and ``spans``, an array of (``start``, ``rule``, ``end``,
    ``kind``) in characters, end exclusive, by start and then by the order of the rules.

    Each rule's matches are the leftmost that do not overlap; those with too short a secret are
    dropped after that. A null or empty text has none. Null keys and repeated rows come back as
    they are; other columns are not read.
    """
    prepare(docs.sparkSession)
    value = text_or_empty(text)
    texts = docs.select(F.xxhash64(value).alias("content"), value.alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q is not True}
    if indexed:
        index = written(build_index(docs, set().union(*map(trigrams_of, indexed.values())), text), "trigram-index")
        wanted = written(candidates(index, indexed), "secret-candidates")
        wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
        texts = texts.join(wanted, "content", "left")
    else:
        texts = texts.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<rule:int,at:int,gap:int,size:int,good:boolean>>")
    searched = []
    for number, rule in enumerate(rules):
        chosen = F.array_contains("kinds", rule.kind) if rule.kind in indexed else F.lit(True)
        searched.append(F.when(chosen & F.col("text").rlike(rule.pattern), _hits(rule, number, F.col("text"))).otherwise(none))
    hits = texts.select("content", F.xxhash64(F.lit(1), "text").alias("check"), F.inline(F.concat(*searched)))
    # Copies of a text give the same hits; one of each is enough.
    hits = hits.groupBy("content", "check", "rule", "at").agg(F.max("gap").alias("gap"), F.max("size").alias("size"), F.max("good").alias("good"))
    so_far = Window.partitionBy("content", "check", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = hits.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    kind = F.get(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end", kind.alias("kind"))
    spans = ends.where("good").groupBy("content", "check").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # Written, so that the join can split a text that a large share of all documents copies.
    spans = written(spans.select(F.col("content").alias("of"), F.col("check").alias("of_check"), "spans"), "spans")
    keys = docs.select(F.col(key).alias("key"), F.xxhash64(value).alias("content"), F.xxhash64(F.lit(1), value).alias("check"))
    joined = keys.join(spans, (F.col("content") == F.col("of")) & (F.col("check") == F.col("of_check")), "left")
    return joined.select(F.col("key").alias(key), F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
