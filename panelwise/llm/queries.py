"""The queries opN_<name>: each applies one operator to its whole table and derives the columns of
its contract from the operator's output. ``SQL`` holds the same in DuckDB where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import byte_bpe, language, line_dedup, merkle, minhash, mixing, periodic, quality, secrets, token_files, topk, toxicity, warc
from panelwise.llm.common import WORD, new_folder, prepare, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(make):
        QUERIES[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "tokens")
    shards = token_files.write_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    stored = token_files.read_documents(docs, folder, shards)
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("content")


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, line, i, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
repeated AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, line, i, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", OP3_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1),
j AS (SELECT p.*, first IS NOT NULL AND first <> page_id AS again, first FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM j
"""


@query("op5_warc", OP5_SQL)
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "warc")
    manifest = warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder, manifest, pages.schema["page_id"].dataType)
    # A record whose stored payload does not have its digest is not reported as good.
    digest = F.when(F.col("intact"), F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(
        encoded.select(
            F.struct(
                "doc_id",
                F.size("ids").cast("bigint").alias("n_tokens"),
                F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                F.xxhash64("starts", "ends").alias("offsets_hash"),
            ).alias("key"),
            "ids",
        ),
        ranks,
        key="key",
    )
    return decoded.select("key.*", F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
runs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
line AS (SELECT doc_id, source, t, unnest(ls) AS line FROM w),
keyed AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line),
held AS (SELECT source, k, count(DISTINCT t) AS held, min(doc_id) AS first FROM keyed WHERE k <> '' GROUP BY source, k),
shared AS (SELECT source, k, first FROM held WHERE held > 20),
removed AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+'))) AS n
  FROM keyed JOIN shared ON keyed.k = shared.k AND keyed.source IS NOT DISTINCT FROM shared.source WHERE doc_id <> first GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM keyed WHERE k <> '' GROUP BY doc_id),
counts AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed.n, 0) AS gone
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, b AS base_failed, NOT b AND n_words - gone >= 0.2 * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS b FROM counts)
"""


@query("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(table(spark, sf_dir, "documents"), share=0.0)
    return judged.drop("cleaned", "n_removed_words")


def _secret_sql() -> str:
    """Gaps and matches in turn give each rule's places."""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    hits = [
        f"""SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS n, g, m, s, {r.least} AS least FROM (
        SELECT doc_id, string_split_regex(t, {quoted(r.pattern)}) AS g, regexp_extract_all(t, {quoted(r.pattern)}) AS m,
        regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS s FROM d WHERE regexp_matches(t, {quoted(r.pattern)}))"""
        for i, r in enumerate(secrets.RULES)
    ]
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    hits AS ({" UNION ALL ".join(hits)}),
    sizes AS (SELECT doc_id, rule, kind, n, length(g[n]) AS gap, length(m[n]) AS size, length(s[n]) >= least AS good FROM hits),
    ends AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc_id, rule ORDER BY n) AS BIGINT) AS e FROM sizes),
    spans AS (SELECT doc_id, rule, kind, e - size AS b, kind || ':' || (e - size) || ':' || e AS span FROM ends WHERE good),
    per AS (SELECT doc_id, count(*) FILTER (rule = 0) AS a, count(*) FILTER (rule = 1) AS c, count(*) FILTER (rule = 2) AS h,
      string_agg(span, ',' ORDER BY b, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY b, rule) AS every FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN per USING (doc_id)
    """


@query("op6_secrets", _secret_sql())
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE_RULES))
    return found.select(
        "doc_id",
        *(count(r.kind) for r in secrets.BASE_RULES),
        F.sha2(secrets.written_spans(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written_spans(F.col("spans")).alias("spans"),
    )


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = toxicity.score_toxicity(docs, labels, learn_from=~held_out)
    score = F.col("score")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score, (score >= 0.3).cast("int").alias("predicted"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
runs AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op7_minhash_near_dedup", OP7_SQL)
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = minhash.Settings(words=3, percent=85)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), settings).drop("content", "first")


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op4_exact_top_k", OP4_SQL)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    rows = rows.select("vec_id", topk.floored("embedding", 256.0).alias("vector"))
    best = topk.exact_top_k(rows, F.col("vec_id") % 50 == 0, k=5)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("bigint").alias("score"))


#: CRC-32 of a decimal doc_id, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1))), lambda r, b: xor(r >> 1, (xor(r, b) & 1) * 3988292384), 4294967295))"""


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(parts)})"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
  {_leaf_sql("CASE WHEN " + CRC_SQL + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS other FROM documents),
leaves AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
up AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 8, n),
-- The root of a tree is a leaf of the uppermost tree, and goes by the name it has there.
every AS (SELECT tree, level, up.pos, up.n, up.h, CASE WHEN up.n = 1 THEN '^/0/' || s.pos ELSE tree || '/' || level || '/' || up.pos END AS name FROM up JOIN subroots s USING (tree)
  UNION ALL SELECT '^', level, pos, n, h, '^/' || level || '/' || pos FROM top),
steps AS (SELECT a.name, p.name AS parent, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos) AS l, string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos) AS r
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 JOIN every p ON p.tree = a.tree AND p.level = a.level + 1 AND p.pos = a.pos // 8 GROUP BY 1, 2),
walk AS (SELECT doc_id, leaf, leaves.tree, name, other AS h, '' AS proof FROM leaves JOIN every ON every.tree = leaves.tree AND every.level = 0 AND every.pos = leaves.pos
  UNION ALL SELECT doc_id, leaf, tree, parent, sha256(coalesce(l, '') || walk.h || coalesce(r, '')), proof || coalesce(l, '') || coalesce(r, '') FROM walk JOIN steps USING (name))
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, walk.h AS folded_root, walk.h = root.h AS verified
FROM walk JOIN subroots s USING (tree) JOIN every root ON root.tree = '^' AND root.n = 1 AND walk.name = root.name
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    trees = merkle.build_manifest(docs, fields, "lang", "doc_id", {"other": merkle.leaf_digest([*fields[:-1], tampered])})
    folded = merkle.fold_proof(F.col("carried.other"), F.col("proof"))
    proved = trees.proofs().select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, {CRC_SQL} AS h, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a, coalesce(h % 10 = 0, FALSE) AND len(ws) > 0 AS again, 3 + (h // 10) % 8 AS parts FROM t),
w AS (SELECT doc_id, CASE WHEN again THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END]) ELSE ws END AS ws FROM s),
-- Words that are the same q words later stand five and more in a row in every run.
five AS (SELECT doc_id, i, hash(ws[i + 1:i + 5]) AS x, len(ws) AS n FROM (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS i FROM w)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM five a JOIN five b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS b, count(*) + 4 + q AS size FROM islands GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, b, size, min(q) AS q FROM stretches GROUP BY doc_id, b, size),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(size AS DOUBLE) / q DESC, b, q) = 1),
listed AS (SELECT doc_id, count(*) AS n, string_agg(b || ',' || size || ',' || q || chr(10), '' ORDER BY b, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(b + q, b + size)) AS i FROM runs),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM runs)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(listed.n, 0) AS n_runs, b AS "start", size AS length, q AS period, CAST(1000 * size // q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(CASE WHEN listed.n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept.t, '') END) AS collapsed_sha256
FROM w LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    # Some texts repeat themselves from word ``first`` on, every ``period`` words.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    again = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(WORD)
    words = docs.withColumn("words", F.when(again, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    g, n = F.floor(h / 10).cast("bigint"), F.size("words").cast("bigint")
    placed = words.withColumns({"n": n.cast("int"), "first": (g % n).cast("int")})
    placed = placed.withColumn("period", 1 + F.floor((F.col("n") - F.col("first")) / (3 + g % 8)).cast("int"))
    rest = F.col("n") - F.col("first")
    block = F.slice("words", F.col("first") + 1, F.col("period"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("period")).cast("int"))), F.lit(1), rest)
    repeated = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("first")), tail), " ")
    found = periodic.periodic_runs(placed.withColumn("text", F.when(F.col("words").isNotNull(), repeated).otherwise(F.col("text"))))
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get(best, F.lit(0))
    return found.select(
        "carried.doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    found = language.predict_language(docs, ~F.col("held_out"), carry=("doc_id", "held_out"))
    return found.select("carried.*", "lang_pred", "score")
