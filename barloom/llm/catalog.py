"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, chat, licenses, lines, mixing, pieces, rules, runs, sharding, simhash, token_counts, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return wrap


SHARDS = [f"shard-{k:03d}" for k in range(64)]


@query(
    "op6_sharding",
    f"""
WITH RECURSIVE s AS (
 SELECT i, printf('shard-%03d', i) AS shard, ('0x' || md5(printf('shard-%03d', i))[1:8])::BIGINT % {sharding.SLOTS} AS first,
  ('0x' || md5(printf('shard-%03d', i))[9:16])::BIGINT % {sharding.SLOTS - 1} + 1 AS step FROM range({len(SHARDS)}) r(i)),
 l AS (SELECT list(first ORDER BY i) AS firsts, list(step ORDER BY i) AS steps, list(shard ORDER BY i) AS names FROM s),
 fill AS (
 SELECT 0 AS turn, [-1 FOR x IN range({sharding.SLOTS})] AS own, [0 FOR x IN range({len(SHARDS)})] AS nxt FROM l
 UNION ALL
 SELECT turn + 1, list_transform(own, lambda x, i: CASE WHEN i = slot + 1 THEN turn % {len(SHARDS)} ELSE x END), list_transform(nxt, lambda x, i: CASE WHEN i = turn % {len(SHARDS)} + 1 THEN k + 1 ELSE x END)
 FROM (SELECT *, (firsts[turn % {len(SHARDS)} + 1] + k * steps[turn % {len(SHARDS)} + 1]) % {sharding.SLOTS} AS slot
  FROM (SELECT f.*, firsts, steps, list_filter(range(nxt[turn % {len(SHARDS)} + 1], {sharding.SLOTS}), lambda k: own[(firsts[turn % {len(SHARDS)} + 1] + k * steps[turn % {len(SHARDS)} + 1]) % {sharding.SLOTS} + 1] < 0)[1] AS k
   FROM fill f, l WHERE turn < {sharding.SLOTS}))),
 o AS (SELECT own, names FROM fill, l WHERE turn = {sharding.SLOTS}),
 d AS (SELECT doc_id, ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15])::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, names[own[slot + 1] + 1] AS shard FROM d, o
""",
)
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


@query(
    "op5_chat",
    r"""
WITH k AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'id ' || conv_id END AS key FROM conversations),
 t AS (SELECT key, conv_id, turn, role, text, row_number() OVER w AS pos, count(*) OVER (PARTITION BY key) AS n FROM k WINDOW w AS (PARTITION BY key ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
 p AS (SELECT key, conv_id, pos, n, string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)), chr(2)) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sofar FROM t),
 whole AS (SELECT sofar, coalesce('id ' || min(conv_id), min(key)) AS key FROM p WHERE pos = n GROUP BY sofar),
 kept AS (SELECT key FROM whole WHERE sofar NOT IN (SELECT sofar FROM p WHERE pos < n))
SELECT any_value(conv_id) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
 string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|im_', '< |im_') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM t WHERE key IN (SELECT key FROM kept) GROUP BY key
""",
)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def _license_sql() -> str:
    def starts(t: licenses.Template) -> str:
        return f"list_filter(range({-t.key_places()[0][0]}, len(w)), lambda s: {' AND '.join(f"w[s + {j + 1}] = '{x}'" for j, x in t.key_places())})"

    def cover(k: int, t: licenses.Template) -> str:
        weight = " + ".join(f"CASE WHEN s + {j} >= 0 AND w[s + {j + 1}] = '{x}' THEN idf['{x}'] ELSE 0 END" for j, x in enumerate(t.words))
        return f"coalesce(list_max(list_transform(s{k}, lambda s: ({weight}) / ({' + '.join(f"idf['{x}']" for x in t.words)}))), 0)"

    ts = licenses.TEMPLATES
    vocabulary = ", ".join(f"'{w}'" for w in sorted({w for t in ts for w in t.words}))
    base = " || ".join(f"s{k}" for k, t in enumerate(ts) if t.base)
    named = lambda some: "array_to_string(list_sort(list_distinct(" + " || ".join(f"(CASE WHEN len(s{k}) > 0 THEN ['{t.label}'] ELSE [] END)" for k, t in some) + ")), ',')"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 n AS (SELECT count(*) AS n FROM w), v AS (SELECT unnest([{vocabulary}]) AS word),
 d AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS word FROM w) GROUP BY word),
 i AS (SELECT map_from_entries(list(row(v.word, ln((n.n + 1) / (coalesce(d.df, 0) + 1)) + 1))) AS idf FROM v LEFT JOIN d ON v.word = d.word CROSS JOIN n),
 s AS (SELECT doc_id, w, {', '.join(f'{starts(t)} AS s{k}' for k, t in enumerate(ts))} FROM w),
 r AS (SELECT s.*, {base} AS b, greatest({', '.join(cover(k, t) for k, t in enumerate(ts) if not t.base)}, 0) AS coverage FROM s CROSS JOIN i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(b) AS BIGINT) AS n_base, CAST(list_min(b) AS BIGINT) AS first_word, CAST(list_max(b) AS BIGINT) AS last_word,
 {named([(k, t) for k, t in enumerate(ts) if t.base])} AS base_labels, {named(list(enumerate(ts)))} AS labels,
 round(greatest(least(coverage, 1.0), CASE WHEN len(b) > 0 THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score FROM r"""


@query("op1_licenses", _license_sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def tokenizer_file(name: str) -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_counts.count_tokens(table(spark, sf_dir, "documents"), f.read())


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op7_mixing",
    rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM z GROUP BY source),
 w AS (SELECT *, [5, 2, 1][(k - 1) % 3 + 1] AS w, 3 * n / [5, 2, 1][(k - 1) % 3 + 1] AS r FROM s),
 t AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM s),
 l AS (SELECT max((t - coalesce((SELECT sum(3 * b.n) FROM w b WHERE (b.r, b.k) < (a.r, a.k)), 0)) / (SELECT sum(b.w) FROM w b WHERE (b.r, b.k) >= (a.r, a.k))) AS level FROM w a, t),
 g AS (SELECT source, k, n, least(CAST(3 * n AS DOUBLE), level * w) AS target FROM w, l),
 e AS (SELECT k FROM (SELECT k, target / (2 * j + 1) AS q, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, k) AS place FROM g, (SELECT unnest(range((t * 2 + {mixing.BLOCK}) // {2 * mixing.BLOCK})) AS j FROM t) WHERE target > 0), t WHERE place <= (t * 2 + {mixing.BLOCK}) // {2 * mixing.BLOCK}),
 q AS (SELECT g.*, (SELECT count(*) FROM e WHERE e.k = g.k) AS blocks FROM g),
 d AS (SELECT z.*, q.k, q.n, q.target, q.blocks, ('0x' || draw[1:15])::BIGINT % greatest(1, (q.n + {mixing.SHARD_WORDS - 1}) // {mixing.SHARD_WORDS}) AS shard FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source),
 c AS (SELECT k, shard, any_value(blocks) AS blocks, CAST(sum(size) AS BIGINT) AS cell FROM d GROUP BY k, shard),
 h AS (SELECT k, shard, count(*) AS quota FROM (SELECT k, shard, blocks, row_number() OVER (PARTITION BY k ORDER BY cell / (2 * j + 1) DESC, shard) AS place FROM (SELECT c.*, unnest(range(blocks)) AS j FROM c) WHERE cell > 0) WHERE place <= blocks GROUP BY k, shard),
 f0 AS (SELECT c.k, c.shard, cell, coalesce(quota, 0) * {mixing.BLOCK} AS due0, least(coalesce(quota, 0) * {mixing.BLOCK}, 3 * cell) AS due1 FROM c LEFT JOIN h ON c.k = h.k AND c.shard = h.shard),
 f1 AS (SELECT *, CAST(sum(3 * cell - due1) OVER (PARTITION BY k) AS HUGEINT) AS rooms, CAST(sum(3 * cell - due1) OVER (PARTITION BY k ORDER BY shard ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS filled, CAST(sum(due0 - due1) OVER (PARTITION BY k) AS HUGEINT) AS cut FROM f0),
 f AS (SELECT k, shard, cell, CAST(due1 + least(cut, rooms) * filled // greatest(rooms, 1) - least(cut, rooms) * (filled - 3 * cell + due1) // greatest(rooms, 1) AS BIGINT) AS due,
  ('0x' || md5('{mixing.SEED}|from|' || k || '|' || shard)[1:15])::BIGINT % greatest(1, (cell + {mixing.BLOCK - 1}) // {mixing.BLOCK}) * {mixing.BLOCK} AS start FROM f1),
 o AS (SELECT d.*, f.cell, f.due, f.start, sum(size) OVER (PARTITION BY d.k, d.shard ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS stop FROM d JOIN f ON d.k = f.k AND d.shard = f.shard),
 p AS (SELECT *, CASE WHEN cell > 0 THEN due // cell ELSE 0 END AS rounds FROM o), r AS (SELECT *, start + due - rounds * cell AS upto FROM p)
SELECT doc_id, size, n AS source_size, round(target, 6) AS target,
 CAST(rounds * size + greatest(least(stop, upto, cell) - greatest(stop - size, start), 0) + greatest(least(stop, upto - cell) - (stop - size), 0) AS BIGINT) AS taken FROM r
""",
)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query(
    "op9_embedding_dedup",
    """
WITH RECURSIVE m AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM embeddings), v AS (SELECT rid, label, CAST(embedding AS DOUBLE[]) AS e FROM m
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 u AS (SELECT rid, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
 l AS (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.93 * a.n * b.n),
 r AS (SELECT rid AS a, rid AS b FROM m UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
 c AS (SELECT r.a, min(m.vec_id) AS c FROM r JOIN m ON m.rid = r.b GROUP BY r.a)
SELECT m.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = m.rid) AS BIGINT) AS n_links, CAST(c.c AS BIGINT) AS component_id, m.vec_id IS NOT DISTINCT FROM c.c AS kept
FROM m JOIN c ON c.a = m.rid
""",
)
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_pieces")
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.trip(table(spark, sf_dir, "documents"), pieces.load(tokenizer_file("piece_bpe_32k.model")))


@query(
    "op11_ball_tree",
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
 h AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
 s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM h),
 f AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM h) GROUP BY ALL),
 g AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score FROM q JOIN f ON q.term = f.term JOIN g ON q.term = g.term, s GROUP BY ALL),
 p AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM p WHERE rank <= 10
""",
)
def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_line_dedup",
    rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
 k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') AS key FROM u),
 g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {lines.LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.DOCUMENTS}),
 r AS (SELECT k.*, g.key IS NOT NULL AND k.doc_id <> g.top AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
""",
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op13_runs")
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.find(table(spark, sf_dir, "documents"), planted=True))
