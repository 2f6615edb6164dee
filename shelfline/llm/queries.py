"""The registered queries of the subpackage: thin wrappers with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfline.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
tri AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM d, unnest(range(1, len(w) - 1)) u(i)
),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS k FROM tri) WHERE k > 1),
cov AS (SELECT rid, CAST(count(DISTINCT i + o) AS BIGINT) AS n FROM rep, unnest([0, 1, 2]) s(o) GROUP BY rid),
lines AS (SELECT rid, l FROM d, unnest(string_split(t, chr(10))) u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n FROM lines GROUP BY rid),
c AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid)
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1e6 END AS k FROM p),
r AS (SELECT source, (f + m * k) / (n + k) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""


@_query("op8_host_rules", _OP8_SQL)
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.host_rules import host_rules

    return host_rules(_table(spark, sf_dir, "documents")).drop("host_rate")


_OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


@_query("op10_warc", _OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages"))).drop("url")


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS x
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT rid, item, i, n FROM (
    SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS x FROM d, sizes, unnest(range(1, len(w) - n + 2)) u(i)
  ) JOIN win USING (n, x)
),
hit AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM occ, unnest(range(0, n)) s(o) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


@_query("op4_decontaminate", _OP4_SQL)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.decontaminate import benchmark_hits

    hits = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.language import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


@_query("op6_personal_data")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.personal import KINDS, find_personal, fit, spans_text

    docs = _table(spark, sf_dir, "documents")
    found = find_personal(docs, fit(docs))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@_query("op2_jaccard_join")
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


@_query("op9_repeated_substrings")
def op9_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.substrings import repeated_substrings

    return repeated_substrings(_table(spark, sf_dir, "documents")).drop("starts", "ends")


def _level_sql(level: str, parents: list[str], weight: str, above: str) -> str:
    """The shares of one level of the budget tree."""
    path = ", ".join([*parents, level])
    using = f"JOIN {above} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {above}"
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    return f"""
{level}_n AS (
  SELECT n.*, share FROM (SELECT {path}, CAST(sum(tokens * 4) AS BIGINT) AS cap, {weight} AS w FROM leaves GROUP BY ALL) n {using}
),
{level}_f AS (
  SELECT *, row_number() OVER o AS pos,
         (share - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / CAST(sum(w) OVER ({part}) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS fill
  FROM {level}_n WINDOW o AS ({part} ORDER BY cap / w, {level})
),
{level}_l AS (SELECT *, min(CASE WHEN fill * w < cap THEN pos END) OVER ({part}) AS head FROM {level}_f),
{level}_m AS (SELECT *, max(CASE WHEN pos = head THEN fill END) OVER ({part}) AS lev FROM {level}_l),
{level}_s AS (
  SELECT {path}, CAST(CASE WHEN head IS NULL OR pos < head THEN cap ELSE floor(lev * w) END AS BIGINT) AS share FROM {level}_m
)"""


_OP7_SQL = (
    r"""
WITH rows_ AS (
  SELECT doc_id, 'domain' || (CAST('0x' || substr(md5(coalesce(source, '(none)')), 1, 4) AS INTEGER) % 4) AS domain,
         coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT CAST(least(floor(sum(tokens) * 0.5::DOUBLE), sum(tokens * 4)) AS BIGINT) AS share FROM leaves),"""
    + _level_sql("domain", [], "1", "root")
    + ","
    + _level_sql("lang", ["domain"], "CASE lang WHEN 'en' THEN 2 ELSE 3 END", "domain_s")
    + ","
    + _level_sql("source", ["domain", "lang"], "1", "lang_s")
    + """,
plan AS (
  SELECT domain, lang, source, share // tokens AS full_, share - (share // tokens) * tokens AS rest
  FROM leaves JOIN source_s USING (domain, lang, source) WHERE share > 0
),
placed AS (SELECT *, md5('17|' || (full_ + 1) || '|' || coalesce(CAST(doc_id AS VARCHAR), '(none)')) AS ord FROM rows_ JOIN plan USING (domain, lang, source)),
paid AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ord, n_tokens, doc_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM placed WHERE rest > 0
)
SELECT doc_id, domain, lang, source, CAST(full_ + 1 AS BIGINT) AS epoch, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens
FROM paid WHERE before < rest
UNION ALL
SELECT doc_id, domain, lang, source, CAST(e AS BIGINT), n_tokens, n_tokens FROM placed, unnest(range(1, full_ + 1)) u(e)
"""
)
#: Weights of the production mix: English is held down in favour of the other languages.
MIX_WEIGHTS = {"lang": {"en": 2, "de": 3, "fr": 3, "es": 3, "(none)": 3}}


@_query("op7_mixing", _OP7_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)


@_query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.quality import assess, fit

    docs = _table(spark, sf_dir, "documents")
    return assess(docs, fit(docs, _table(spark, sf_dir, "labels"))).drop("row")


_OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.rid <> r.rid
),
p AS (
  SELECT arid, anchor_id, vec_id AS positive_id, score AS positive_score, j
  FROM (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id NULLS LAST) AS j FROM s WHERE same) WHERE j <= 5
),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.arid, p.j ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s USING (arid) WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@_query("op11_hard_negatives", _OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.negatives import mine_negatives

    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(CAST(label AS BIGINT) + 1) % 10")).otherwise(F.expr("CAST(label AS BIGINT)"))
    return mine_negatives(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label=label)


@_query("op12_token_ids")
def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfline.llm.idstore import fetch, write_store

    read = fetch(write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_OP13_SQL = r"""
WITH t AS (
  SELECT conv_id AS k, turn, coalesce(text, '') AS text,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL
),
n AS (SELECT k, text, x, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, x) AS i FROM t),
c AS (
  SELECT k, k - k % 20 AS base,
         xor(list_reduce(list_concat([4294967295], flatten([[CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                                                            FOR s IN string_split(CAST(k AS VARCHAR), '')])),
                         lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT k FROM t)
),
b AS (SELECT k AS base, max(i) AS size FROM n GROUP BY k),
g AS (SELECT k, base, h, least(h, coalesce(size, 0)) AS head FROM c LEFT JOIN b USING (base)),
r AS (
  SELECT g.k, n.i AS d, text, x FROM g JOIN n ON n.k = g.base AND n.i <= g.h
  UNION ALL
  SELECT g.k, head + n.i - h, text, x FROM g JOIN n ON n.k = g.k AND n.i > g.h
),
q AS (
  SELECT k, d, text, string_agg(x, '') OVER (PARTITION BY k ORDER BY d) AS p FROM r
  UNION ALL
  SELECT k, 0, '', '' FROM c
),
nodes AS (
  SELECT p, any_value(d) AS d, min(k) AS k, CAST(count(*) AS BIGINT) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved
  FROM q GROUP BY p
),
ch AS (SELECT p[1 : len(p) - 64] AS p, CAST(count(*) AS BIGINT) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
v AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN ch USING (p)),
s AS (
  SELECT q.p, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM v JOIN q ON q.k = v.k AND q.d <= v.d GROUP BY q.p
),
e AS (
  SELECT p, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS keys
  FROM (SELECT k, p FROM (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS back FROM q) WHERE back = 1) GROUP BY p
)
SELECT v.k AS conv_id, CAST(v.d AS BIGINT) AS depth, u.k AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens,
       sha256(coalesce(keys, '')) AS ends_sha256
FROM v JOIN s ON s.p = v.p LEFT JOIN e ON e.p = v.p LEFT JOIN v u ON v.d > 0 AND u.p = v.p[1 : len(v.p) - 64]
"""


@_query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfline.llm.trie import numbered_turns, prefix_trie, with_shared_heads

    return prefix_trie(*with_shared_heads(numbered_turns(_table(spark, sf_dir, "conversations"))))
