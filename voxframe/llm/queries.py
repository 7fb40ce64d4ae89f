"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import benchmark_index, html_extract, near_dup, ngram_join, packing, phrase_parsing, pii, prefix_trie, quality_cnn, quality_rules, recompression, source_audit, token_counts


#: Whoever runs the replacement on real data passes a secret of their own.
PII_KEY = "example key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), length=2048)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_forests(docs, _table(spark, sf_dir, "labels")))


def op3_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(html_extract.sample_articles(pages)))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_table(spark, sf_dir, "documents"), size=13)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.fit_network(docs, _table(spark, sf_dir, "labels")))


def op9_phrase_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_parsing.remove_repeats(_table(spark, sf_dir, "documents"), size=200)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(_table(spark, sf_dir, "documents"), size=5, similarity=0.8, weighting="count", exhaustive=True)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.said(_table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_benchmark_index": op3_benchmark_index,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_html_extract": op5_html_extract,
    "op6_recompression": op6_recompression,
    "op7_token_counts": op7_token_counts,
    "op8_quality_cnn": op8_quality_cnn,
    "op9_phrase_parsing": op9_phrase_parsing,
    "op10_near_dup": op10_near_dup,
    "op11_source_audit": op11_source_audit,
    "op12_ngram_join": op12_ngram_join,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_index": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, array_to_string(w[s + 1 : s + 10], ' ') AS words, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d, n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.words = bw.words AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
    "op6_recompression": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(w[s + 1 : s + 13], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 12, 0))) AS s FROM d)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM (SELECT win.doc_id, win.s FROM win JOIN low ON win.h = low.h WHERE win.doc_id > low.low)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op11_source_audit": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept ON t.lang = kept.lang AND t.term = kept.term GROUP BY t.lang, t.source, t.term),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
own AS (SELECT lang, source, sum(n) AS total FROM grid GROUP BY lang, source),
p AS (
  SELECT grid.lang, grid.source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS p
  FROM grid JOIN own ON grid.lang = own.lang AND grid.source = own.source JOIN v ON v.lang = grid.lang),
every AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
q AS (
  SELECT every.lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS q
  FROM every JOIN (SELECT lang, sum(total) AS total FROM own GROUP BY lang) AS o ON every.lang = o.lang JOIN v ON v.lang = every.lang),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
made AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM made)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op12_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
few AS (SELECT g FROM sh GROUP BY g HAVING count(*) > 1),
s2 AS (SELECT sh.doc_id, sh.g FROM sh JOIN few ON sh.g = few.g),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s2 AS a JOIN s2 AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM met JOIN sizes AS x ON x.doc_id = met.a JOIN sizes AS y ON y.doc_id = met.b WHERE 100 * met.n >= 90 * (x.n + y.n - met.n)),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sizes
  UNION
  SELECT reach.node, link.b AS other FROM reach JOIN link ON link.a = reach.other),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN low ON low.node = d.doc_id""",
    "op13_prefix_trie": r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
heads AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 6 AS h FROM ids),
t AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT heads.conv_id, 0 AS part, t.k, t.text, t.digest FROM heads JOIN t ON t.conv_id = heads.conv_id - heads.conv_id % 100 WHERE t.k <= heads.h
  UNION ALL
  SELECT heads.conv_id, 1 AS part, t.k, t.text, t.digest FROM heads JOIN t ON t.conv_id = heads.conv_id WHERE t.k > heads.h),
placed AS (SELECT conv_id, text, digest, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM r),
prefixes AS (
  SELECT conv_id, d, length(text) AS chars, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
last AS (SELECT conv_id, max(d) AS m FROM prefixes GROUP BY conv_id),
node AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars FROM prefixes GROUP BY d, prefix),
ends AS (
  SELECT p.prefix, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM prefixes AS p JOIN last ON last.conv_id = p.conv_id AND last.m = p.d GROUP BY p.prefix),
kids AS (SELECT left(prefix, 32 * (d - 1)) AS prefix, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
up AS (
  SELECT p.prefix, sum((node.n - 1) * node.chars) AS saved, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM node LEFT JOIN kids ON kids.prefix = node.prefix JOIN prefixes AS p ON p.conv_id = node.conv_id AND p.d <= node.d GROUP BY p.prefix)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(up.leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM node JOIN up ON up.prefix = node.prefix LEFT JOIN kids ON kids.prefix = node.prefix LEFT JOIN ends ON ends.prefix = node.prefix
LEFT JOIN node AS parent ON node.d > 0 AND parent.prefix = left(node.prefix, 32 * (node.d - 1))""",
}
