"""One registered query per operator, with SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import (
    dart_minhash, grouped_packing, hilbert, ppm_language, qgram_lemma, quotation_links, rank_index, relative_lz, rule_ledger, simhash_tiles, site_lines,
    source_stripes, warc_transactions,
)
from tidemark.llm.common import table
from tidemark.plans.registry import Registry

R = Registry()
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@R.query("op1_near_duplicates")
def near_duplicates(spark, d):
    return dart_minhash.near_duplicate_classes(table(spark, d, "documents"))


@R.query("op2_benchmark_leaks")
def benchmark_leaks(spark, d):
    return qgram_lemma.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@R.query("op3_hilbert_shards")
def hilbert_shards(spark, d):
    return hilbert.shard(table(spark, d, "documents"))


@R.query("op4_quotation_links", """
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(text, '') AS body,
         lag(turn) OVER w = turn - 1 AND regexp_matches(coalesce(lag(text) OVER w, ''), '[^\\s]') AS linked
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), g AS (
  SELECT *, max(CASE WHEN coalesce(linked, false) THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS root FROM t
)
SELECT conv_id, turn, role, body AS own_text, CASE WHEN linked THEN turn - 1 END AS parent, root, turn - root AS depth FROM g""")
def quotation_links_query(spark, d):
    mail = quotation_links.quoted_mail(spark, d)
    return quotation_links.conversations(mail, "conv_id", "turn").drop("n_quotes")


@R.query("op5_relative_lz", """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS s FROM w),
k AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS win FROM p),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM dup),
lists AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END AS kept
  FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept""")
def relative_lz_query(spark, d):
    return relative_lz.duplicate_spans(table(spark, d, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


RULES_SQL = """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS s FROM w),
k AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, array_to_string(words[s:s + 4], ' ')) AS n FROM p),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM (SELECT doc_id, s + unnest(range(0, 5)) AS i FROM k WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)"""


@R.query("op6_rule_ledger", RULES_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept,
       CAST((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
       + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT AS BIGINT) AS failures
FROM f""")
def rule_ledger_query(spark, d):
    rows = rule_ledger.judged(rule_ledger.ledger(table(spark, d, "documents")), "v1")
    base = F.col("failures").bitwiseAND(F.lit(rule_ledger.mask("base")).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "failures"
    )


@R.query("rule_ablation", RULES_SQL + """,
bad AS (
  SELECT n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated_words, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * n_lines AS duplicate_lines FROM f),
each AS (
  SELECT unnest(['few_words', 'repeated_words', 'symbols', 'duplicate_lines']) AS rule, unnest([few_words, repeated_words, symbols, duplicate_lines]) AS failed,
         few_words::INT + repeated_words::INT + symbols::INT + duplicate_lines::INT AS n FROM bad)
SELECT rule, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE failed AND n = 1) AS only_this, count(*) FILTER (WHERE n = 0 OR (failed AND n = 1)) AS kept_without
FROM each GROUP BY rule""")
def rule_ablation_query(spark, d):
    """What each rule of the first policy rejects, alone and with the others."""
    return rule_ledger.ablation(rule_ledger.ledger(table(spark, d, "documents")), "v1")


@R.query("op7_site_lines", """
WITH t AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)) AS site, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages),
l AS (SELECT page_id, site, line, pos FROM (SELECT page_id, site, string_split(text, chr(10)) AS ls FROM t), unnest(ls) WITH ORDINALITY AS u(line, pos)),
d AS (SELECT site, trim(line) AS line, count(DISTINCT page_id) AS holding FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
boiler AS (SELECT site, line FROM d JOIN (SELECT site, count(*) AS total FROM t GROUP BY site) USING (site) WHERE holding >= 3 AND holding > 0.1 * total),
m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN boiler b ON l.site = b.site AND trim(l.line) = b.line)
SELECT page_id, site, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text,
       count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
FROM m GROUP BY page_id, site""")
def site_lines_query(spark, d):
    pages = table(spark, d, "pages").select("page_id", site_lines.host(F.col("url")).alias("site"), site_lines.visible_lines(F.col("html")).alias("text"))
    return site_lines.drop_site_lines(pages, "site")


@R.query("op8_grouped_packing")
def grouped_packing_query(spark, d):
    return grouped_packing.pack_documents(table(spark, d, "documents"), TOKENIZER)


@R.query("op9_warc_transactions", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m""")
def warc_transactions_query(spark, d):
    return warc_transactions.round_trip(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@R.query("op10_ppm_language")
def ppm_language_query(spark, d):
    return ppm_language.identify(table(spark, d, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@R.query("op11_rank_index", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens FROM documents
), h AS (
  SELECT *, len(tokens) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def rank_index_query(spark, d):
    out = rank_index.fill_in_middle(table(spark, d, "documents"))
    back = F.sha2(rank_index.restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


@R.query("op12_source_stripes", """
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(total) + 5 * any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 50""")
def source_stripes_query(spark, d):
    return source_stripes.source_divergences(table(spark, d, "documents"))


@R.query("op13_simhash_tiles")
def simhash_tiles_query(spark, d):
    return simhash_tiles.near_duplicates(table(spark, d, "documents"))


@R.query("pipeline")
def pipeline(spark, d):
    return corpus_pipeline.run(spark, d)


if corpus_pipeline.ORACLE_SQL:
    R.sql["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries():
    return dict(R.runners)


def oracle_sql():
    return dict(R.sql)
