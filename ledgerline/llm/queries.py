"""The numbered queries of this package and of the pipeline, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, chat, decontam, langid, licences, lm, neardup, periodic, pieces, pii, secrets, topk, trie
from ledgerline.llm.common import table


def op1_rare_seed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


#: Conversation -7, whose texts hold the template's own marks.
TRAP = "\\### Assistant: </turn> ok"


def op4_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)],
                                 "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(trap)))


def op7_template_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_character_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op8_windowed_attention(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


def op6_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"),
                                            path or public_tokenizers.path("word_bpe_49k.json")))


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(table(spark, sf_dir, "documents"))


def op11_time_forward_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie_of_conversations(table(spark, sf_dir, "conversations"))


def op12_aligned_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pieces.digests(pieces.encode_documents(table(spark, sf_dir, "documents"),
                                                  path or public_tokenizers.path("piece_bpe_32k.model")))


def op13_link_cut_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_of_documents(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rare_seed_alignment": op1_rare_seed_alignment,
    "op2_weighted_minhash": op2_weighted_minhash,
    "op3_norm_bucket_topk": op3_norm_bucket_topk,
    "op4_typed_chat": op4_typed_chat,
    "op7_template_licences": op7_template_licences,
    "op5_character_network": op5_character_network,
    "op8_windowed_attention": op8_windowed_attention,
    "op6_disclosing_terms": op6_disclosing_terms,
    "op9_segment_tree_bpe": op9_segment_tree_bpe,
    "op10_crf_language_id": op10_crf_language_id,
    "op11_time_forward_trie": op11_time_forward_trie,
    "op12_aligned_sentencepiece": op12_aligned_sentencepiece,
    "op13_link_cut_runs": op13_link_cut_runs,
    "pipeline": pipeline,
}

def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
            "lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))), "
            "lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), CAST(4294967295 AS BIGINT))")


ORACLE_SQL: dict[str, str] = {
    "op3_norm_bucket_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v p ON p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, CAST(score AS BIGINT) AS score
FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
""",
    "op4_typed_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
w AS (
  SELECT *, 4 + length(regexp_replace(role, '[\\\\:\n<#]', '\\\\\\0', 'g')) + 2
         + length(regexp_replace(text, '\\\\|</turn>|### |<\\|', '\\\\\\0', 'g')) + 8 AS chars
  FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attached
FROM w GROUP BY conv_id
""",
    "op11_time_forward_trie": f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
whole AS (
  SELECT i.conv_id, 0 AS part, t.pos, role, text FROM ids i JOIN t ON t.conv_id = i.base AND t.pos < i.h
  UNION ALL SELECT i.conv_id, 1, t.pos, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.pos >= i.h),
seq AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM whole),
path AS (
  SELECT conv_id, depth, length(text) AS chars,
         sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node
  FROM seq
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
up AS (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, any_value(parent) AS parent FROM up GROUP BY ALL),
kids AS (SELECT parent AS node, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.node, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved
  FROM node v LEFT JOIN kids k ON k.node = v.node JOIN path p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node),
ended AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS members FROM up WHERE ends GROUP BY node)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.members, '')) AS ends_sha256
FROM node v LEFT JOIN node a ON a.node = v.parent LEFT JOIN kids k ON k.node = v.node JOIN sums s ON s.node = v.node LEFT JOIN ended e ON e.node = v.node
""",
    "op13_link_cut_runs": f"""
WITH d AS (
  SELECT doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS own
  FROM documents),
t AS (SELECT doc_id, own, len(own) AS n, h, (h // 10) % greatest(len(own), 1) AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM t),
l AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN own[1 + a + (i - a) % p] ELSE own[1 + i] END)
                         ELSE own END AS words
  FROM p),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(words) AS word FROM l),
same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q
  FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same),
periodic AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (
  SELECT * FROM periodic r
  WHERE NOT EXISTS (SELECT 1 FROM periodic s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text
  FROM w LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs) r ON r.doc_id = w.doc_id AND r.i = w.i
  WHERE r.i IS NULL GROUP BY w.doc_id)
SELECT l.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.q AS BIGINT) AS period, CAST(1000 * b.length // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(l.n AS BIGINT) AS n_words
FROM l LEFT JOIN best b ON b.doc_id = l.doc_id LEFT JOIN listed s ON s.doc_id = l.doc_id LEFT JOIN kept ON kept.doc_id = l.doc_id
""",
}
