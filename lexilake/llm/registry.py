"""The queries of this package: the digests that the contracts ask for, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexilake.llm import bpe, chat, decontaminate, divergence, nearest, negatives, oracle, pii, qda, quality, simhash, suffixes, urls, warc
from lexilake.llm.common import table

#: The tokenizer file of op8 and of the pipeline's last stage.
VOCABULARY = os.environ.get("LEXILAKE_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, text, source FROM d),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (
  SELECT doc_id, sum(n - 1) AS n_dup FROM (
    SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
t AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
c AS (
  SELECT doc_id, pos, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS twice FROM t),
r AS (
  SELECT doc_id, count(*) AS n_repeat FROM (
    SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM c)
  WHERE inside GROUP BY doc_id),
nl AS (
  SELECT doc_id, source, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
    array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ' ') AS norm
  FROM l),
f AS (
  SELECT source, norm, min(doc_id) AS first_id FROM nl WHERE words > 0
  GROUP BY source, norm HAVING count(DISTINCT doc_id) > {quality.MAX_DOCUMENTS_PER_LINE}),
x AS (
  SELECT nl.doc_id, sum(nl.words) AS lost FROM nl JOIN f ON nl.norm = f.norm AND nl.source IS NOT DISTINCT FROM f.source
  WHERE nl.doc_id <> f.first_id GROUP BY nl.doc_id),
b AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN x USING (doc_id)),
e AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT lost > {quality.MAX_REMOVED} * n_words AS kept
FROM e
"""


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = qda.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS size FROM bw WHERE len(w) > 0),
bs AS (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM bi),
b AS (SELECT DISTINCT item_id, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS run FROM bs),
sizes AS (SELECT DISTINCT size FROM b),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes WHERE len(w) >= size),
dr AS (SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS run FROM ds),
h AS (SELECT doc_id, p, size, item_id FROM dr JOIN b USING (size, run)),
cover AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.train(urls.default_labelled(spark))).drop("probability")


#: The contract's own conversation beside the table's.
PLANTED_CHAT = (-7, "\\### Assistant: </turn> ok")


def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, text = PLANTED_CHAT
    planted = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(conv).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.chat_windows(turns))


#: The key of the registered query and the pipeline; a deployment passes its own.
PSEUDONYM_KEY = os.environ.get("LEXILAKE_PSEUDONYM_KEY", "not-a-secret")


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    count = lambda k: F.size(F.filter("pii", lambda x: x == k)).cast("bigint").alias(f"n_{k}")
    return made.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), *[count(k) for k in pii.KINDS])


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.exact_top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op6_suffix_dedup": op6_suffix_dedup,
    "op3_warc_round_trip": op3_warc_round_trip,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op1_chat_windows": op1_chat_windows,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op8_bpe_automaton": op8_bpe_automaton,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLE: dict[str, str] = {
    "op1_chat_windows": oracle.OP1,
    "op3_warc_round_trip": oracle.OP3,
    "op6_suffix_dedup": oracle.OP6,
    "op4_quality_rules": OP4_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_source_divergence": oracle.OP11,
    "op12_hard_negatives": oracle.OP12,
    "op13_exact_top_k": oracle.OP13,
}
