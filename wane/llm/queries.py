"""The registered queries of the text operators and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wane.llm import ann, fingerprints, hardneg, language, lm, neardup, packing, pieces, substrings, tokenfiles, toxicity, turns, turns_check, warc
from wane.llm.common import bucket_of, shared_folder, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    folder = shared_folder(spark, "warc")
    warc.write_archive(pages, folder)
    records = warc.read_archive(spark, folder)
    failed = F.raise_error(F.lit("a record's payload does not match its digest"))
    return records.select(
        F.col("page").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"),
        F.when(F.col("verified"), F.col("sha1")).otherwise(failed.cast("string")).alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(table(spark, sf_dir, "documents"), vocabulary)
    return pieces.decode(encoded, vocabulary).select(
        "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), bucket_of("doc_id", 7) == 2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket_of("doc_id", 3) == 1
    machine = toxicity.learn(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(bucket_of("doc_id", 3) != 1))
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), machine).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), bucket_of("doc_id", 5) == 0
    network = language.learn(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), network).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return tokenfiles.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, ((F.col("label") + 1) % 10).cast(rows.schema["label"].dataType)).otherwise(F.col("label"))
    return hardneg.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_packing": op1_packing, "op2_neighbours": op2_neighbours, "op3_neardup": op3_neardup, "op4_substrings": op4_substrings,
    "op5_warc": op5_warc, "op6_pieces": op6_pieces, "op7_language_model": op7_language_model, "op8_toxicity": op8_toxicity,
    "op9_language": op9_language, "op10_spotsigs": op10_spotsigs, "op11_turns": op11_turns, "op12_token_files": op12_token_files,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Where SQL can express an operator. The others are compared with brute force, an exact round trip or held-out rows in tests/llm.
CHECKS = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hexed FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_page FROM p
)
SELECT page_id,
  CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (CAST('0x' || substr(hexed, 1 + 5 * (k // 4), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) % 32, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM f
""",
    "op11_turns": turns_check.CHECK,
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
    list_sum([CAST(a.v[i] * b.v[i] AS BIGINT) FOR i IN range(1, len(a.v) + 1)])::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
""",
}
