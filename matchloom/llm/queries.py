"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm import chat, line_dedup
from matchloom.llm.decontaminate import leaks
from matchloom.llm.fingerprint import fingerprint_documents
from matchloom.llm.hard_negatives import SQL as OP12_SQL
from matchloom.llm.hard_negatives import hard_negatives
from matchloom.llm.language_id import predict_languages
from matchloom.llm.near_dup import near_duplicates
from matchloom.llm.pieces import piece_digests
from matchloom.llm.quality import score_quality
from matchloom.llm.shared import read_table, work_folder
from matchloom.llm.token_files import read_token_files, write_token_files
from matchloom.llm.url_filter import Rule, judge_urls
from matchloom.llm.vector_dup import SQL as OP11_SQL
from matchloom.llm.vector_dup import near_vectors
from matchloom.llm.whitening import whiten

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# The rules that the url query judges by.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def op1_chat_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.view_digests(read_table(spark, sf_dir, "conversations"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, TOKENIZER)
    return read_token_files(spark, folder)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_summary(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), RULES)


OP4_SQL = """
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u,
         CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, arg_max(h || p || ' ' || verdict, length(h) * 1000 + length(p)) AS best
  FROM hp JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT hp.page_id, host, path, split_part(best, ' ', 1) AS rule, coalesce(split_part(best, ' ', 2), 'allow') AS verdict
FROM hp LEFT JOIN fits USING (page_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(read_table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), PIECES)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is one on, every hundredth row is an anchor."""
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_views, op2_token_files, op3_line_dedup, op4_url_filter, op5_language_id,
        op6_near_dup, op7_fingerprints, op8_quality, op9_pieces, op10_decontaminate,
        op11_vector_dup, op12_hard_negatives, op13_whitening,
    )
}
SQL = {"op1_chat_views": chat.SQL, "op3_line_dedup": line_dedup.SQL, "op4_url_filter": OP4_SQL, "op11_vector_dup": OP11_SQL, "op12_hard_negatives": OP12_SQL}
