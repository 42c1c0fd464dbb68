"""Corpus pipeline over ``documents``: five stages, each on all that its predecessor kept.

All stages but the last return the columns of ``documents``. Decisions of each stage:

1. language: documents without a letter, or unlike every learned language, go.
2. lines: repeated passages of two lines or more go; a document of which nothing is left goes.
3. near_duplicates: one document of each group of near copies stays (the least doc_id), judged by the
   texts as they stand and by the texts that entered line dedup.
4. benchmark: documents that hold a benchmark item go.
5. pieces: the kept texts are encoded; piece_ids, n_pieces and decoded are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.decontaminate import with_leaks
from matchloom.llm.language_id import UNKNOWN, broadcast_profiles, learning_rows, with_language
from matchloom.llm.line_dedup import dedup_lines
from matchloom.llm.near_dup import near_duplicates
from matchloom.llm.pieces import encode_documents
from matchloom.llm.queries import PIECES
from matchloom.llm.shared import read_table, stored, work_folder

#: Similarity to the nearest language profile below which a text is in none of the languages.
LEAST_LANGUAGE_SCORE = 0.2
SHINGLE_WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach (any letters if none is taught)."""
    profiles = broadcast_profiles(learning_rows(docs))
    if not profiles.value.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    renamed = docs.withColumnsRenamed({c: f"doc_{c}" for c in docs.columns if c != "text"})  # lang_pred or score may be among them
    named = with_language(renamed, profiles)
    kept = named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("text" if c == "text" else f"doc_{c}").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = dedup_lines(docs)
    emptied = (F.col("removed_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    kept = done.where(~emptied)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("removed_lines") > 0, changed).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def entered_texts(docs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, hash of the text, and the text of the row of ``documents`` with the same id, for documents that line dedup has cut.

    That is so if the row has a longer text, and every line of the text is a line of that row.
    """
    text = lambda df: df.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null")
    mine, whole = text(docs), text(documents)
    # Lengths first: only the texts of documents that have become shorter move.
    sizes = whole.select("id", F.length("text").alias("was"))
    shorter = mine.select("id", F.length("text").alias("now")).join(sizes, "id").where("was > now").select("id").distinct()
    shorter = stored(shorter, work_folder(docs.sparkSession, "entered"), "shorter")
    left = mine.join(shorter, "id", "left_semi").select("id", "text")
    right = whole.join(shorter, "id", "left_semi").select(F.col("id").alias("whole_id"), F.col("text").alias("entered"))
    lines = lambda c: F.split(F.col(c), "\n", -1)
    cut = (F.size(F.array_except(lines("text"), lines("entered"))) == 0) & (F.length("entered") > F.length("text"))
    both = left.join(right, F.col("id") == F.col("whole_id")).where(cut)
    return both.select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("entered").alias("text")).distinct()


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by their texts as they stand, or by the texts that entered line dedup.

    A near copy shares most of its lines with the document it copies, so line dedup cuts it down to what
    differs; only the text it had before still tells that it is one. So a cut document takes part with both texts,
    and goes if either is a near copy of a lesser document's. Null ids stay; of rows that repeat doc_id and text one stays.
    """
    folder = work_folder(spark, "near-copies")
    cut = stored(entered_texts(docs, read_table(spark, sf_dir, "documents")), folder, "cut")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    judged = near_duplicates(texts.unionByName(cut.select("doc_id", "text")), SHINGLE_WORDS, PERCENT, with_hash=True)
    judged = stored(judged.select("doc_id", "text_hash", "kept"), folder, "judged")
    gone = judged.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    entered = cut.select("doc_id", "text_hash", F.xxhash64("text").alias("entered_hash"))
    by_entered = entered.join(gone, (F.col("doc_id") == F.col("__id")) & (F.col("entered_hash") == F.col("__hash"))).select("__id", F.col("text_hash").alias("__hash"))
    hashed = docs.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__th") == F.col("__hash"))
    kept = hashed.join(gone.unionByName(by_entered).distinct(), same, "left_anti")
    again = judged.where("doc_id is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    again = stored(again, folder, "again")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__th"]))
    return kept.select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = with_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, PIECES)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_copies), ("benchmark", benchmark), ("pieces", pieces)]

#: The stages learn models and break ties by text; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; the result of every stage is written as Parquet and read again."""
    docs, folder = read_table(spark, sf_dir, "documents"), work_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return docs
