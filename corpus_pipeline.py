"""Corpus pipeline: language ID, near duplicates, repeated passages, mixing of sources, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of documents. Null texts count as empty, ids may be null or repeated
(rows are told apart by their place in the table), and an empty table goes through as one. Columns named _row and copies are refused.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.bpe import bpe_digests
from quillmask.llm.langid import LETTER, UNKNOWN, predict_language, train_language
from quillmask.llm.mixing import mix_sources
from quillmask.llm.ngram_join import ngram_jaccard_groups
from quillmask.llm.scratch import Scratch, numbered
from quillmask.llm.stream import few
from quillmask.llm.substring import remove_repeated_spans


#: A document whose predicted language scores at least this much is marked with it, whatever it was marked with.
SURE = 0.7


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters; unmarked documents get the predicted language, and so do those that are marked with
    another one if the prediction is sure. Where no document is marked there is nothing to learn, and lang stays null."""
    model = train_language(docs.where("pmod(crc32(cast(doc_id as string)), 5) <> 0"))
    if not model.languages:
        return docs.where(F.col("text").rlike(LETTER))
    found = predict_language(docs, model).where(F.col("lang_pred") != UNKNOWN)
    lang = F.when(F.col("lang").isNull() | (F.col("lang_score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return found.withColumn("lang", lang).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of near duplicates: five-word shingles, similarity 0.8. Rows are told apart by their
    place in the table, so null and repeated ids are no links and lose no text."""
    scratch = Scratch(spark, "near")
    rows = numbered(docs, Scratch(spark, "rows"))
    groups = ngram_jaccard_groups(rows, scratch, id_col="_row", k=5, num=80)
    gone = scratch.save(groups.where("component_id <> _row").select("_row"), "gone")
    return rows.join(few(gone), "_row", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every word covered by a 35-word window that also starts elsewhere; other texts stay as they are."""
    rows = remove_repeated_spans(docs, Scratch(spark, "spans"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as the target weights of the sources ask for: not at all, once or twice."""
    scratch = Scratch(spark, "mix")
    rows = numbered(docs, Scratch(spark, "rows"))
    counts = mix_sources(rows, scratch, id_col="_row").where("copies > 0").select("_row", "copies")
    # texts are shuffled once: what is taken of a large corpus is too much to broadcast
    taken = rows.join(counts.hint("merge"), "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and decoded_sha256 of each taken copy."""
    return bpe_digests(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: Language ID, the groups and the draws of the mix are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # no later stage reads it
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
