"""A training corpus from `documents`: language, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents. Rows that repeat an id are one document: they stay
or go together. Rows with a null id are never dropped for what another row holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, jaccard_join, language_id, sentencepiece_codec, substring_dedup
from fieldloom.llm.queries import held_out, model_path, table
from fieldloom.llm.store import cut, drop, release

#: Bytes of an Arrow batch that goes to a Python worker, 64 MB by default. Less is
#: held at once then, in the worker and outside the heap of the executor; results do not depend on it.
BATCH_BYTES = 4 << 20

#: A document goes if it has no letters or its best language is less likely than this.
LEAST_SCORE = 0.5


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of the stages' plans, unless the session has a smaller bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language."""
    small_batches(spark)
    model = language_id.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = language_id.predict(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    small_batches(spark)
    groups = jaccard_join.near_duplicates(docs.select("doc_id", "text"), words=5, percent=75)
    return docs.join(groups.where("component_id < doc_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words and more that a document with a smaller id has; a document that loses all goes."""
    small_batches(spark)
    found = substring_dedup.remove_repeats(docs, window=50, outputs=("n_words", "n_removed", "cut_text"))
    left = found.where("n_words = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("cut_text")).otherwise(F.col("text"))
    return left.withColumns({"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("cut_text").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    small_batches(spark)
    found = decontaminate.matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.join(found.where(F.size("hit_starts") > 0).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the source bytes of each piece, and whether decoding gives the text back."""
    small_batches(spark)
    out = sentencepiece_codec.encode(docs.select("doc_id", "text"), model_path())
    same = F.col("decoded") == F.regexp_replace(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", same.alias("round_trip"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: No SQL: the language model is trained and the tokenizer is no SQL function. tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = cut(stage(spark, docs, sf_dir), name)
        drop(docs)
        release(spark)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
