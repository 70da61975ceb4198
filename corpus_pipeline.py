"""The corpus pipeline: five stages over `documents`, each on all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows to the shared folder and reads them again, so no stage repeats the work of another. Null texts
count as empty ones; no stage fails on null or repeated ids, and no rows give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import decontaminate, line_dedup, near_dup, pieces, quality_classifier
from scanloom.llm.common import forget, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score of the compression classifier is below 0.3 go; each row is judged by its own text, and empty
    texts by the score of no text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(quality_classifier.in_training_fold())
    model = quality_classifier.learn(docs, labels)
    scored = quality_classifier.score_quality(docs, model, keep_columns=True)
    return scored.where("score >= 0.3").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are equal or near to an earlier one go, n_chars follows; null texts stay null.

    All rows stay: one whose lines are all repeats is left with an empty text, as this stage takes lines out and not
    documents, and the stages behind it treat empty texts like any other."""
    out = line_dedup.dedup_lines(docs, short_lines=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays; rows of equal id and text become one.

    Rows of one id stand for one document, which stays if one of its rows is the first of its group. Empty texts are
    linked with nothing and stay."""
    found = near_dup.near_duplicates(docs)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, whole; of all others the passages that are windows of an item are cut out, and n_chars
    follows. Documents without such a passage stay as they are.

    Each row is judged by its own text: rows and verdicts meet by the digest of the text, whatever the ids are."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.judged(decontaminate.contamination(docs, items)).where("n_hit > 0")
    found = written(found.select("digest", "contaminated", "spans").dropDuplicates(["digest"]), "contaminated")
    hit = found.where("contaminated").select(F.col("digest").alias("__digest"))
    kept = docs.join(hit, decontaminate.text_digest() == F.col("__digest"), "left_anti").select(*docs.columns)
    out = decontaminate.cut_spans(kept.withColumn("__chars", F.length("text")), found.where("not contaminated"))
    if "n_chars" in docs.columns:
        cut = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.length("text") != F.col("__chars"), cut).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the SentencePiece ids of each text, and the text that they decode to, for each
    row; empty texts have no ids."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode_and_decode(docs, model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece", sentencepiece),
]

#: SQL cannot express the stages; tests/llm/test_pipeline.py compares them with brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            forget(before)
    return docs
