"""Corpus pipeline: quality, line dedup, near-duplicate removal, secret redaction and packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``; further columns of the input are left
out. A stage's result is written as Parquet in the shared folder and read again as
the next one's documents. Null texts pass the text stages unchanged (quality scores
them as empty text) and are packed as empty text; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm import bpe, line_dedup, ngram_join, packing, quality, secrets
from twinsift.plans.storage import materialize

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER, ADDED = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labels of the table."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select(DOCUMENTS).withColumn("quality_score", quality.score(F.col("text"), model)).where(F.col("quality_score") >= quality.CUT).select(DOCUMENTS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those that consisted of such lines only go."""
    kept = line_dedup.drop_lines(docs.select(DOCUMENTS))
    left = kept.where((F.col("lines_dropped") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(DOCUMENTS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return ngram_join.keep_one(docs.select(DOCUMENTS)).select(DOCUMENTS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs.select(DOCUMENTS)).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(DOCUMENTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), added=bpe.added_tokens(public_tokenizers.path(ADDED)))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]
#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
