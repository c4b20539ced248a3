"""The corpus pipeline: five stages over the documents, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return
the columns of documents.  A driver writes each result as Parquet and reads it as the next
one's docs; run() does so in the shared folder.

Rows with null ids or texts pass like others (see each operator); a document that line
dedup leaves without a line goes, as all of it stands in earlier ones; one that was empty
before stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import cotraining, decontamination, line_runs, max_plus, near_duplicates
from graphloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject."""
    return cotraining.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less later copies of line runs and of long lines; n_chars follows the text."""
    done = line_runs.dedup(docs, long_words=line_runs.LONG_WORDS).where("n_lines > n_deleted or n_lines = 0")
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, its first."""
    return near_duplicates.deduplicate(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, with its other columns, and whether they decode to its text."""
    return max_plus.encode_texts(docs).select("doc_id", "lang", "source", "n_chars", "n_chunks", "n_tokens", "round_trip", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: The classifier and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
