"""The thin queries over the tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, decontamination, fingerprints, html_wrappers, language_id, line_runs, max_plus, near_duplicates, sentence_spans, token_counts
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs.withColumn("edits", token_counts.sample_edits()))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentence_spans.dedup(docs).select("doc_id", "n_sentences", "n_removed", "text")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return max_plus.encode_texts(docs, digest=True)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return cotraining.classify(docs, table(spark, sf_dir, "labels")).drop("text", "source", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_html_extraction": op3_html_extraction,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontamination": op6_decontamination,
    "op7_fingerprints": op7_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    # all windows of two lines: each but the first of its kind deletes both its lines
    "op1_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text <> ''
        ), w AS (
            SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l
        ), r AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS r FROM w WHERE next IS NOT NULL
        ), gone AS (
            SELECT doc_id, pos FROM r WHERE r > 1 UNION SELECT doc_id, pos + 1 FROM r WHERE r > 1
        ), kept AS (
            SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_deleted,
                string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text
            FROM l LEFT JOIN gone USING (doc_id, pos) GROUP BY l.doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted,
            CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM documents d LEFT JOIN kept k USING (doc_id)
    """,
}
