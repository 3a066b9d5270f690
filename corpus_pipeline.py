"""A corpus from documents to packed sequences, in stages that each take what the one before kept.

Every stage takes any table with ``doc_id`` and ``text`` and, but for the last, returns
its columns, extra ones too, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import linededup, neardup, packing, quality, secrets
from marginalia.llm.common import cut, show_workers, table


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a rule rejects, null and empty texts among them. Rows that repeat are all kept or all gone."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat; a text of only such lines is left empty, and null texts stay null.

    Of rows with one id and text none counts as a later one.
    """
    return _sized(linededup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; texts without words, null ones too, all stay. Of repeated rows one stays."""
    show_workers(spark)
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; texts without one, null and empty ones too, are as they were. Repeated rows change alike."""
    return _sized(secrets.redact(docs, secrets.train_markov(secrets.labelled_samples(spark))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of every document's token pieces in sequences of 2048; null and empty texts have one piece of one token, and repeated rows their own places."""
    import public_tokenizers

    show_workers(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing)]

#: Signatures, a trained model and a tokenizer library are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
