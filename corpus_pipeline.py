"""A training corpus in stages, each by one of the training-data operators, from the documents table.

Stages take (spark, docs, sf_dir) and return a DataFrame; each result is written as Parquet and reread
as the next stage's docs, so a stage works on all that its predecessor kept. All but the last return the
columns of documents. No stage reads lang, source or labels of the rows that it judges beyond what its
model learns from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenyard.llm import decontam, langid, neardup, packing, quality
from lumenyard.llm.shared import fold, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and those without a letter."""
    return langid.in_known_language(docs, fold(F.col("doc_id"), 4) != 2)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is below the threshold."""
    return quality.good_enough(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a word in twenty or more stands in a benchmark window."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = packing.pieces(docs)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit),
]

#: No stage but decontamination can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
