"""The corpus pipeline: quality classifier, quality rules, near duplicates, packing.

Every stage works on all rows its predecessor kept. The first three return the
columns of ``documents`` and only drop rows; the last returns where each piece
of each remaining document lies in the packed sequences. Stages are written to
the shared folder between each other, so a lost executor repeats its own tasks
of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbwatch.llm.byte_cnn import score_rows, train_classifier
from curbwatch.llm.common import read_table, written
from curbwatch.llm.dominance_pack import pack_documents
from curbwatch.llm.jaccard_matrix import free_names, one_of_each
from curbwatch.llm.queries import tokenizer_path
from curbwatch.llm.risk_rules import kept_documents

KEEP_FROM = 0.3  # score of the classifier from which a document stays


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores as good."""
    model = train_classifier(docs, read_table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "score")
    return score_rows(docs, model, docs.columns, score).where(F.col(score) >= KEEP_FROM).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified cutoffs."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return one_of_each(docs, words=5, percent=75)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# a trained classifier has no SQL form; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
