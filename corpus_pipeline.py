"""A corpus pipeline: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import mixing, ngram_join, pii, quality, sentencepieces
from lakequill.llm.common import settle
from lakequill.llm.queries import MODEL_PATH, pii_key, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the co-trained classifier keeps."""
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links join, the document with the smallest id."""
    return ngram_join.one_of_each(docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal values replaced by their pseudonyms."""
    return pii.pseudonymise(docs, pii_key(spark))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return sentencepieces.encode_documents(docs, sentencepieces.read_model(MODEL_PATH))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", distinct_texts),
    ("pii", without_pii),
    ("mixing", mixed_sources),
    ("sentencepiece", piece_ids),
]

#: SQL cannot express the classifier, the pseudonyms and the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"pipeline-{name}")
    return docs
