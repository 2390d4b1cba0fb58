"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives rows; all but the last keep
the columns of documents. Toxic documents go, then those in no learned
language, then all but one of each group of near copies; the rest is mixed to
the sources' target weights (a document is repeated as often as the mix takes
it) and encoded into pieces. Every stage learns from the rows it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, nearcopies, pieces, toxicity
from tidemark.llm.common import read, stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share at least 0.8 of their shingles of five words."""
    return nearcopies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, sampled segmentations and whether these decode to the text; null texts have none."""
    return pieces.encode_texts(docs, check=True)


STAGES = [("toxicity", toxic), ("language", language), ("near_copies", near_copies), ("mixing", mixed), ("encoding", encoded)]
#: SQL can express neither the learned models nor the sampling; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
