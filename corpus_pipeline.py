"""The corpus pipeline: quality classifier, quality rules, near-duplicates, repeated passages, packing.

Every stage works on all that the one before kept. All but the last return the
columns of documents; the last returns the packed pieces. run() writes each
stage's result as a Parquet table in the shared folder and reads it again, so
a lost executor costs no more than the stage at work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ecolattice.llm import near_copies, packing, quality_classifier, quality_rules, suffix_dedup
from ecolattice.llm.common import read_table, remove, shared_folder
from ecolattice.llm.queries import vocabulary


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_passing(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more) stays: the one with the smallest id."""
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also start in a document with a smaller id are cut out of the text."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near-duplicates", near_duplicates), ("suffix-array dedup", repeats), ("best-fit packing", pack)]

#: SQL cannot express the trained classifier or the genetic packing; a test runs the stages one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
