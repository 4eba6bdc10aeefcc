"""What the operators leave on disk: shuffles and tables that nothing needs any more are gone."""

import os
import time

import pytest
from data import SCHEMA, documents

from ecolattice.llm import near_copies, quality_rules, substring_dedup, suffix_dedup
from ecolattice.llm.common import shared_folder


def shuffles(spark) -> set:
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for part in top for _, _, names in os.walk(part) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def tables(spark) -> set:
    """Files of tables in the shared folder (checkpoints are Spark's to clean)."""
    return {f for _, _, names in os.walk(shared_folder(spark)) for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("dedup", [suffix_dedup.remove_repeats, suffix_dedup.without_repeats, substring_dedup.remove_repeats])
def test_runs_shuffle_goes_before_texts_are_shuffled(spark, dedup):
    docs = spark.createDataFrame(documents(), SCHEMA)
    before = shuffles(spark)
    out = dedup(docs)
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffles(spark) - before
    assert out.count() == docs.count()


def test_no_tables_are_left(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 2)], "doc_id long, quality int")
    before = tables(spark)
    kept = quality_rules.keep_passing(docs, labels)
    assert tables(spark) == before
    judged = {(r["doc_id"], r["n_words"]) for r in quality_rules.apply_rules(docs, labels).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in judged}
    near_copies.keep_one(docs).count()
    assert tables(spark) == before
