"""Quality rules calibrate every language, however many there are."""

from pyspark.sql import functions as F

from ecolattice.llm import quality_rules


def test_more_languages_than_64(spark):
    # In each of 70 languages good documents have no symbols and the bad ones many; counts are given, so no text is read.
    each, strata = 2600, 70
    rows = spark.range(each * strata).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % strata).alias("stratum"), F.lit(60).cast("long").alias("n_words"), F.lit(300).cast("long").alias("word_chars"),
        F.when(F.col("id") / strata < 100, 60).otherwise(0).cast("long").alias("n_symbols"), F.lit(0).cast("long").alias("n_dup_lines"), F.lit(0).cast("long").alias("n_repeat_words"), F.lit(False).alias("base_failed"),
    )
    labels = rows.select("doc_id", F.when(F.col("n_symbols") > 0, 0).otherwise(1).alias("quality"))
    got = quality_rules.judged(rows, labels).where("not kept").groupBy("stratum").agg(F.count("*").alias("n"), F.min("n_symbols").alias("least")).collect()
    assert len(got) == strata and all(r["n"] >= 99 and r["least"] == 60 for r in got)
