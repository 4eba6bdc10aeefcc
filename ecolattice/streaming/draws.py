"""Monte Carlo as a stream: iteration numbers arrive, scores leave. An extension; batch runs need none of this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_scores(lca, source: DataFrame, path: str, checkpoint: str):
    """Starts a query that scores every iteration number arriving in `source` (column iteration) and appends to Parquet.

    Each micro-batch is one plan over its iterations; a batch that is redone
    after a failure overwrites its own folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        its = sorted(r["iteration"] for r in rows.select("iteration").distinct().collect())
        if its:
            lca.run(its).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return source.select(F.col("iteration").cast("long")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def summary(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, standard deviation and percentiles over iterations."""
    q = lambda p: F.percentile("score", F.lit(p))
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev("score").alias("stddev"), q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))
