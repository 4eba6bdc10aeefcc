"""Inventories, characterization, normalization, weighting and scores as joins and sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return ["iteration"] if "iteration" in a.columns and "iteration" in b.columns else []


def inventory(biosphere: DataFrame, supplies: DataFrame) -> DataFrame:
    """([iteration,] fu, row_id, col_id, amount): each biosphere column scaled by its activity's supply; no zero cells."""
    b = biosphere.withColumnRenamed("amount", "factor")
    x = supplies.withColumnRenamed("activity_id", "col_id")
    joined = b.join(x, [*_shared(b, x), "col_id"])
    keys = [c for c in ("iteration",) if c in joined.columns]
    return joined.select(*keys, "fu", "row_id", "col_id", (F.col("factor") * F.col("amount")).alias("amount")).where("amount <> 0")


def characterize(cells: DataFrame, factors: DataFrame) -> DataFrame:
    """Cells times the factor of their row; rows without a factor vanish. Label columns of both sides stay, so labels cross."""
    f = factors.withColumnRenamed("amount", "factor")
    joined = cells.join(f, [*_shared(cells, f), "row_id"])
    labels = [c for c in joined.columns if c not in ("row_id", "col_id", "amount", "factor")]
    return joined.select(*labels, "row_id", "col_id", (F.col("amount") * F.col("factor")).alias("amount")).where("amount <> 0")


def weigh(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Cells times a weighting value: one for all, or one for each label that both sides have."""
    v = values.withColumnRenamed("amount", "value")
    on = [c for c in v.columns if c != "value" and c in cells.columns]
    joined = cells.join(v, on) if on else cells.crossJoin(F.broadcast(v))
    return joined.withColumn("amount", F.col("amount") * F.col("value")).drop("value")


def score(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(labels, score): sums of amounts; no cells at all give 0 without labels."""
    return cells.groupBy(*by).agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("score"))


def restricted(inner: DataFrame, outer: DataFrame, restrictions: DataFrame, inner_label: str, outer_label: str, check: bool = True) -> DataFrame:
    """Inner cells times outer factors of the same row, only for label pairs in (outer_label, inner_label) rows of restrictions."""
    if check:
        missing = inner.select(inner_label).distinct().join(restrictions, inner_label, "left_anti").limit(5).collect()
        if missing:
            raise KeyError(f"no restriction for {[r[0] for r in missing]}")
    allowed = inner.join(restrictions, inner_label)
    f = outer.withColumnRenamed("amount", "factor")
    on = [*_shared(allowed, f), outer_label] + (["row_id"] if "row_id" in f.columns else [])
    return allowed.join(f, on).withColumn("amount", F.col("amount") * F.col("factor")).drop("factor")


def restrictions_frame(spark, mapping: Mapping[str, Sequence[str]], outer_label: str, inner_label: str) -> DataFrame:
    """(outer_label, inner_label) rows of {outer: [inner, ...]}."""
    return spark.createDataFrame([(o, i) for o, many in mapping.items() for i in many], f"{outer_label} string, {inner_label} string")


def precalculated(biosphere: DataFrame, factors: DataFrame, by: Sequence[str]) -> DataFrame:
    """(labels, col_id, amount): factors summed over each biosphere column before any supply is known."""
    cells = characterize(biosphere, factors)
    return cells.groupBy(*by, "col_id").agg(F.sum("amount").alias("amount"))


def fast_scores(pre: DataFrame, supplies: DataFrame, by: Sequence[str]) -> DataFrame:
    """(labels, fu, score) from column sums and supplies."""
    p = pre.withColumnRenamed("amount", "factor")
    x = supplies.withColumnRenamed("activity_id", "col_id")
    keys = list(dict.fromkeys([*[c for c in ("iteration",) if c in p.columns or c in x.columns], *by, "fu"]))
    return p.join(x, [*_shared(p, x), "col_id"]).groupBy(*keys).agg(F.sum(F.col("factor") * F.col("amount")).alias("score"))
