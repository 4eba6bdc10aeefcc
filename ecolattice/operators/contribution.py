"""Contribution tables, slices of labelled scores, and id remapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contributions(cells: DataFrame, cutoff: float | int | None = 200, mode: str = "number") -> DataFrame:
    """The largest cells by absolute amount.

    number: the first int(cutoff) of them, ties by row and column. fraction:
    those whose absolute amount exceeds cutoff times the signed total; the
    cutoff lies between 0 and 1. None keeps all.
    """
    order = [F.abs("amount").desc(), "row_id", "col_id"]
    if cutoff is None:
        return cells.orderBy(*order)
    if mode == "number":
        return cells.orderBy(*order).limit(int(cutoff))
    if mode == "fraction":
        if not 0 < cutoff < 1:
            raise ValueError("a fraction lies between 0 and 1")
        # The total is one row.
        total = cells.agg(F.sum("amount").alias("total"))
        return cells.crossJoin(F.broadcast(total)).where(F.abs("amount") > F.col("total") * cutoff).drop("total").orderBy(*order)
    raise ValueError(f"unknown cutoff mode {mode!r}")


def annotate(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cells with what is known about their row and column; cells without known row or column go.

    nodes: id, database, code, name, location, unit, type, categories (array),
    product. Types default to process; categories are joined by `::`, null if
    there are none.
    """
    cats = F.when(F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0, F.concat_ws("::", "categories"))
    base = {"database": F.col("database"), "code": F.col("code"), "name": F.col("name"), "location": F.col("location"), "unit": F.col("unit"), "type": F.coalesce("type", F.lit("process"))}
    rows = nodes.select(F.col("id").alias("row_id"), *[c.alias(f"row_{n}") for n, c in base.items()], cats.alias("row_categories"), F.col("product").alias("row_product"))
    cols = nodes.select(F.col("id").alias("col_id"), *[c.alias(f"col_{n}") for n, c in base.items()], F.col("product").alias("col_reference_product"))
    return cells.join(rows, "row_id").join(cols, "col_id")


def mapped(cells: DataFrame, row_map: DataFrame | None = None, col_map: DataFrame | None = None) -> DataFrame:
    """Cells with the ids that maps (id, key) give for their rows and columns as row_key and col_key; null where unmapped."""
    for side, ids in (("row", row_map), ("col", col_map)):
        if ids is not None:
            cells = cells.join(ids.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key")), f"{side}_id", "left")
    return cells


def remap(frame: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Ids of a column replaced by keys (id, key) as text; ids without a key stay."""
    k = keys.select(F.col("id").alias(column), F.col("key").cast("string").alias("_key"))
    return frame.join(k, column, "left").withColumn(column, F.coalesce("_key", F.col(column).cast("string"))).drop("_key")


class Grid(Mapping):
    """A read-only view of scores by two labels; `grid[a, ...]` and `grid[..., b]` give all values on one axis."""

    def __init__(self, frame: DataFrame, first: str, second: str, value: str = "score"):
        self.frame, self.first, self.second, self.value = frame, first, second, value

    def __getitem__(self, key):
        if not isinstance(key, tuple) or len(key) != 2 or key == (..., ...):
            raise KeyError(key)
        a, b = key
        df = self.frame
        if a is not ...:
            df = df.where(F.col(self.first) == a)
        if b is not ...:
            df = df.where(F.col(self.second) == b)
        found = {(r[0], r[1]): r[2] for r in df.select(self.first, self.second, self.value).collect()}
        if ... in key:
            if not found:
                raise KeyError(key)
            return {(k[1] if b is ... else k[0]): v for k, v in found.items()}
        return found[(a, b)]

    def __iter__(self):
        return iter((r[0], r[1]) for r in self.frame.select(self.first, self.second).collect())

    def __len__(self) -> int:
        return self.frame.count()


def pivoted(scores: DataFrame, index: str, columns: str, value: str = "score") -> DataFrame:
    """A labelled table: one row for each index label, one column for each column label."""
    return scores.groupBy(index).pivot(columns).agg(F.first(value))
